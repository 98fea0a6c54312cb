"""Column functions of the engine."""

from codeloom.functions.text import camel_upper, contains_ci, equals_ci, is_git_url, label, node_key, normalize_git_url, pascal_case, stable_id, trim_all

__all__ = ["camel_upper", "contains_ci", "equals_ci", "is_git_url", "label", "node_key", "normalize_git_url", "pascal_case", "stable_id", "trim_all"]
