"""Request validation as a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Required fields, greatest lengths, ranges.
REQUIRED = {"analysis_runs": ["repository_path"], "few_shot_examples": ["question", "suggested_answer", "difficulty"]}
MAX_LENGTH = {
    "analysis_runs": {"repository_path": 2000, "repo_name": 255, "repo_owner": 255, "repo_description": 1000, "repo_url": 500, "repo_language": 100},
    "few_shot_examples": {"question": 2000, "difficulty": 20, "tag": 100},
}
RANGES = {"analysis_runs": {"repo_stars": (0, 2147483647)}, "few_shot_examples": {}}


def violations(table: str, rows: DataFrame, creating: bool = True) -> DataFrame:
    """Each row's violations: the columns of ``rows`` and ``violation``, one row per violated rule."""
    checks = []
    if creating:
        checks += [F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0, F.lit(f"{c} is required")) for c in REQUIRED[table]]
    checks += [F.when(F.length(c) > n, F.lit(f"{c} is longer than {n}")) for c, n in MAX_LENGTH[table].items() if c in rows.columns]
    checks += [F.when(~F.col(c).between(lo, hi), F.lit(f"{c} is out of range")) for c, (lo, hi) in RANGES[table].items() if c in rows.columns]
    return rows.withColumn("violation", F.explode(F.array_compact(F.array(*checks))))
