"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(c: Column) -> Column:
    """Strip all Unicode white space at both ends (``trim`` strips U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def node_key(cls: Column, method: Column) -> Column:
    """The key under which a graph node is found: trimmed, lower case."""
    return F.concat(F.lower(trim_all(cls)), F.lit("::"), F.lower(trim_all(method)))


def label(c: Column) -> Column:
    """A diagram label: double quotes become single ones, angle brackets are escaped."""
    return F.replace(F.replace(F.replace(c, F.lit('"'), F.lit("'")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def camel_upper(c: Column) -> Column:
    """The first letter upper-cased, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def pascal_case(c: Column, separators: str = "-_.") -> Column:
    """Parts between separators joined, each with its first letter upper-cased."""
    parts = F.filter(F.split(c, "[" + "".join("\\" + s for s in separators) + "]"), lambda p: p != "")
    return F.array_join(F.transform(parts, camel_upper), "")


def contains_ci(c: Column, text: str) -> Column:
    """Contains ``text`` literally, ignoring case and ``text``'s outer blanks; null does not."""
    return F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False))


def equals_ci(c: Column, text: str) -> Column:
    return F.lower(c) == F.lit(text.strip().lower())


def is_git_url(c: Column) -> Column:
    return F.lower(trim_all(c)).rlike(r"^https?://|\.git$")


# Hosts whose browser urls are rewritten.
GIT_HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]


def normalize_git_url(c: Column) -> Column:
    """Browser urls of known hosts as clone urls; what ends in .git, and anything else, trimmed only."""
    own = trim_all(c)
    out = own
    for host in reversed(GIT_HOSTS):
        pattern = rf"(?i)^https?://{host.replace('.', '[.]')}/([^/]+/[^/]+)(?:/.*)?$"
        out = F.when(own.rlike(pattern), F.concat(F.lit(f"https://{host}/"), F.regexp_extract(own, pattern, 1), F.lit(".git"))).otherwise(out)
    return F.when(F.lower(own).endswith(".git"), own).otherwise(out)


def stable_id(*parts: Column | str) -> Column:
    """An id made from its parts, so that a second run gives the same ids."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256).substr(1, 32)
