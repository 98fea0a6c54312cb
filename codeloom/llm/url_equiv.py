"""URL filters with redirect equivalence.

Rules of (verdict, host, path) decide urls whose host is the rule's or below it and whose path starts
with the rule's; the longest rule (host and path) wins, of equal ones an allowing one. Redirects (meta
refresh) and canonical links of pages are edges between urls without their fragments; over the
connected components of these edges decisions pass to the urls that no rule fits: an explicit allow
anywhere in the component takes precedence, then a block; a url that nothing reaches is allowed.

Rules are sent to all tasks up to ``SEND_RULES``, and joined by host suffix in a shuffle beyond.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and no edges, and
is allowed; null pages have no edges; relative links are resolved against the page's url, other schemes without
a host (mailto: and the like) are ignored; a hub of many aliases costs partial minima only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stage
from codeloom.llm.components import components

SEND_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain(url: Column) -> Column:
    """The url without its fragment, which no server sees; host and path stay as they are."""
    return F.regexp_replace(url, r"(?s)^(.*?://[^#]*)#.*$", "$1")


def resolved(url: Column, link: Column) -> Column:
    """The absolute url of a page's link, null if it leads to no host."""
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    here = F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/"))
    to, query = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    merged = F.when(to == "", here).when(to.startswith("/"), to).otherwise(F.concat(F.regexp_extract(here, r"(?s)^(.*/)", 1), to))
    steps = F.slice(F.split(merged, "/", -1), 2, 1 << 30)
    up = lambda at, step: F.when(step == "..", F.regexp_replace(at, r"/[^/]*$", "")).when(step == ".", at).otherwise(F.concat(at, F.lit("/"), step))
    path = F.concat(F.aggregate(steps, F.lit(""), up), F.when(merged.rlike(r"/\.\.?$"), "/").otherwise(""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), link))
        .otherwise(F.concat(root, path, query))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's url and the url it redirects to or names as canonical."""
    tags = F.concat(
        F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), 0),
        F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), 0),
    )
    rows = pages.filter(F.col(url_col).contains("://")).select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    link = F.coalesce(F.nullif(F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")), F.nullif(F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1), F.lit("")))
    links = rows.select("url", link.alias("link")).filter("link is not null")
    links = links.select(plain(F.col("url")).alias("a"), plain(resolved(F.col("url"), F.col("link"))).alias("b"))
    return links.filter("b is not null").distinct()


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with rule and decision (null where no rule fits); urls are distinct."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    spread = urls.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix"))
    few = rules.count() <= SEND_RULES
    own = rules.select("decision", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    met = spread.join(F.broadcast(own) if few else own, (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = met.groupBy("url").agg(F.max(F.struct(F.length(text).alias("n"), (F.col("decision") == "allow").alias("allows"), text.alias("rule"), "decision")).alias("best"))
    return urls.join(best.select("url", "best.rule", "best.decision"), "url", "left")


def judge_pages(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict for every page, and ``reason``: rule, alias or default."""
    edges = stage(alias_edges(pages, url_col, html_col), "alias-edges")
    named = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.select(plain(named).alias("url")).union(edges.select("a")).union(edges.select("b")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    decided = stage(decide(urls, rules), "url-decisions")
    own = pages.select(F.col(id_col).alias("page_id"), plain(named).alias("url"))
    if edges.isEmpty():
        told = decided.withColumn("alias", F.lit(None).cast("string"))
    else:
        roots = components(edges)
        joined = decided.join(roots.withColumnRenamed("node", "url"), "url", "left")
        groups = joined.filter("root is not null and decision is not null").groupBy("root").agg(F.min("decision").alias("alias"))  # allow sorts before block
        told = joined.join(groups, "root", "left").drop("root")
    out = own.join(told, "url")
    verdict = F.coalesce("decision", "alias", F.lit("allow"))
    reason = F.when(F.col("decision").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), reason.alias("reason"))
