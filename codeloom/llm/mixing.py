"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id; a document's k-th copy gets the virtual
finish time (words of its source up to and with it, plus k-1 times the source's words) divided by the
source's target. All copies are ordered by finish time over all sources and taken until the budget is
reached. A source's last copies stop at ``max_repeats``.

Targets: weights share the budget; a target stops at ``max_repeats`` times its source's size and what
is left over is shared by weight among the others, until none is above (a water level over sources
ordered by size per weight).

The place in the order at which the budget ends is found by counting: words by ranges of finish time
(``BINS`` at a time), then by ranges of the range in which the budget ends, until few copies are left,
which alone are sorted. A document's copies follow from its own finish times and that place, so the
queue as a whole is never sorted or gathered, however its finish times are spread.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last;
null and repeated ids share a place in the shuffle, ties are ordered by size; an empty table gives
no rows; if all sizes are 0 every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import free, stage
from codeloom.llm.prefix_sums import running_sum

#: Rows of a bucket of a source's shuffle, on average.
BUCKET_ROWS = 4096
#: Ranges of finish times that are counted at a time.
BINS = 1024
#: Copies that are few enough to be sorted in one task.
FEW = 50_000
#: Sources up to which their table is sent to every task.
SEND_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    each = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")  # no array of words
    return F.length(F.translate(each, "\t\n\x0b\x0c\r ", "")).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], max_repeats: float = 3.0) -> DataFrame:
    """source, rank, source_size, source_docs, budget, target, from one row per source with its size and documents.

    The table has one row per source, so a single window over it is small.
    """
    everything = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    ranked = ranked.withColumn("budget", F.sum("source_size").over(everything))
    filling = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    # sources before this one, in the order in which they reach their caps, are full
    full = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.col("budget") - full) / open_weight).withColumn("turn", F.row_number().over(filling))
    # the water level is that of the first source which does not reach its cap
    level = level.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))).over(everything)["level"])
    target = F.when(F.col("budget") == 0, 0.0).otherwise(F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))))
    return level.select("source", "rank", "source_size", "source_docs", "budget", target.alias("target"))


def _finish(copy: Column, upto: str = "upto") -> Column:
    return F.try_divide(F.col(upto) + (copy - 1) * F.col("source_size"), F.col("target"))


def _end(copies: DataFrame, budget: int) -> tuple[float, int, int] | None:
    """(finish, rank, upto) of the last copy within the budget; None if all are.

    ``copies``: finish, rank, upto, size (above 0).
    """
    whole = copies.agg(F.min("finish").alias("lo"), F.max("finish").alias("hi"), F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if not whole["n"] or whole["size"] <= budget:
        return None
    lo, hi, n, drawn = whole["lo"], whole["hi"], whole["n"], 0
    while n > FEW and lo < hi:
        nth = F.least(F.lit(BINS - 1), F.floor((F.col("finish") - lo) / (hi - lo) * BINS))
        bins = copies.filter(F.col("finish").between(lo, hi)).groupBy(nth.alias("nth")).agg(F.min("finish").alias("lo"), F.max("finish").alias("hi"), F.sum("size").alias("size"), F.count("*").alias("n"))
        for r in sorted(bins.collect(), key=lambda r: r["nth"]):
            if drawn + r["size"] > budget:
                break
            drawn += r["size"]
        lo, hi, n = r["lo"], r["hi"], r["n"]
    order = Window.partitionBy(F.lit(0)).orderBy("finish", "rank", "upto")
    last = copies.filter(F.col("finish").between(lo, hi)).withColumn("drawn", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + drawn)
    # the first copy beyond: what is before it in the order is taken
    found = last.filter(F.col("drawn") > budget).orderBy("finish", "rank", "upto").first()
    return found["finish"], found["rank"], found["upto"]


def fair_mix(docs: DataFrame, weights: list[float] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    shuffled = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (n_words(F.col(text_col)) if size is None else size).alias("size"), shuffled.alias("place"))
    rows = stage(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    targets = stage(source_targets(sizes, list(weights), max_repeats), "mix-targets")
    few = targets.count() <= SEND_SOURCES
    sent = lambda t: F.broadcast(t) if few else t

    ranks = targets.select(F.col("source").alias("_source"), "rank", "source_docs")
    known = rows.join(sent(ranks), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    width = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / BUCKET_ROWS))
    known = known.withColumn("bucket", F.floor(F.col("place") / F.lit(float(1 << 48)) * width)).drop("source_docs")
    known = stage(running_sum(known, "rank", "bucket", ["place", "doc_id", "size"], "size", "upto").drop("bucket", "place"), "mix-known")
    free(rows)

    known = known.join(sent(targets.drop("source_docs")), "rank")
    # a source's copies that can finish near the budget's end or before it
    most = F.least(F.lit(max_repeats), F.ceil(F.try_divide("target", "source_size")) + 1).cast("int")
    made = known.filter(F.col("size") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), most)))
    made = made.select(_finish(F.col("copy")).alias("finish"), "rank", "upto", "size")
    budget = targets.agg(F.max("budget")).first()[0]
    end = _end(made, budget or 0)
    before = lambda k: F.lit(True) if end is None else F.struct(_finish(F.lit(k)), F.col("rank"), F.col("upto")) < F.struct(F.lit(end[0]), F.lit(end[1]).cast("int"), F.lit(end[2]).cast("long"))
    copies = sum((F.when((F.col("size") > 0) & (most >= k) & before(k), 1).otherwise(0) for k in range(1, max_repeats + 1)), F.lit(0))
    out = known.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
