"""Merkle fixity audit of WARC records kept in several replicas.

A record is written as in an archive: version, type, id, target, length, an empty line, the payload and
two line ends. Records lie one after the other in order of their ids, so a record's offset is the sum of
the lengths before it. Each has a SHA-256 over all its bytes. Ranges of ``width`` consecutive ids are the
leaves' parents: a range's hash covers its records' hashes with their offsets in order, a node above
covers ``fanout`` ranges below, up to one root. Two replicas are compared from the root down; only the
children of nodes that differ are looked at, so an intact replica costs one comparison, and damage is
located to records, with their byte offsets.

Defined cases: null fields count as empty; records without an id come first, dealt by hash to
``NULL_RANGES`` ranges below 0, so that no range grows with them all; records of the same id are ordered
by their hash; repeated records count with their number; a record that only one replica has is reported
as missing or extra; empty archives have equal (absent) roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import stage


#: Ranges of records without an id.
NULL_RANGES = 1 << 16


def warc_record(record_id: Column, target: Column, payload: Column) -> Column:
    """The record's bytes, as text in UTF-8; null counts as empty."""
    name, uri, body = (F.coalesce(c.cast("string"), F.lit("")) for c in (record_id, target, payload))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


class MerkleTree:
    """Levels of one replica: ``records`` (id, hash, copies, bytes, start), and ``levels[k]`` (node, hash).

    A level is written to the shared folder when it is made. Offsets are running sums of record
    sizes: within a range, and over siblings from the root down.
    """

    def __init__(self, records: DataFrame, width: int = 64, fanout: int = 16):
        self.width, self.fanout = width, fanout
        own = records.groupBy("id", "hash", "bytes").agg(F.count("*").alias("copies"))
        by_hash = -1 - F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % NULL_RANGES
        own = own.withColumn("node", F.when(F.col("id").isNull(), by_hash).otherwise(F.floor(F.col("id") / width)))
        within = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_first(), "hash")
        own = own.withColumn("upto", F.sum(F.col("bytes") * F.col("copies")).over(within))
        own = stage(own, "merkle-records")
        line = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("hash"), F.col("upto"), F.col("copies"))
        first = own.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("id", "hash", line.alias("line")))).alias("all"), F.sum(F.col("bytes") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n"))
        first = first.select("node", F.sha2(F.array_join(F.col("all.line"), "\n"), 256).alias("hash"), "bytes", "n")
        self.levels = [stage(first, "merkle-ranges")]
        self.above: list[Column] = []  #: by level, a node's parent
        while True:
            low = self.levels[-1].agg(F.min("node").alias("lo"), F.max("node").alias("hi")).first()
            if low["lo"] is None or low["lo"] == low["hi"]:
                break
            # ids of both signs meet in one root
            above = F.lit(0) if (low["lo"], low["hi"]) == (-1, 0) else F.floor(F.col("node") / fanout)
            self.above.append(above.cast("long"))
            up = self.levels[-1].groupBy(self.above[-1].alias("up"))
            up = up.agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("all"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
            line = F.array_join(F.transform("all", lambda r: F.concat_ws(":", r["node"], r["hash"])), "\n")
            self.levels.append(stage(up.select(F.col("up").alias("node"), F.sha2(line, 256).alias("hash"), "bytes", "n"), "merkle-level"))
        self.records = own

    def root(self) -> str | None:
        found = self.levels[-1].first()
        return found["hash"] if found else None

    def ranges(self) -> DataFrame:
        """(node, bytes, n, first_offset) of the ranges: offsets go down the tree, over siblings only."""
        running = Window.partitionBy("_up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        found = self.levels[-1].select("node", "bytes", "n", F.lit(0).cast("long").alias("first_offset"))
        for level, above in zip(self.levels[-2::-1], self.above[::-1], strict=True):
            up = found.select(F.col("node").alias("_up"), F.col("first_offset").alias("_base"))
            own = level.withColumn("_up", above).join(up, "_up")
            found = own.select("node", "bytes", "n", (F.col("_base") + F.coalesce(F.sum("bytes").over(running), F.lit(0))).alias("first_offset"))
        return found


def differing(a: MerkleTree, b: MerkleTree) -> DataFrame | None:
    """Ranges (column node) whose hashes differ, found from the roots down; None if the roots agree."""
    if a.root() == b.root() and len(a.levels) == len(b.levels):
        return None
    open_nodes = None
    for k in range(max(len(a.levels), len(b.levels)) - 1, -1, -1):
        if k >= len(a.levels) or k >= len(b.levels):
            continue  # trees of different heights meet at the highest level that both have
        x, y = (t.levels[k].select("node", "hash") for t in (a, b))
        # below a root, all nodes are its children
        if open_nodes is not None and k + 1 < min(len(a.levels), len(b.levels)) - 1:
            up = open_nodes.withColumnRenamed("node", "_up")
            x, y = (t.join(up, F.floor(F.col("node") / a.fanout) == F.col("_up"), "left_semi") for t in (x, y))
        met = x.withColumnRenamed("hash", "_x").join(y.withColumnRenamed("hash", "_y"), "node", "full")
        open_nodes = stage(met.filter(~F.col("_x").eqNullSafe(F.col("_y"))).select("node"), "merkle-open")
    return open_nodes


def audit(a: MerkleTree, b: MerkleTree) -> DataFrame:
    """One row per range of either replica: node, first_offset, n, bytes, n_damaged, damaged, intact.

    ``damaged``: of the records that differ, id:offset:status joined by commas, status one of corrupt,
    missing (replica b lacks it) and extra (only b has it).
    """
    nodes = a.ranges()
    found = differing(a, b)
    if found is None:
        return nodes.select("node", "first_offset", "n", "bytes", F.lit(0).cast("long").alias("n_damaged"), F.lit("").alias("damaged"), F.lit(True).alias("intact"))
    left = a.records.join(found, "node", "left_semi").select("node", F.col("id").alias("ia"), F.col("hash").alias("ha"), F.col("copies").alias("ca"), (F.col("upto") - F.col("bytes") * F.col("copies")).alias("offset"))
    right = b.records.join(found, "node", "left_semi").select(F.col("node").alias("nb"), F.col("id").alias("ib"), F.col("hash").alias("hb"), F.col("copies").alias("cb"))
    # records of an id are compared as the ordered list of their hashes
    left = left.groupBy("node", "ia").agg(F.sort_array(F.collect_list(F.struct("ha", "ca"))).alias("ha"), F.min("offset").alias("offset"))
    right = right.groupBy("nb", "ib").agg(F.sort_array(F.collect_list(F.struct(F.col("hb").alias("ha"), F.col("cb").alias("ca")))).alias("hb"))
    met = left.join(right, (F.col("node") == F.col("nb")) & F.col("ia").eqNullSafe(F.col("ib")), "full").filter(~F.col("ha").eqNullSafe(F.col("hb")))
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("corrupt")
    met = met.select(F.coalesce("node", "nb").alias("node"), F.coalesce("ia", "ib").alias("id"), "offset", status.alias("status"))
    met = met.join(nodes.select("node", "first_offset"), "node", "left")
    line = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce((F.col("first_offset") + F.col("offset")).cast("string"), F.lit("-")), "status")
    bad = met.groupBy("node").agg(F.count("*").alias("n_damaged"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda r: r["line"]), ",").alias("damaged"))
    out = nodes.join(bad, "node", "full")
    return out.select("node", "first_offset", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_damaged", F.lit(0)).cast("long").alias("n_damaged"), F.coalesce("damaged", F.lit("")).alias("damaged"), F.col("n_damaged").isNull().alias("intact"))


def page_records(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """Pages as records: id, hash, bytes."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html") if html is None else html)
    own = pages.select(F.col("page_id").alias("id"), record.alias("record"))
    return own.select("id", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("bytes"))
