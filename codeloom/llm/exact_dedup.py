"""Exact deduplication against a persistent digest index.

The index is a table of (digest, keep_id, copies, first), bucketed and sorted by the SHA-256 digest of the
text. A new batch is reduced to one row per digest and sort-merge anti-joined with the index, whose side
is not shuffled; what is new is appended, and for texts that the index has the batch's number of copies
is. A row's label comes from that join's result, which has a row for each digest of the batch, so nothing
but the batch is shuffled, however large the index. DataFrame operations only.

Defined cases: a null text counts as empty; of equal texts in one batch the row with the largest id
stays (null ids come last, and one stays if all are null); a text that an earlier batch brought keeps
that batch's row; ``group_size`` counts the equal rows of all batches up to this one; of rows that repeat
both id and text, one stays; an empty batch adds nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import free, fresh, shared_path, stage


def digest_of(text) -> F.Column:
    """SHA-256 of the text in UTF-8 as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


class DigestIndex:
    """A digest index at ``path``: Parquet files bucketed and sorted by digest.

    The number of buckets is fixed when the index is made and kept beside the files; choose it so that a
    bucket of the final index (about 50 bytes a distinct text and batch) stays near 128 MB. Opening an
    index with another number is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.table = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:32]
        jvm = spark.sparkContext._jvm
        at, note = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path, "_buckets")
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        if files.exists(note):
            stream = files.open(note)
            own = int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            if buckets not in (None, own):
                raise ValueError(f"the index at {path} has {own} buckets, not {buckets}")
            self.buckets = own
        else:
            self.buckets = buckets or 64
            stream = files.create(note)
            stream.writeBytes(str(self.buckets))
            stream.close()
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")  # external: files stay
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, copies BIGINT, first BOOLEAN) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size) with the index's buckets: joins on ``digest`` need no shuffle of this side."""
        of_first = F.max(F.when(F.col("first"), F.col("keep_id")))
        return self.spark.table(self.table).groupBy("digest").agg(of_first.alias("keep_id"), F.sum("copies").alias("group_size"))

    def append(self, keys: DataFrame) -> DataFrame:
        """Bring a batch in. ``keys``: digest, id, copies. Returns its digests: digest, keep_id, group_size, known."""
        batch = keys.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("copies"))
        dealt = stage(batch, "digest-batch")
        side = dealt.repartition(self.buckets, "digest")
        new = stage(side.join(self.read().select("digest").hint("merge"), "digest", "left_anti"), "digest-new")
        told = new.select("digest", "keep_id", F.col("copies").alias("group_size"), F.lit(False).alias("known"))
        rows = new.select("digest", "keep_id", "copies", F.lit(True).alias("first"))
        if new.count() < dealt.count():
            old = self.read().withColumnRenamed("keep_id", "_keep").hint("merge")
            again = stage(side.join(old, "digest").select("digest", "_keep", "copies", (F.col("group_size") + F.col("copies")).alias("group_size")), "digest-again")
            told = told.union(again.select("digest", "_keep", "group_size", F.lit(True)))
            rows = rows.union(again.select("digest", F.lit(None).cast("long"), "copies", F.lit(False)))
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        free(dealt)
        return told


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, id, copies) of a table: one row for each id and text."""
    return docs.select(digest_of(text_col).alias("digest"), F.col(id_col).cast("long").alias("id")).groupBy("digest", "id").agg(F.count("*").alias("copies"))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring a batch into the index; one row per document: doc_id, keep_id, group_size, kept, text_sha256, known.

    ``known``: an earlier batch had the text, so none of this batch's rows stays. The texts are read
    once; what follows works on staged keys of about 50 bytes.
    """
    keys = stage(keys_of(docs, id_col, text_col), "digest-keys")
    # both sides are written tables, so that a large group's rows can be split at run time
    found = keys.join(index.append(keys), "digest")
    rows = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (~F.col("known") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "known",
    )


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows meet their decision by digest and id, so a large group of copies spreads over the cluster;
    of rows that repeat both, one stays (the least by a hash of the other columns).
    """
    digest, first = fresh(docs, "digest", "digest_rank")
    keys = stage(keys_of(docs, id_col, text_col), "digest-keys")
    stay = index.append(keys).filter("not known")
    stay = stay.select(F.col("digest").alias("_d"), F.coalesce("keep_id", F.lit(-1)).alias("_i"), F.col("keep_id").isNull().alias("_n"))
    free(keys)
    rows = docs.withColumn(digest, digest_of(text_col))
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    met = rows.join(stay, (F.col(digest) == F.col("_d")) & (own == F.col("_i")) & (F.col(id_col).isNull() == F.col("_n")), "left_semi")
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "array", "struct", "void", "variant"))]
    order = Window.partitionBy(digest, own, F.col(id_col).isNull()).orderBy(F.xxhash64(*plain))
    return met.withColumn(first, F.row_number().over(order)).filter(F.col(first) == 1).select(*docs.columns)


def new_index(spark: SparkSession, name: str = "digest-index", buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder, with as many buckets as the session has shuffle partitions."""
    return DigestIndex(spark, shared_path(spark, name), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
