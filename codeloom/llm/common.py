"""What the operators of this package share: the shared work folder, staged tables, defaults for nulls."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session names none a temporary one is set, on a laptop (master ``local``) only: on a
    cluster a machine-local folder would lose what other machines read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below the application's id; removed when the driver's Python ends."""
    if not _MADE:
        atexit.register(_remove)
    path = f"{shared_dir(spark)}/codeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def _remove() -> None:
    for path, spark in list(_MADE.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the JVM has ended before; the folder is the scheduler's to clear
            return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_staged_path", None)
        if path and _MADE.pop(path, None):
            drop_path(table.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: Column | str, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")), F.lit(0)) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns that clash with none of ``df``'s (extra columns may have any name)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows up to which a table is sent whole: the driver holds it as rows, several times while it is built.
SEND_TABLE = 20_000


def unsent(table: DataFrame, rows: int) -> DataFrame:
    """``table``, of so many rows, as a side of a join that is shuffled unless it is small.

    Without the hint Spark sends whatever its files show to be below 10 MB, which is some million rows of ids.
    """
    return table.hint("merge") if rows > SEND_TABLE else table


#: Keys with more than this part of all rows count as hot; there are never more such keys than this.
HOT_KEYS = 10_000


def join_back(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row per key, without nulls in ``keys``), safe from hot keys.

    ``count`` tells how many of the ``total`` rows have the key. Keys with more than a ``HOT_KEYS``-th of
    all rows are fewer than ``HOT_KEYS``, whatever the data, and are broadcast; the others are
    shuffled. ``rows`` is read twice. ``count`` is not part of the result.
    """
    (mark,) = fresh(rows.join(table, keys), "hot")
    is_hot = F.col(count) * HOT_KEYS > F.lit(total)
    hot = rows.join(F.broadcast(table.filter(is_hot).drop(count).withColumn(mark, F.lit(True))), keys, "left")
    rest = hot.filter(F.col(mark).isNull()).select(*rows.columns).join(table.filter(~is_hot).drop(count), keys, "left")
    return hot.filter(F.col(mark)).drop(mark).unionByName(rest)
