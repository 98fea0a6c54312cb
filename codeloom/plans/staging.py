"""Cutting the lineage of iterative plans with reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Driver and tasks are one process, so machine-local folders are shared."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a laptop a temporary one if the session names none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="codeloom-cut-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession) -> str | None:
    """The shared folder as a path for plain file calls of the driver and of tasks; none if it is no mounted folder."""
    at = shared_dir(spark)
    if at.startswith("file:"):
        return "/" + at.removeprefix("file:").lstrip("/")
    return None if ":" in at.split("/", 1)[0] else at


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As :func:`cut`, but by columns and compressed: for tables as large as the graph, a tenth of a checkpoint's bytes.

    Rows come back in any order. The folder stays, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wide(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and never sent whole to the driver and the tasks.

    For rows that Python code or generated text makes: Spark takes them for as few and short as the columns they come from.
    """
    return df.hint("merge")
