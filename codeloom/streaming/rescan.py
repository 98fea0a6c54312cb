"""Incremental extraction from a folder of source files that keeps growing.

An extension of ours: new files are taken in by Structured Streaming (every file once, remembered in the
checkpoint), parsed by the same extractors, and appended. Calls that need the whole repository (C#) are
bound when the graph is built, from all facts so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.extract import extract_facts
from codeloom.schemas import FACTS
from codeloom.sources.files import LANGUAGES, not_skipped


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """Source files as a stream: path, language, file_ord (a hash of the path), content."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    files = raw.select("path", F.try_element_at(kinds, ext).alias("language"), F.decode("content", "UTF-8").alias("content"))
    files = files.filter(F.col("language").isNotNull() & not_skipped(F.col("path")))
    return files.select("path", "language", F.pmod(F.xxhash64("path"), F.lit(1 << 30)).alias("file_ord"), F.regexp_replace("content", "^﻿", "").alias("content"))


def rescan(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Append the facts of files that are new since the last call."""
    query = extract_facts(stream_files(spark, folder)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def facts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(FACTS).parquet(out)
