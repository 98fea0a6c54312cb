"""Source files of a repository as a DataFrame.

Spark's file sources skip names that start with ``_`` or ``.``, so a data source of ours lists them (``sources/tree.py``), and
tasks read them. A folder that only the driver sees can be shipped, a bounded batch at a time, through the shared
folder. Files are ordered by relative path, which fixes the order of all edges.
"""

from __future__ import annotations

import codecs
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.ranking import numbered
from codeloom.plans.staging import shared_dir
from codeloom.sources import tree

#: Contents that the driver holds at a time when it ships files.
SHIP_BYTES = 64 << 20

# Folders that are not looked into (any case).
SKIPPED = [
    "obj", "bin", "node_modules", ".git", ".github", ".vscode", ".idea", "__pycache__", ".pytest_cache", ".mypy_cache",
    "venv", ".venv", "env", "dist", "build", ".next", ".nuxt", "coverage", "migrations", "target",
]

# Extension -> language.
LANGUAGES = {
    ".cs": "C# (.NET)",
    ".java": "Java (Spring Boot)",
    ".py": "Python (FastAPI)",
    ".js": "Node.js (Express)",
    ".ts": "Node.js (Express)",
    ".mjs": "Node.js (Express)",
    ".cjs": "Node.js (Express)",
}


def not_skipped(path: F.Column) -> F.Column:
    """No component of the path is a skipped folder."""
    return ~F.arrays_overlap(F.transform(F.split(path, r"[/\\]"), F.lower), F.array(*[F.lit(s) for s in SKIPPED]))


def source_paths(paths: DataFrame, languages: dict[str, str] | None = None, tested: F.Column | None = None) -> DataFrame:
    """``paths`` (column path) of known languages outside skipped folders, with ext (in lower case) and language.

    ``tested`` is what is looked through for skipped folders, the path if not given.
    """
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    dim = F.broadcast(paths.sparkSession.createDataFrame(list((languages or LANGUAGES).items()), "ext string, language string"))
    return paths.filter(not_skipped(F.col("path") if tested is None else tested)).withColumn("ext", ext).join(dim, "ext")


def list_paths(root: str) -> Iterator[str]:
    for folder, below, names in os.walk(root):
        below[:] = [x for x in below if x.lower() not in SKIPPED]
        for name in names:
            yield os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")


def _decode(raw: bytes) -> str:
    return raw.removeprefix(codecs.BOM_UTF8).decode("utf-8", "replace")


def ship(spark: SparkSession, root: str, paths: list[str], batch_bytes: int = SHIP_BYTES) -> DataFrame:
    """(path, raw, error) of the files, written to the shared folder in batches of about ``batch_bytes``."""
    at = f"{shared_dir(spark)}/shipped-{uuid.uuid4().hex}"
    rows, size, schema = [], 0, "path string, raw binary, error string"

    def send():
        spark.createDataFrame(rows, schema).write.mode("append").parquet(at)

    for path in paths:
        raw, error = tree.file_bytes(root, path)
        rows.append((path, raw if raw is None else bytearray(raw), error))
        size += len(raw or b"")
        if size >= batch_bytes:
            send()
            rows, size = [], 0
    if rows or not paths:
        send()
    return spark.read.schema(schema).parquet(at)


def scan_repository(spark: SparkSession, root: str, languages: dict[str, str] | None = None, absolute_skip: bool = False, shipped: bool = False, rev: str | None = None) -> DataFrame:
    """path, ext, language, file_ord, content, error of every source file below ``root``.

    Tasks list and read the files, so ``root`` is a folder that all executors see; ``shipped`` is for one that only the driver
    sees. With ``rev``, the files are those of that commit in the git repository ``root`` (bare or not), read from its
    objects. ``absolute_skip`` tests the absolute path for skipped folders instead of the relative one. An unreadable file has
    null content and its error.
    """
    root = os.path.abspath(root)
    tested = F.concat(F.lit(root + "/"), F.col("path")) if absolute_skip else None
    if shipped:
        listed = spark.createDataFrame([(p,) for p in sorted(list_paths(root))], "path string")
        ranked = _ranked(source_paths(listed, languages, tested))
        raw = ranked.join(ship(spark, root, [r["path"] for r in ranked.select("path").collect()]), "path")  # a list that came from the driver
    else:
        known = source_paths(tree.paths(spark, root, SKIPPED, rev), languages, tested)
        raw = tree.contents(_ranked(known, "size", "oid"), root)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["content"] = [None if x is None else _decode(bytes(x)) for x in pdf["raw"]]
            yield pdf[["path", "ext", "language", "file_ord", "content", "error"]]

    return raw.mapInPandas(decode, "path string, ext string, language string, file_ord long, content string, error string")


def _ranked(files: DataFrame, *more: str) -> DataFrame:
    """Add ``file_ord``: the place of the path among all, from 0."""
    own = numbered(files.select("path", "ext", "language", *more), [], ["path"], "file_ord")
    return own.withColumn("file_ord", F.col("file_ord") - 1)


def language_counts(files: DataFrame) -> DataFrame:
    """Files per language, and their paths in order."""
    return files.groupBy("language").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("path")).alias("paths"))
