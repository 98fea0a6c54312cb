"""Trees of files that tasks list and read: a folder that all executors see, or the object store of a git repository.

``paths`` is a Spark data source: its partitions are subtrees, so tasks list them; skipped folders are not entered. The driver
lists folders only until there are ``SUBTREES`` of them, and never a file. ``contents`` reads files in tasks, dealt by
path over as many of them as the sizes ask for. A retried task lists or reads the same again.

Defined cases: links to folders are not followed, links to files are read as files of a folder and left out of a git tree, as
are submodules; a file that is gone or unreadable has null bytes and its error; a root that is no folder for a task, or
no repository, is an error; an empty tree has no rows.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders among which the listing is divided; they are dealt over four tasks a core.
SUBTREES = 256
#: Paths of a batch of the listing, bytes of a batch of contents, and of a task that reads them.
BATCH_PATHS, BATCH_BYTES, TASK_BYTES = 10_000, 16 << 20, 128 << 20
LISTED = "path string, size long, oid string"


@dataclass
class Subtree(InputPartition):
    """Folders to list, with all that is below them or their own files only."""

    folders: tuple[str, ...]
    below: bool


def _batches(rows: Iterator[tuple[str, int | None, str | None]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch():
        path, size, oid = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(oid, pa.string())], ["path", "size", "oid"])

    for row in rows:
        held.append(row)
        if len(held) >= BATCH_PATHS:
            yield batch()
            held = []
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, root: str, skipped: frozenset[str], tasks: int):
        self.root, self.skipped, self.tasks = root, skipped, tasks

    def entered(self, name: str) -> bool:
        return name.lower() not in self.skipped

    def folders(self, at: str) -> list[str]:
        """Folders in the folder ``at`` that are entered, by path from the root."""
        raise NotImplementedError

    def files(self, at: str, below: bool) -> Iterator[tuple[str, int | None, str | None]]:
        raise NotImplementedError

    def partitions(self) -> list[Subtree]:
        whole, level = [], [""]
        while level and len(level) < SUBTREES:
            whole += level
            level = [own for at in level for own in self.folders(at)]
        return [Subtree(tuple(own[i :: self.tasks]), below) for own, below in ((level, True), (whole, False)) for i in range(min(self.tasks, len(own)))]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        return _batches(row for at in partition.folders for row in self.files(at, partition.below))


class _FolderReader(_Reader):
    def _entries(self, at: str) -> Iterator[tuple[str, os.DirEntry]]:
        with os.scandir(os.path.join(self.root, at)) as entries:
            for entry in entries:
                yield (f"{at}/{entry.name}" if at else entry.name), entry

    def folders(self, at: str) -> list[str]:
        return sorted(path for path, e in self._entries(at) if e.is_dir(follow_symlinks=False) and self.entered(e.name))

    def files(self, at: str, below: bool) -> Iterator[tuple[str, int | None, str | None]]:
        open_ = [at]
        while open_:
            for path, e in self._entries(open_.pop()):
                if not e.is_dir():
                    yield path, e.stat(follow_symlinks=False).st_size, None
                elif below and not e.is_symlink() and self.entered(e.name):
                    open_.append(path)


def _git(root: str, *args: str, **more) -> bytes:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, **more)
    if done.returncode:
        raise OSError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


class _GitReader(_Reader):
    def __init__(self, root: str, rev: str, skipped: frozenset[str], tasks: int):
        super().__init__(root, skipped, tasks)
        self.rev = rev

    def _entries(self, at: str) -> Iterator[tuple[str, str, str, str, str]]:
        """mode, type, object, size and path of what a tree holds."""
        for line in _git(self.root, "ls-tree", "-lz", f"{self.rev}:{at}").split(b"\0"):
            if line:
                head, name = line.decode("utf-8", "replace").split("\t", 1)
                yield (*head.split(), f"{at}/{name}" if at else name)

    def folders(self, at: str) -> list[str]:
        return [path for _, kind, _, _, path in self._entries(at) if kind == "tree" and self.entered(path.rsplit("/", 1)[-1])]

    def files(self, at: str, below: bool) -> Iterator[tuple[str, int | None, str | None]]:
        open_ = [at]
        while open_:
            for mode, kind, oid, size, path in self._entries(open_.pop()):
                if kind == "blob" and mode != "120000":
                    yield path, int(size), oid
                elif kind == "tree" and below and self.entered(path.rsplit("/", 1)[-1]):
                    open_.append(path)


class TreeSource(DataSource):
    """``path``, ``size``, ``oid`` (git only) of the files below ``root``; of the commit ``rev`` if that is given."""

    @classmethod
    def name(cls) -> str:
        return "codeloom_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        skipped = frozenset(x for x in self.options.get("skipped", "").split("|") if x)
        root, rev, tasks = self.options["root"], self.options.get("rev"), int(self.options.get("tasks", "1"))
        return _GitReader(root, rev, skipped, tasks) if rev else _FolderReader(root, skipped, tasks)


def paths(spark: SparkSession, root: str, skipped: list[str], rev: str | None = None) -> DataFrame:
    """path, size, oid of every file below ``root`` but for skipped folders (any case)."""
    spark.dataSource.register(TreeSource)
    read = spark.read.format("codeloom_tree").option("root", root).option("skipped", "|".join(skipped)).option("tasks", str(4 * spark.sparkContext.defaultParallelism))
    if rev:  # one commit for all tasks, also if a branch moves
        read = read.option("rev", _git(root, "rev-parse", "--verify", f"{rev}^{{commit}}").decode().strip())
    return read.load()


def file_bytes(root: str, path: str) -> tuple[bytes | None, str | None]:
    try:
        with open(os.path.join(root, path), "rb") as f:
            return f.read(), None
    except OSError as e:
        return None, str(e)


class _Blobs:
    """Blobs of a git repository from one process for all objects of a task."""

    def __init__(self, root: str):
        self.process = subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def get(self, oid: str) -> tuple[bytes | None, str | None]:
        self.process.stdin.write(oid.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) != 3:
            return None, f"no object {oid}"
        raw = self.process.stdout.read(int(head[2]))
        self.process.stdout.read(1)
        return raw, None

    def close(self):
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()


def contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, size, oid and more) with their bytes: raw and error in place of size and oid. Read in tasks."""
    spark = files.sparkSession
    kept = [c for c in files.columns if c not in ("size", "oid")]
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in kept)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs = None
        try:
            for pdf in batches:
                held, size, start = [], 0, 0
                for i, (path, oid) in enumerate(zip(pdf["path"], pdf["oid"], strict=True)):
                    if oid:
                        blobs = blobs or _Blobs(root)
                        held.append(blobs.get(oid))
                    else:
                        held.append(file_bytes(root, path))
                    size += len(held[-1][0] or b"")
                    if size >= BATCH_BYTES or i + 1 == len(pdf):
                        raw, error = zip(*held, strict=True)
                        yield pdf.iloc[start : i + 1][kept].assign(raw=list(raw), error=list(error))
                        held, size, start = [], 0, i + 1
        finally:
            if blobs:
                blobs.close()

    return files.repartition(tasks, "path").mapInPandas(load, schema + ", raw binary, error string")
