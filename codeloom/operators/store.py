"""Tables as Parquet folders: append, update by id, delete with children, replace by repository.

A table is a list of folders, each written once and tagged with the run that it belongs to (or with none).
One manifest names the folders of all tables; a change writes new folders for what it touches and then
the next manifest, so a reader sees all of a change or nothing, and a failed write changes nothing. A writer
that finds another's manifest in its place puts its change on top of it if both touch different runs only, and
fails else (:class:`Conflict`). Replacing or deleting a run drops its folders unread; an update rewrites the
folders that hold its rows. ``vacuum`` removes what no kept manifest names, folders of failed writers too.

Manifests are published by renaming a draft to a name that must not exist, which file systems with an atomic rename
(local, HDFS) refuse to the second writer; on object stores without one, use a single writer.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.errors import NotFound
from codeloom.plans.staging import cut
from codeloom.schemas import REFERENCES, TABLES

RUNS = "analysis_runs"
#: table -> folders, each {"path": below the store's root, "run": id or None}
Manifest = dict[str, list[dict]]


class Conflict(RuntimeError):
    """Another writer changed what this change is about; nothing was published."""


def _runs_touched(before: Manifest, after: Manifest) -> set:
    """Tags of the folders that came or went."""
    out = set()
    for table in {*before, *after}:
        old, new = ({(f["path"], f["run"]) for f in m.get(table, [])} for m in (before, after))
        out |= {run for _, run in old ^ new}
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests --------------------------------------------------------
    def _numbers(self) -> list[int]:
        at = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int | None = None) -> tuple[int, Manifest]:
        """The latest manifest, or one by number; 0 and nothing for a new store."""
        number = max(self._numbers(), default=0) if number is None else number
        if not number:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{number:012d}.json"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, manifest: Manifest) -> bool:
        """Write the manifest of that number, unless there is one."""
        draft = self._path(f"{self.root}/_manifests/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        goal = self._path(f"{self.root}/_manifests/{number:012d}.json")
        try:
            done = not self._fs.exists(goal) and self._fs.rename(draft, goal)
        except Exception:  # some file systems raise where others refuse
            done = False
        if not done:
            self._fs.delete(draft, False)
        return done

    def _commit(self, number: int, base: Manifest, changed: Manifest, clear: Callable[[Manifest], bool] = lambda m: True) -> None:
        """Publish ``changed``, made from ``base`` (manifest ``number``), on top of what others have published since.

        Changes of other runs than ours are kept; where both touch a run, or untagged rows, ours fails. ``clear`` tells
        whether a change still means the same on a later manifest.
        """
        ours, onto = _runs_touched(base, changed), base
        while not self._publish(number + 1, changed):
            number, latest = self._manifest()
            theirs = _runs_touched(onto, latest)
            if ours & theirs or None in ours | theirs or not clear(latest):
                raise Conflict("another writer changed the same runs; try again")
            changed = {t: [f for f in latest.get(t, []) if f in changed.get(t, []) or f not in onto.get(t, [])] + [f for f in changed.get(t, []) if f not in onto.get(t, [])] for t in {*latest, *changed}}
            onto = latest

    def _written(self, table: str, rows: DataFrame, run: str | None) -> dict:
        path = f"{table}/{uuid.uuid4().hex}"
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[table]])
        shaped.write.mode("error").parquet(f"{self.root}/{path}")
        return {"path": path, "run": run}

    # -- reading ----------------------------------------------------------
    def _read(self, table: str, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{f['path']}" for f in folders])

    def table(self, table: str, run: str | None = None) -> DataFrame:
        """All rows; with ``run`` only the folders that may hold that run's rows are read."""
        folders = self._manifest()[1].get(table, [])
        return self._read(table, [f for f in folders if run is None or f["run"] in (None, run)])

    def get(self, table: str, row_id: str):
        """The row with the id, or None."""
        return self.table(table).filter(F.col("id") == row_id).limit(1).first()

    # -- changes ----------------------------------------------------------
    def insert(self, table: str, rows: DataFrame, run: str | None = None) -> None:
        number, manifest = self._manifest()
        self._commit(number, manifest, {**manifest, table: [*manifest.get(table, []), self._written(table, rows, run)]})

    def _holding(self, table: str, folders: list[dict], column: str, keys: DataFrame) -> list[dict]:
        """The folders with a row whose ``column`` is among the ids ``keys``."""
        if not folders:
            return []
        rows = self._read(table, folders).select(F.col(column).alias("id"), F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("folder"))
        found = {r["folder"] for r in rows.join(keys, "id", "left_semi").select("folder").distinct().collect()}
        return [f for f in folders if f["path"].rsplit("/", 1)[-1] in found]

    def _rewritten(self, table: str, folders: list[dict], change) -> list[dict]:
        """New folders, one for each tag, with ``change`` applied to the rows of the old ones."""
        return [self._written(table, change(self._read(table, [f for f in folders if f["run"] == run])), run) for run in dict.fromkeys(f["run"] for f in folders)]

    def update(self, table: str, changes: DataFrame, fixed: tuple[str, ...] = ("id", "repository_path", "created_at")) -> None:
        """Patch rows by id: only non-null fields of ``changes`` overwrite, ``fixed`` ones never do."""
        number, manifest = self._manifest()
        folders = manifest.get(table, [])
        touched = self._holding(table, folders, "id", changes.select("id"))
        if touched:
            new = self._rewritten(table, touched, lambda rows: patched(rows, changes, fixed))
            self._commit(number, manifest, {**manifest, table: [f for f in folders if f not in touched] + new})

    def delete(self, table: str, ids: DataFrame, must_exist: bool = False) -> None:
        """Delete rows by id (column id) and all rows below them."""
        number, manifest = self._manifest()
        gone = cut(ids.select("id").distinct())
        if must_exist and not self._holding(table, manifest.get(table, []), "id", gone):
            raise NotFound(f"no such row in {table}")
        self._commit(number, manifest, self._without(manifest, table, gone))

    def _without(self, manifest: Manifest, table: str, gone: DataFrame) -> Manifest:
        """The manifest after the rows of ``gone`` and everything below them went."""
        out = dict(manifest)
        if table == RUNS:  # their own folders go unread
            runs = {r["id"] for r in gone.collect()}  # as many as the caller names, or repositories have
            out = {t: [f for f in folders if f["run"] not in runs] for t, folders in out.items()}
        lost = cascade(lambda t: self._read(t, out[t]) if out.get(t) else None, table, gone)
        for name, ids in lost.items():
            touched = self._holding(name, out.get(name, []), "id", ids)
            if touched:
                new = self._rewritten(name, touched, lambda rows, ids=ids: rows.join(ids, "id", "left_anti").select(*rows.columns))
                out[name] = [f for f in out[name] if f not in touched] + new
        return out

    def replace_run(self, run: DataFrame, tables: dict[str, DataFrame]) -> None:
        """Put a run in place of all runs of the same repository (path in any case), with its tables."""
        number, manifest = self._manifest()
        own = run.select("id", F.lower("repository_path").alias("_path")).first()
        same = lambda m: self._read(RUNS, m.get(RUNS, [])).filter(F.lower("repository_path") == own["_path"]).select("id")
        old = cut(same(manifest))
        out = self._without(manifest, RUNS, old)
        for table, rows in {RUNS: run, **tables}.items():
            out[table] = [*out.get(table, []), self._written(table, rows, own["id"])]
        # a run of the repository that another writer has put since would stay beside ours
        self._commit(number, manifest, out, lambda latest: same(latest).join(old, "id", "left_anti").isEmpty())

    def vacuum(self, keep: int = 2, grace_seconds: float = 86_400) -> int:
        """Remove folders that none of the last ``keep`` manifests names, and older manifests; returns how many folders went.

        Folders that no manifest ever named (of writers that failed, or have yet to publish) go after ``grace_seconds``.
        """
        numbers = self._numbers()
        kept = {f["path"] for n in numbers[-keep:] for folders in self._manifest(n)[1].values() for f in folders}
        old = {f["path"] for n in numbers[:-keep] for folders in self._manifest(n)[1].values() for f in folders} - kept
        late = (time.time() - grace_seconds) * 1000
        for table in TABLES:
            at = self._path(f"{self.root}/{table}")
            found = self._fs.listStatus(at) if self._fs.exists(at) else []
            old |= {p for f in found if f.getModificationTime() <= late and (p := f"{table}/{f.getPath().getName()}") not in kept}
        for path in old:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{n:012d}.json"), False)
        return len(old)


def patched(old: DataFrame, changes: DataFrame, fixed: tuple[str, ...] = ("id",), key: str = "id") -> DataFrame:
    """``old`` with the non-null fields of ``changes`` (at most one row per key)."""
    named = [c for c in changes.columns if c != key and c in old.columns and c not in fixed]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in named])
    joined = old.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in named else F.col(c) for c in old.columns])


def cascade(read: Callable[[str], DataFrame | None], table: str, ids: DataFrame, references: list[tuple[str, str, str]] | None = None) -> dict[str, DataFrame]:
    """Ids, by table, of all rows that go when the rows ``ids`` of ``table`` go: a fixpoint over the graph of references.

    A round follows every reference from the ids that were new in the last one; a table may be reached by several
    references, over ways of different lengths, or refer to itself. ``read`` gives None for a table that is not there.
    """
    references = REFERENCES if references is None else references
    gone = {table: cut(ids.select("id").distinct())}
    fresh = dict(gone)
    while fresh:
        found: dict[str, DataFrame] = {}
        for child, column, parent in references:
            rows = read(child) if parent in fresh else None
            if rows is not None:
                hit = rows.join(fresh[parent].select(F.col("id").alias(column)), column, "left_semi").select("id")
                found[child] = found[child].union(hit) if child in found else hit
        fresh = {}
        for child, hit in found.items():
            new = hit.distinct()
            new = cut(new.join(gone[child], "id", "left_anti") if child in gone else new)
            if not new.isEmpty():
                fresh[child] = new
                gone[child] = gone[child].union(new) if child in gone else new
    return gone


def without(read: Callable[[str], DataFrame], table: str, ids: DataFrame, references: list[tuple[str, str, str]] | None = None) -> dict[str, DataFrame]:
    """The tables that lose rows when the rows of ``ids`` go, without them."""
    return {name: read(name).join(gone, "id", "left_anti") for name, gone in cascade(read, table, ids, references).items()}
