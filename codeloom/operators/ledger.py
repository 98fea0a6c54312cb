"""A ledger of model answers in the shared folder, so that no answered prompt is asked again.

The key of a prompt is a hash of its id, its text and the temperature. Prompts whose key the ledger's table has are not
asked (an anti-join). The others are dealt over tasks by key; a task writes each answer to a file of its own under ``pending``
(written beside it and renamed) before it asks the next prompt, and asks none whose file is there. So a task that is run again, or a job after a lost driver,
goes on where the last one ended; only the call that was on its way is made again, and two attempts of one task at the same time (speculation) may both make it.
``compact`` moves what is pending to the table. An answer whose call took ``SYNCED`` seconds or more is forced to the disk before the next
prompt; a faster one is left to the file system, so a machine's crash (not a task's or a process's) may cost that call again.

Rate: the budget of calls a minute is shared evenly by the tasks, so all of them together keep to it.

Defined cases: equal rows are asked once; a null prompt is asked as an empty one, a null id as itself; errors are
returned and not kept, so a later run asks again.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import stable_id
from codeloom.operators.prompts import call_with_retry
from codeloom.plans.staging import cut
from codeloom.sources import tree

ANSWERS = "key string, answer string"
#: Seconds of a call from which its answer is forced to the disk at once.
SYNCED = 0.05


class Ledger:
    """``root``: a folder that the driver and all executors see by this path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.removeprefix("file://")
        self.pending, self.table = os.path.join(self.root, "pending"), os.path.join(self.root, "answers")
        os.makedirs(self.pending, exist_ok=True)

    def answers(self) -> DataFrame:
        """key, answer of the table, without what is pending."""
        if not os.path.isdir(self.table):
            return self.spark.createDataFrame([], ANSWERS)
        return self.spark.read.schema(ANSWERS).parquet("file://" + self.table).dropDuplicates(["key"])  # a key is twice where ``compact`` was cut off

    def ask(self, prompts: DataFrame, id_col: str, client: Callable[[str, float], str], temperature: float, per_minute: float | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
        """``id_col``, answer, error for each row of ``prompts`` (``id_col``, prompt)."""
        own = prompts.select(F.col(id_col), F.coalesce("prompt", F.lit("")).alias("prompt"))
        own = own.withColumn("key", stable_id(F.lit(temperature), F.col(id_col).isNull(), F.col(id_col), F.col("prompt")))
        known = self.answers()
        tasks = self.spark.sparkContext.defaultParallelism
        pause, pending = (60.0 * tasks / per_minute if per_minute else 0.0), self.pending

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last = -pause
            for pdf in batches:
                rows = []
                for key, prompt in zip(pdf["key"], pdf["prompt"], strict=True):
                    answer = _kept(pending, key)
                    error = None
                    if answer is None:
                        sleep(max(0.0, last + pause - time.monotonic())) if pause else None
                        last = began = time.monotonic()
                        try:
                            answer = call_with_retry(client, prompt, temperature, sleep)
                        except Exception as e:
                            error = str(e)
                        else:
                            _keep(pending, key, answer, time.monotonic() - began >= SYNCED)
                    rows.append((key, answer, error))
                yield pd.DataFrame(rows, columns=["key", "answer", "error"])

        open_ = own.select("key", "prompt").dropDuplicates(["key"]).join(known, "key", "left_anti")
        asked = cut(open_.repartition(tasks, "key").mapInPandas(run, ANSWERS + ", error string"))
        found = known.withColumn("error", F.lit(None).cast("string")).unionByName(asked)
        return own.join(found, "key", "left").select(id_col, "answer", "error")

    def compact(self) -> None:
        """Move pending answers to the table: written first, removed then."""
        files = cut(tree.paths(self.spark, self.pending, []).filter(F.col("path").endswith(".json")))
        raw = tree.contents(files, self.pending)
        read = F.from_json(F.decode("raw", "UTF-8"), ANSWERS)
        rows = raw.filter("raw is not null").select(read.alias("a")).select("a.*").filter("key is not null")
        if files.isEmpty():
            return
        rows.write.mode("append").parquet("file://" + self.table)
        pending = self.pending

        def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for path in pdf["path"]:
                    try:
                        os.remove(os.path.join(pending, path))
                    except FileNotFoundError:  # by an earlier attempt
                        pass
                yield pdf[["path"]]

        files.mapInPandas(remove, "path string").write.format("noop").mode("overwrite").save()


def _place(pending: str, key: str) -> str:
    return os.path.join(pending, key[:2], key + ".json")


def _kept(pending: str, key: str) -> str | None:
    try:
        with open(_place(pending, key), encoding="utf-8") as f:
            return json.load(f)["answer"]
    except (FileNotFoundError, ValueError):  # a file that a crash left without its text is no answer
        return None


def _keep(pending: str, key: str, answer: str, sync: bool = True) -> None:
    at = _place(pending, key)
    beside, text = f"{at}.{uuid.uuid4().hex}", json.dumps({"key": key, "answer": answer})
    try:
        f = open(beside, "w", encoding="utf-8")
    except FileNotFoundError:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        f = open(beside, "w", encoding="utf-8")
    with f:
        f.write(text)
        f.flush()
        if sync:
            os.fsync(f.fileno())
    os.replace(beside, at)
