"""Model answers survive tasks and drivers."""

import os

import pytest

from codeloom.operators import ledger as L
from codeloom.operators.prompts import ModelError


class Client:
    """Notes each call in a file; ``fail`` lists prompts that are errors of the model, ``die`` those that end the process's task."""

    def __init__(self, log, fail=(), die=()):
        self.log, self.fail, self.die = str(log), fail, die

    def __call__(self, prompt, temperature):
        if prompt in self.die:
            raise SystemExit("lost")
        with open(self.log, "a") as f:
            f.write(prompt + "\n")
        if prompt in self.fail:
            raise ModelError(400, "refused")
        return f"{prompt}!"

    def calls(self):
        return sorted(open(self.log).read().split()) if os.path.exists(self.log) else []


def asked(spark, n=20):
    return spark.createDataFrame([(str(i), f"p{i}") for i in range(n)], "id string, prompt string")


def test_a_lost_task_asks_nothing_twice(spark, tmp_path):
    prompts, ledger = asked(spark), L.Ledger(spark, str(tmp_path / "l"))
    with pytest.raises(Exception):
        ledger.ask(prompts, "id", Client(tmp_path / "log", die=["p7"]), 0.4).collect()
    before = Client(tmp_path / "log").calls()
    assert "p7" not in before
    got = {r.id: r.answer for r in L.Ledger(spark, str(tmp_path / "l")).ask(prompts, "id", Client(tmp_path / "log"), 0.4).collect()}
    assert got == {str(i): f"p{i}!" for i in range(20)}
    assert Client(tmp_path / "log").calls() == sorted(f"p{i}" for i in range(20))


def test_answers_stay_and_errors_are_asked_again(spark, tmp_path):
    prompts, ledger, log = asked(spark, 6), L.Ledger(spark, "file://" + str(tmp_path / "l")), tmp_path / "log"
    first = {r.id: (r.answer, r.error) for r in ledger.ask(prompts, "id", Client(log, fail=["p2"]), 0.4).collect()}
    assert first["2"] == (None, "refused") and first["1"] == ("p1!", None)
    ledger.compact()
    assert ledger.answers().count() == 5 and not [f for _, _, fs in os.walk(ledger.pending) for f in fs]
    ledger.compact()
    more = prompts.union(spark.createDataFrame([("1", "p1"), ("1", "new"), (None, None)], prompts.schema))
    got = sorted((r.id or "", r.answer, r.error) for r in ledger.ask(more, "id", Client(log), 0.4).collect())
    assert got == sorted([("", "!", None), ("1", "new!", None), ("1", "p1!", None), *[(str(i), f"p{i}!", None) for i in range(6)]])
    calls = Client(log).calls()
    assert [calls.count(p) for p in ("p1", "p2", "new")] == [1, 2, 1]
    assert ledger.ask(prompts.limit(0), "id", Client(log), 0.4).count() == 0
    ledger.ask(prompts, "id", Client(log), 0.9).count()  # another temperature is another question
    assert Client(log).calls().count("p1") == 2


def test_a_cut_off_compaction_keeps_one_answer(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path / "l"))
    ledger.ask(asked(spark, 4), "id", Client(tmp_path / "log"), 0.4).count()
    spark.createDataFrame([(f[:-5], "p!") for _, _, fs in os.walk(ledger.pending) for f in fs], L.ANSWERS).write.parquet(ledger.table)
    ledger.compact()
    assert ledger.spark.read.parquet(ledger.table).count() == 8 and ledger.answers().count() == 4


def test_tasks_keep_to_the_rate(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path / "l"))
    log = str(tmp_path / "waits")

    def sleep(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    ledger.ask(asked(spark), "id", Client(tmp_path / "log"), 0.4, per_minute=6, sleep=sleep).count()
    slept = [float(x) for x in open(log).read().split()]
    tasks = spark.sparkContext.defaultParallelism
    assert len(slept) == 20 and sum(x > 0.9 * 60 * tasks / 6 for x in slept) >= 20 - tasks


def test_a_file_without_its_text_is_no_answer(spark, tmp_path):
    prompts, ledger, log = asked(spark, 5), L.Ledger(spark, str(tmp_path / "l")), tmp_path / "log"
    ledger.ask(prompts, "id", Client(log), 0.4).count()
    files = [os.path.join(d, f) for d, _, fs in os.walk(ledger.pending) for f in fs]
    open(files[0], "w").close()
    got = {r.id: r.answer for r in ledger.ask(prompts, "id", Client(log), 0.4).collect()}
    assert got == {str(i): f"p{i}!" for i in range(5)} and len(Client(log).calls()) == 6
    open(files[1], "w").close()
    ledger.compact()
    assert ledger.answers().count() == 4


def test_only_slow_calls_are_forced_to_the_disk(tmp_path, monkeypatch):
    synced = []
    monkeypatch.setattr(L.os, "fsync", synced.append)
    L._keep(str(tmp_path), "aa1", "x", False)
    assert L._kept(str(tmp_path), "aa1") == "x" and not synced
    L._keep(str(tmp_path), "aa2", "y")
    assert L._kept(str(tmp_path), "aa2") == "y" and len(synced) == 1
