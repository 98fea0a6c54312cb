"""Vector codes and importance resampling against plain versions, on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import resampling, vector_codes
from codeloom.llm.common import join_back
from tests.llm import brute as B
from tests.llm.conftest import SCHEMA, odd_rows

VECTORS = "vec_id long, embedding array<float>, label int, n int, key string, code string"


# -- 12 vector codes -------------------------------------------------------
def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cut = [[v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        chosen = [[near(p, c[p]) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, to in zip(cut, chosen, strict=True) if to[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    chosen = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][to[p]]) for p in range(parts)) for c, to in zip(cut, chosen, strict=True)]
    by = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{t:02x}" for t in to), e, by[label], digest) for (i, _, label), to, e in zip(kept, chosen, errors, strict=True))


def vectors(n, width=16, seed=1, spread=1.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    f = lambda x: float(np.float32(x))
    return [(i, [f(x + spread * rng.gauss(0, 0.3)) for x in rng.choice(centre)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_codes_equal_plain_rounds(spark, spread):
    rows = vectors(700, spread=spread)
    rows += [(None, rows[3][1], 1), (None, None, 1), (701, [], 2), (702, [1.0] * 15 + [None], 2), (703, [float("nan")] * 16, 2), (704, [float("-inf")] + [0.0] * 15, None)]
    rows += [rows[0], rows[0], (1, [0.0] * 16, 1), (710, [1.0] * 24, 1)]  # repeated rows, a repeated id, another length
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS).repartition(3)
    got = Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.VectorCodes(df).report().collect())
    assert got == plain_codes([r for r in rows if r[0] != 710])


def test_few_vectors_and_none(spark):
    rows = vectors(3, 8)
    make = lambda rows: spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS)
    got = Counter(tuple(r) for r in vector_codes.VectorCodes(make(rows)).report().collect())
    assert got == plain_codes(rows)
    assert vector_codes.VectorCodes(make([])).report().count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.VectorCodes(make(vectors(3, 9)))
    with pytest.raises(Exception, match="no exact distance"):
        vector_codes.VectorCodes(make([(1, [1e30] * 8, 1)]))


def test_trees_assign_whole_subtrees(monkeypatch):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-50, 50, (2000, 4)) + c for c in ([0, 0, 0, 0], [5000, 0, 0, 0], [0, 5000, 0, 0])])
    entries = np.array([[0, 0, 0, 0], [5000, 0, 0, 0], [0, 5000, 0, 0], [9000, 9000, 0, 0]])
    order, boxes, sums = vector_codes.build(points)
    assert sorted(order) == list(range(len(points)))
    compared = []
    argmin = np.argmin
    monkeypatch.setattr(vector_codes.np, "argmin", lambda a, axis=None: (compared.append(a.shape[0]), argmin(a, axis=axis))[1])
    chosen, total, count = vector_codes.walk(points[order], boxes, sums, entries)
    far = ((points[order][:, None] - entries[None]) ** 2).sum(2)
    assert (chosen == argmin(far, axis=1)).all() and count.tolist() == [2000, 2000, 2000, 0]
    assert (total == np.array([points[:2000].sum(0), points[2000:4000].sum(0), points[4000:].sum(0), [0] * 4])).all()
    assert sum(compared) < 400  # nodes and leaf points that were compared at all


# -- 13 importance resampling ----------------------------------------------
def plain_resampling(rows, target, max_n=1, percent=10, least=20, buckets=10_000):
    def grams(text):
        w = B.plain_words(text)
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1))

    s, t = Counter(), Counter()
    for x in (text for _, text in rows):
        s += grams(x)[1]
    for x in target:
        t += grams(x)[1]
    size, goal = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, f = grams(text)
        gain = sum(c * math.floor(1000 * math.log((t[b] + 1.0) * (size + buckets) / ((s[b] + 1.0) * (goal + buckets)))) for b, c in f.items())
        weight = gain // sum(f.values()) if f else 0
        h = int(B.sha(f"2024:{'' if i is None else i}")[:8], 16)
        out.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least, None])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize(("max_n", "percent"), [(1, 10), (2, 60), (1, 100)])
def test_resampling_equals_a_plain_version(spark, odd, max_n, percent):
    rows = [(r[0], r[1]) for r in odd_rows()]
    target = ["alpha beta gamma one two", "", None, "É é x", "one TWO"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(odd, bench, percent=percent, max_n=max_n).collect()
    want = plain_resampling(rows, target, max_n, percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(tuple(r[:4]) for r in want)
    assert sorted((r.rank, r.score) for r in got if r.rank) == sorted((r[5], r[3]) for r in want if r[5])  # rows of one id and score in any order
    single = lambda i: i is not None and i != 7
    assert {(r.doc_id, r.rank) for r in got if single(r.doc_id)} == {(r[0], r[5]) for r in want if single(r[0])}


def test_resampling_of_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, none).count() == 0
    assert resampling.resample(odd, none).count() == odd.count()


def test_crc_of_long_and_short_slices():
    raw = np.frombuffer(("é" * 100 + "abc" * 50).encode(), np.uint8)
    begin, end = np.array([0, 0, 3, 5, 10, 200]), np.array([0, 1, 7, 69, 75, 350])
    assert resampling.crc32_of(raw, begin, end).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(begin, end, strict=True)]


def test_hot_keys_are_joined_without_a_shuffle_of_theirs(spark):
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1L ELSE id END AS key", "id")
    table = rows.groupBy("key").count().selectExpr("key", "count AS n", "key * 2 AS twice")
    got = join_back(rows, table, ["key"], "n", 30_000)
    assert got.count() == 30_000 and got.filter("twice <> 2 * key OR twice IS NULL").count() == 0
    assert set(got.columns) == {"key", "id", "twice"}


def test_resampling_gathers_no_copies(spark):
    rows = [(i, "the same text " * 10) for i in range(300)] + [(1000 + i, f"text {i} " * 12) for i in range(100)]
    got = resampling.resample(spark.createDataFrame([(*r, None, None, *["x", None, 5, "y", "z", None, 7, "w"]) for r in rows], SCHEMA), spark.createDataFrame([(1, "same")], "item_id long, text string"))
    assert Counter((r.doc_id, r.rank) for r in got.collect()) == Counter((r[0], r[5]) for r in plain_resampling(rows, ["same"]))
