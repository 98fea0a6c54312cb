"""Removal of shared passages against a plain version: odd rows, branches, copies, repeats within a text."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from codeloom.llm import substring_dedup as S
from codeloom.llm.textscan import SAME, SPACE, words_of
from tests.llm import brute as B
from tests.llm.conftest import SCHEMA, odd_rows, prose

TAIL = ("x", None, 5, "y", "z", None, 7, "w")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows, k):
    least = defaultdict(lambda: S._LAST)
    big = lambda i: S._LAST if i is None else i
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            least[g] = min(least[g], big(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - k + 1) if least[tuple(w[p : p + k])] < big(i) for q in range(p, p + k)}
        out.append((i, len(w), len(gone), B.sha(" ".join(x for q, x in enumerate(w) if q not in gone))))
    return Counter(out)


def run(spark, rows, k, **options):
    df = spark.createDataFrame([(i, t, None, None, *TAIL) for i, t in rows], SCHEMA).repartition(3)
    return S.SubstringDedup(df, k, **options).removals()


def test_odd_rows(spark, odd):
    rows = [(r[0], r[1]) for r in odd_rows()]
    shared = prose(40, 75)
    rows += [(30 + i, f"{prose(50 + i, 30)} {shared} {prose(60 + i, i * 7)}") for i in range(6)] + [(40, shared.upper()), (41, shared[:200]), (42, shared.replace(" ", "\n  "))]
    got = run(spark, rows, 50)
    assert Counter(tuple(r)[:4] for r in got.collect()) == plain(rows, 50)


@pytest.mark.parametrize("seed", range(2))
def test_branches_and_chimeras(spark, seed):
    """Texts glued from a few passages, so that paths fork, join, repeat and overlap in one text."""
    rng = random.Random(seed)
    stock = [" ".join(rng.choice("abcd") + str(rng.randrange(9)) for _ in range(rng.choice([4, 9, 20, 45]))) for _ in range(12)]
    rows = [(rng.choice([*range(60), None]), " ".join(rng.choice([*stock, f"u{rng.random()}", f"u{rng.random()}"]) for _ in range(rng.randrange(1, 14)))) for _ in range(120)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (70, "z " * 40), (71, "z " * 13), (72, ("y z " * 20))]
    for k, options in ((8, {}), (12, {"anchor": 2}), (1, {})):
        got = run(spark, rows, k, **options).collect()
        assert Counter(tuple(r)[:4] for r in got) == plain(rows, k), (k, options)
    texts = defaultdict(set)
    for i, t in rows:
        texts[S._LAST if i is None else i].add(tuple(words(t)))
    # every passage reads the same at its source
    for r in got:
        for p in r.passages:
            n = p.windows + k - 1
            own = {w[p.start : p.start + n] for w in texts[S._LAST if r.doc_id is None else r.doc_id] if len(w) == r.n_words}
            there = {w[p.source_start : p.source_start + n] for w in texts[p.source_doc]}
            assert own & there and p.source_doc < (S._LAST if r.doc_id is None else r.doc_id)


def test_copies_become_one_passage(spark):
    text = prose(5, 400)
    rows = [(i, text) for i in range(5)]
    got = {r.doc_id: r for r in run(spark, rows, 50).collect()}
    assert [(p.start, p.windows, p.source_doc, p.source_start) for p in got[3].passages] == [(0, 351, 0, 0)]
    assert not got[0].passages and (got[0].n_removed, got[3].n_removed) == (0, 400)
    # where another text leaves the path, the path ends
    rows.append((9, prose(6, 100) + " " + " ".join(words(text)[100:300])))
    got = {r.doc_id: r for r in run(spark, rows, 50).collect()}
    ends = [(p.start, p.start + p.windows) for p in sorted(got[3].passages)]
    assert len(ends) == 3 and (ends[0][0], ends[2][1]) == (0, 351) and ends[0][1] == ends[1][0] and ends[1][1] == ends[2][0]
    assert (got[0].n_removed, got[3].n_removed, got[9].n_removed) == (0, 400, 200)


def test_pieces_tile_all_windows():
    texts = [prose(3, 500), "a b", None, "w " * 130, prose(4, 50), prose(4, 49)]
    found = words_of(pa.array(texts), SPACE, fold=SAME)
    start, count, _, _ = S.cut_pieces(found, 50, 17)
    covered = [p for a, n in zip(start.tolist(), count.tolist(), strict=True) for p in range(a, a + n)]
    assert covered == [int(found.first[i]) + p for i in range(len(texts)) for p in range(len(words(texts[i])) - 49)]
    assert count.max() <= 50 - 17 + 1


def test_empty_table(spark, empty):
    assert S.SubstringDedup(empty).removals().count() == 0
