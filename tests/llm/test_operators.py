"""The operators against plain versions, on odd tables: nulls, empties, long texts, ties, repeats, clashing names."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import components as C
from codeloom.llm import decontam, exact_dedup, fixity, langid, mixing, ngram_join, pii, suffix_lm, token_counts, url_equiv
from tests.llm import brute as B
from tests.llm.conftest import SCHEMA, odd_rows, prose

ROWS = [(r[0], r[1]) for r in odd_rows()]


def key(r):
    return tuple((x is None, x) for x in r)


# -- 1 exact dedup ---------------------------------------------------------
def test_exact_dedup(spark, odd):
    got = exact_dedup.exact_dedup(odd, exact_dedup.new_index(spark, buckets=4)).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), B.sha(t or "")) for i, t in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_the_index_remembers_batches(spark, odd, empty):
    index = exact_dedup.new_index(spark, buckets=4)
    exact_dedup.exact_dedup(odd.filter("doc_id <= 5"), index)
    again = exact_dedup.exact_dedup(odd, index).collect()
    before = {t or "" for i, t in ROWS if i is not None and i <= 5}
    assert {r.text_sha256 for r in again if r.known} == {B.sha(t) for t in before}
    assert not any(r.kept for r in again if r.known)
    assert len({r.text_sha256 for r in again if r.kept}) == len({t or "" for _, t in ROWS} - before)
    assert index.read().count() == len({t or "" for _, t in ROWS})
    sizes = Counter(B.sha(t or "") for i, t in ROWS) + Counter(B.sha(t or "") for i, t in ROWS if i is not None and i <= 5)
    assert all(r.group_size == sizes[r.text_sha256] for r in again)
    assert exact_dedup.exact_dedup(empty, index).count() == 0
    fresh = exact_dedup.DigestIndex(spark, index.path)  # a new session finds the files, and how they are bucketed
    assert fresh.buckets == 4 and fresh.read().count() == index.read().count()
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, index.path, 8)
    side = odd.select(exact_dedup.digest_of("text").alias("digest")).repartition(4, "digest")
    plan = side.join(fresh.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # that of the batch


def test_keep_first(spark, odd, empty):
    kept = exact_dedup.keep_first(odd, exact_dedup.new_index(spark, buckets=4))
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert Counter(r.text or "" for r in rows) == Counter({t or "" for _, t in ROWS})
    assert next(r.doc_id for r in rows if r.text == ROWS[5][1]) == 7
    assert exact_dedup.keep_first(empty, exact_dedup.new_index(spark, buckets=4)).count() == 0


# -- 2 fixity --------------------------------------------------------------
def pages(spark, rows):
    return fixity.page_records(spark.createDataFrame(rows, "page_id long, url string, html string, hash string"))


def test_fixity_locates_damage(spark):
    rows = [(i, f"u{i}", "x" * i, "h") for i in range(500)]
    good = fixity.MerkleTree(pages(spark, rows), width=8, fanout=4)
    same = fixity.MerkleTree(pages(spark, rows[::-1]), width=8, fanout=4)
    assert good.root() == same.root() and fixity.differing(good, same) is None
    assert fixity.audit(good, same).filter("not intact").count() == 0
    bad = [r for r in rows if r[0] != 300]
    bad[7] = (7, "u7", "damaged", "h")
    bad.append((1000, "new", "page", "h"))
    other = fixity.MerkleTree(pages(spark, bad), width=8, fanout=4)
    found = {r.node: r.damaged for r in fixity.audit(good, other).filter("not intact").collect()}
    own = lambda i: len(f"WARC/1.0..WARC-Type: resource..WARC-Record-ID: <urn:page:{i}>..WARC-Target-URI: u{i}..Content-Length: {i}........") + i
    at = lambda i: sum(own(k) for k in range(i))
    assert found == {0: f"7:{at(7)}:corrupt", 37: f"300:{at(300)}:missing", 125: "1000:-:extra"}


def test_fixity_of_odd_rows(spark):
    rows = [(None, None, None, None), (1, "a", "b", None), (1, "a", "b", None), (1, "a", "c", None)]
    tree = fixity.MerkleTree(pages(spark, rows))
    assert fixity.differing(tree, fixity.MerkleTree(pages(spark, rows))) is None
    assert fixity.differing(tree, fixity.MerkleTree(pages(spark, rows[:2] + rows[3:]))) is not None  # one repeat less
    none = fixity.MerkleTree(pages(spark, []))
    assert none.root() is None and fixity.audit(none, none).count() == 0
    assert fixity.audit(tree, none).filter("not intact").count() == 2


def test_fixity_spreads_records_without_id(spark):
    rows = [(None, f"u{i}", "x" * i, "h") for i in range(200)] + [(i, "u", "x", "h") for i in range(40)]
    tree = fixity.MerkleTree(pages(spark, rows), width=8, fanout=4)
    assert max(r["count"] for r in tree.records.filter("id is null").groupBy("node").count().collect()) < 20
    bad = [(None, "u3", "y", "h") if r[1] == "u3" else r for r in rows]
    found = fixity.audit(tree, fixity.MerkleTree(pages(spark, bad), width=8, fanout=4)).filter("not intact").collect()
    assert 1 <= len(found) <= 2 and all(r.node < 0 for r in found)
    whole = tree.ranges().orderBy("node").collect()
    assert [r.first_offset for r in whole] == [sum(x.bytes for x in whole[:k]) for k in range(len(whole))]


# -- 3 personal data -------------------------------------------------------
TEXTS = [
    "mail a.b+c@x-y.co.uk_z@q.org, a@b", "1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.2", "4337 1665-9846 4399 and 4337166598464390", "+1 (988) 555-2485. +49 30 1 +1-2",
    "\x01\x02a@b.c\x01", "a@b.c" + ".d" * 3000, "a" * 3000 + "@", "1" * 5000, "+" * 50 + "1234567890123", "card 378282246310005 13 digits 4222222222222",
    "IBAN: DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not GB82WEST12345698765431", "my SSN is 123-45-6789 but 123-45-6789 is alone here far away from any such word indeed", "é𝔘 x@y.de é",
]


def test_pii_base_spans(spark, odd):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(TEXTS)]
    rng = random.Random(3)
    rows += [(200 + i, "".join(rng.choice("a1.@+- ()é5\x014") for _ in range(300))) for i in range(150)]
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        spans = B.base_spans(t)
        n = Counter(s[2] for s in spans)
        want.add((i, B.sha(",".join(f"{k}:{a}:{e}" for a, _, k, e in spans)), n["email"], n["ip"], n["card"], n["phone"]))
    assert got == want


def test_pii_added_kinds_and_scores(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    assert spans[10] == "iban:6:33,iban:37:59"
    assert spans[11] == "ssn:10:21,ssn:26:37"  # the word is within 40 code points of both
    scores = {r.doc_id: r.scores for r in pii.pii_report(df).collect()}
    assert scores[10].split(",")[0].endswith(":1.0") and scores[2].split(",")[0].startswith("card:0:19:0.8")


def test_pii_context_reaches_over_other_spans(spark, odd, empty):
    texts = [
        "ssn 123-45-6789, 123-45-6788", "123-45-6789 is my ssn", "123-45-6789" + "." * 40 + " ssn", "ssn" + "." * 50 + "123-45-6789", "ssn " + " ".join(f"123-45-{6000 + i}" for i in range(200)),
        " ".join(f"a{i}@b.c ssn 123-45-{6000 + i}" for i in range(300)),
    ]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)]
    spans = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string, found string, parts_ssn string")).collect()}
    for i, t in enumerate(texts):
        want = []
        for m in re.finditer(r"(?<![0-9-])123-45-[0-9]{4}(?![0-9-])", t):
            near = [t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 40]]
            want += [f"ssn:{m.start()}:{m.end()}"] * any(re.search("(?:^|[^a-z])ssn", x) for x in near)
        assert [x for x in spans[i].split(",") if x.startswith("ssn")] == want
    assert pii.pii_report(empty).count() == 0
    assert pii.pii_report(odd).count() == len(ROWS)


# -- 4 language ID ---------------------------------------------------------
def test_language_id_learns_and_judges(spark):
    rng = random.Random(5)
    words = {"en": "the and of with house water light".split(), "de": "der und für wärme schön licht haus".split(), "xx": "zzq qqz kkw wwk vvx".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.choice([3, 30]))), lang) for i in range(600) for lang in [rng.choice([*words])]]
    rows += [(1000, "123 !!!", "en"), (1001, None, "en"), (1002, "THE HOUSE", None), (None, "der und für", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, sample_docs=300)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and B.rest(r[0]) == 0]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.98 * len(held)
    assert all(got[i].held_out == (B.rest(i) == 0) for i in got)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.subtract(kept).collect()} == {1000, 1001}
    foreign = spark.createDataFrame([(1, "Ελληνικά γράμματα", None), (2, "the house and the water", None), (3, "der und für wärme", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.accepted(foreign, model).collect()] == [2, 3]
    assert [r.doc_id for r in langid.accepted(foreign, model, langs=["de"]).collect()] == [3]
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, max_langs=2)


def test_language_id_without_data(odd, empty):
    assert langid.train(empty) is None
    assert langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    model = langid.train(odd)
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(odd, model).collect()}
    assert got == {(i, not any(c.isalpha() for c in t or "")) for i, t in ROWS}


def test_calibration_and_sparsity():
    import numpy as np

    logits = np.array([[4.0, 0], [4, 0], [0, 4], [4, 0]])
    t = langid.temperature(logits, np.array([0, 0, 1, 1]))
    assert abs(1 / (1 + np.exp(-4 / t)) - (0.75 * 5 / 6 + 0.25 / 6)) < 0.01  # labels are smoothed by a sixth
    sure = langid.temperature(np.array([[4.0, 0], [0, 4]] * 50), np.array([0, 1] * 50))
    assert abs(1 / (1 + np.exp(-4 / sure)) - 101 / 102) < 0.001
    w, _ = langid.ftrl([(np.array([1, 2]), np.array([1.0, 1e-6]), 0), (np.array([3]), np.array([1.0]), 1)] * 20, 2)
    assert w[1, 0] > 0 > w[1, 1] and not w[2].any() and not w[9].any()


# -- 5 mixing --------------------------------------------------------------
def test_mix(spark, odd, empty):
    rows = mixing.fair_mix(odd).collect()
    assert len(rows) == len(ROWS)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(B.spaces(t))) for i, t in ROWS)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = B.targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] for r in rows)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert sorted(rows, key=key) == sorted(mixing.fair_mix(odd.repartition(7)).collect(), key=key)
    assert mixing.fair_mix(empty).count() == 0
    assert {r.taken for r in mixing.fair_mix(odd.filter("text is null")).collect()} == {0}


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randint(5, 60)), f"s{min(int(rng.expovariate(0.7)), 6)}") for i in range(3000)]
    got = mixing.fair_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, total = defaultdict(int), {}, 0
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        total += r.size
    assert all(abs(taken[s] - target[s]) <= 61 for s in target)
    assert total - 60 <= sum(taken.values()) <= total


def plain_mix(rows, seed="mix", repeats=3):
    """{row index: copies}, by sorting the whole queue."""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(B.spaces(t))
    goal, rank = B.targets(sizes), {s: k for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    queue = []
    for s in sizes:
        own = sorted((int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:12], 16), i, len(B.spaces(t)), k) for k, (i, t, x) in enumerate(rows) if x == s)
        upto = 0
        for _, _, n, k in own:
            upto += n
            queue += [((upto + c * sizes[s]) / goal[s], rank[s], upto, n, k) for c in range(repeats) if n and c + 1 <= math.ceil(goal[s] / sizes[s]) + 1]
    drawn, copies = 0, Counter()
    for *_, n, k in sorted(queue):
        drawn += n
        if drawn > sum(sizes.values()):
            break
        copies[k] += 1
    return copies


@pytest.mark.parametrize("few", [50_000, 5])
def test_mix_takes_the_head_of_the_queue(spark, monkeypatch, few):
    """Sources of sizes like 13,500, 4,000 and 42,500: the last is over five times its target."""
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "BINS", 7 if few == 5 else 1024)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, "w " * (1 + i % 3), "a" if i < 135 else "b" if i < 175 else None) for i in range(600)]
    want = plain_mix(rows)
    got = mixing.fair_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.copies for r in got} == {i: want[i] for i in range(600)}
    assert max(r.source_size / r.target for r in got) > 4


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice("abcdefghij") * (i + 1): rng.choice([0, 1, 10, 1000, 100000]) for i in range(rng.randint(1, 9))} | ({None: 5} if seed % 2 else {})
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, source_docs long")
    got = {r.source: r.target for r in mixing.source_targets(df, [5, 2, 1]).collect()}
    want = B.targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got == pytest.approx(want)


# -- 6 decontamination -----------------------------------------------------
ITEMS = [
    (1, prose(50, 25)), (2, prose(51, 7)), (3, ""), (4, None), (5, "... !!"), (6, "word"), (7, "a a a a a a a a a a a a"), (2, prose(51, 7)), (8, "naïve Straße " + prose(52, 12)),
]


def contaminated_rows():
    p = prose(50, 25).split()
    rows = [
        " ".join(p[5:15]), " ".join(p[5:14]), prose(60, 30) + ", " + " - ".join(p).upper() + "! " + prose(61, 5), prose(51, 7) + " " + prose(51, 7),
        "the Word is", "a " * 11, "a a a", "naïve straße " + prose(52, 12), "NAÏVE Straße " + prose(52, 12),
    ]
    return [(100 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block_chars", [4_000_000, 40])
def test_decontamination(spark, block_chars):
    rows = ROWS + contaminated_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, items, block_chars=block_chars).collect())
    want = Counter()
    for i, t in rows:
        n, hit, found = B.contamination(t, ITEMS)
        want[(i, n, hit, len(found), B.sha(",".join(found)), hit > 0)] += 1
    assert got == want


def test_decontamination_keeps_clean_rows_whole(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(decontam.clean(odd, items).collect(), key=key) == sorted((r for r in odd.collect() if not B.contamination(r.text, ITEMS)[1]), key=key)
    assert decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(odd, items.limit(0)).filter("contaminated").count() == 0


def test_equal_windows_are_one(spark):
    items = [(str(i), prose(50, 25)) for i in range(40)] + [("x", prose(50, 25) + " more")]
    block = decontam.make_block(spark.createDataFrame([(prose(60, 30),)], "text string"), items)
    assert len(block.at) == 17 and len(block.owners) == 41 * 16 + 1
    docs = spark.createDataFrame([(1, prose(50, 25)), (2, prose(61, 30))], "doc_id long, text string")
    got = {r.doc_id: r.n_items for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {1: 41, 2: 0}


def test_frequent_words_that_lead_many_windows_are_worked_off_in_runs(spark, monkeypatch):
    import pyarrow as pa

    from codeloom.llm.textscan import PUNCT, words_of

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(["the", "of", "and"], [6, 3, 1], k=n))
    items = [(str(i), text(30)) for i in range(60)]
    texts = [text(200) for _ in range(40)] + [items[7][1], "", "the " * 50]
    block = decontam.make_block(spark.createDataFrame([(t,) for t in texts], "text string"), items)
    words = words_of(pa.array(texts), PUNCT)
    occurrences = lambda: sorted(zip(*(x.tolist() for x in block.find(words)), strict=True))
    whole = occurrences()
    assert len(whole) > 100
    monkeypatch.setattr(decontam, "CANDIDATES", 50)
    sizes = []
    plain = decontam.Block._verified
    monkeypatch.setattr(decontam.Block, "_verified", lambda self, w, at, key, many: sizes.append(int(many.sum())) or plain(self, w, at, key, many))
    assert occurrences() == whole
    assert len(sizes) > 10 and max(sizes) < 50 + int(np.diff(block.first).max())


# -- 7 suffix tree ---------------------------------------------------------
def test_suffix_lm_base(spark, odd, empty):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in suffix_lm.score_corpus(odd).collect()), key=key)
    want = sorted(((i, B.rest(i) == 1, n, k, total, round(s, 6)) for (i, _), (n, k, total, s) in zip(ROWS, B.base_scores(ROWS), strict=True)), key=key)
    assert got == want
    assert suffix_lm.score_corpus(empty).count() == 0


def test_rare_words_meet_their_counts_in_the_shuffle(spark, odd, monkeypatch):
    monkeypatch.setattr(suffix_lm, "P_WORD", 0.01)
    got = sorted((round(r.base_score, 6), r.n_known) for r in suffix_lm.score_corpus(odd).collect())
    assert got == sorted((round(s, 6), k) for _, k, _, s in B.base_scores(ROWS))


def same_scores(spark, rows, frequent):
    got = suffix_lm.score_corpus(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")).collect()
    want = B.suffix_scores(rows, suffix_lm.DIVERGENCE, suffix_lm.WEIGHTS, frequent)
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: s for (i, _), s in zip(rows, want, strict=True)}, rel=1e-6, abs=1e-5)
    return got


def phrases(seed, n, docs=120):
    """Words that follow each other by rule half of the time, so that there is something to learn."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(docs):
        own = [rng.choice(vocabulary)]
        while len(own) < rng.randint(1, n):
            own.append(vocabulary[(7 * vocabulary.index(own[-1]) + len(own) % 2) % 40] if rng.random() < 0.6 else rng.choice(vocabulary))
        rows.append((i, " ".join(own) + (f" only{i}" if i % 3 else "")))
    return [*rows, (1000, ""), (1001, None), (1002, rows[5][1]), (1003, "again " * 300)]


@pytest.mark.parametrize("share", [2e-6, 0.002])
def test_suffix_tree_against_a_plain_one(spark, monkeypatch, share):
    monkeypatch.setattr(suffix_lm, "P_WORD", share)
    rows = phrases(1, 60)
    got = same_scores(spark, rows, share)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_documents_score_above_the_base(spark):
    from codeloom.llm import queries

    held = queries.op7_suffix_lm(spark, "/root/testdata/sf0.01").filter("held_out").select("score", "base_score").collect()
    assert sum(r.score for r in held) > 0.92 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


def test_small_batches_give_the_same_scores(spark, monkeypatch):
    rows = phrases(2, 30, 60)
    monkeypatch.setattr(suffix_lm, "BATCH", 200)
    monkeypatch.setattr(suffix_lm, "BATCH_DOCS", 7)
    same_scores(spark, rows, suffix_lm.P_WORD)


def test_a_word_in_classes_stays_a_distribution():
    """Whatever the context, the next symbols' probabilities sum to one with that of the unknown word."""
    n, v = 90, 3
    words = suffix_lm.Words(np.array([10, 20], np.uint64), np.array([5, 60, 25]), n, v, 0.0)
    assert abs(words.p[1:].sum() + 0.5 / (n + 0.5 * (v + 1)) - 1) < 1e-9
    rng = np.random.default_rng(3)
    symbol = rng.choice([0, 1, 2], 90, p=[0.1, 0.6, 0.3])
    context = (symbol + rng.integers(0, 2, 90)) % 3
    # one place more of each context and symbol, that is not learned, asks for all probabilities
    context, symbol = np.append(context, np.repeat(np.arange(3), 3)), np.append(symbol, np.tile(np.arange(3), 3))
    learned = np.append(np.ones(90), np.zeros(9))
    p = words.p[1:][symbol]
    a, b = suffix_lm._deeper(context, symbol, 3, learned, np.zeros(99), np.ones(99), p)
    total = (a + b * p)[90:].reshape(3, 3).sum(axis=1) + b[90::3] * (1 - words.p[1:].sum())
    assert np.allclose(total, 1) and (a > 0).any()


def test_split_words_score_all_places(spark, monkeypatch):
    monkeypatch.setattr(suffix_lm, "CLASS", 20)
    monkeypatch.setattr(suffix_lm, "PART", 50)
    rows = phrases(3, 60)
    got = {r.doc_id: r for r in suffix_lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(B.spaces(t)) + 1 for i, t in rows}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# -- 8 token counts --------------------------------------------------------
def unigram(pieces, byte_fallback=False):
    from tokenizers import Tokenizer, models

    least = min(s for _, s in pieces)
    extra = [(f"<0x{i:02X}>", least - 100) for i in range(256)] if byte_fallback else []
    return Tokenizer(models.Unigram([("<unk>", least), *extra, *pieces], 0, byte_fallback))


def plain_count(tokenizer, text):
    return len(tokenizer.encode(token_counts.MARK + text.replace(" ", token_counts.MARK)).tokens) if text else 0


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_ties_go_as_in_the_tokenizer(seed):
    rng = random.Random(seed)
    marked = [("▁", -3.0)] if seed % 2 else []
    own = {"".join(rng.choices("abc▁" if seed % 4 < 2 else "abc", k=rng.randint(1, 4))): float(-rng.randint(1, 4)) for _ in range(25)} | dict(marked)
    vocabulary = token_counts.Vocabulary(tuple(own.items()), False, min(own.values()))
    counter, tokenizer = token_counts.Counter(vocabulary), unigram(list(own.items()))
    for _ in range(200):
        text = "".join(rng.choices("aabbc xé ", k=rng.randint(0, 40)))
        assert counter.count(text) == plain_count(tokenizer, text), text


@pytest.mark.parametrize("seed", range(4))
def test_bytes_stand_in_for_unknown_characters(seed):
    rng = random.Random(seed)
    own = {"".join(rng.choices("abc▁", k=rng.randint(1, 4))): float(-rng.randint(1, 4)) for _ in range(25)} | {x: -3.0 for x in "abc▁"}
    vocabulary = token_counts.Vocabulary(tuple(own.items()), True, min(own.values()))
    counter, tokenizer = token_counts.Counter(vocabulary), unigram(list(own.items()), True)
    for _ in range(200):
        text = "".join(rng.choices("aabbc xé漢𝔘 ", k=rng.randint(0, 40)))
        assert counter.count(text) == plain_count(tokenizer, text), text


def test_token_counts_of_a_public_vocabulary(spark, odd, empty):
    from codeloom.llm.queries import TOKENIZERS

    plain = token_counts.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model", byte_fallback=False)
    tokenizer = unigram(list(plain.pieces))
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd, plain).collect()), key=key)
    assert got == sorted(((i, plain_count(tokenizer, t)) for i, t in ROWS), key=key)
    fallback = token_counts.Counter(token_counts.Vocabulary(plain.pieces, True, plain.least))
    assert fallback.count("a 𝔘𝔫") == token_counts.Counter(plain).count("a") + 1 + 8
    assert token_counts.count_tokens(empty, plain).count() == 0


ODD_TEXTS = ["  a  b ", " ", "▁a▁", "<s> </s><unk>", "a\nb\tc", "Überraschung 漢字", "x" * 3000, "the " * 2000]


def odd_documents(spark, odd):
    return odd.union(spark.createDataFrame([(100 + i, t, *odd_rows()[0][2:]) for i, t in enumerate(ODD_TEXTS)], SCHEMA))


def test_op8_equals_a_unigram_tokenizer_of_the_same_pieces(spark, odd, tmp_path):
    from codeloom.llm import queries

    docs = odd_documents(spark, odd)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = unigram(list(token_counts.load_pieces(f"{queries.TOKENIZERS}/piece_bpe_32k.model").pieces), True)
    got = sorted(((r.doc_id, r.n_tokens) for r in queries.op8_token_counts(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(((r.doc_id, plain_count(tokenizer, r.text)) for r in docs.collect()), key=key)


def test_op8_equals_the_tokenizer_on_whole_test_documents(spark):
    from codeloom.llm import queries

    folder = "/root/testdata/sf0.001"
    tokenizer = unigram(list(token_counts.load_pieces(f"{queries.TOKENIZERS}/piece_bpe_32k.model").pieces), True)
    got = {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, folder).collect()}
    assert got == {r.doc_id: plain_count(tokenizer, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_the_own_encoder_of_a_model_counts(spark, odd):
    import sentencepiece

    from codeloom.llm import queries

    docs, path = odd_documents(spark, odd), f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, token_counts.load_model(path)).collect()), key=key)
    assert got == sorted(((r.doc_id, len(model.encode(r.text)) if r.text else 0) for r in docs.collect()), key=key)


# -- 9 url filters ---------------------------------------------------------
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judged(spark, rows):
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(RULES, "decision string, host string, path string")
    return {r.page_id: r for r in url_equiv.judge_pages(df, rules).collect()}


def test_rules(spark):
    got = judged(spark, [
        (1, "http://A.Example.ORG/es/x?y#z", None), (2, "https://example.org/en/12", ""), (3, "http://notexample.org/es/", ""), (4, "x://COM/de/#", ""), (5, "http://com", ""),
        (6, None, None), (7, "no-scheme/de/", ""), (8, "http://b.com/fr", ""), (9, "http://", ""), (10, "a://b.org?c://d.com/de/", ""),
    ])
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[3].rule, got[4].rule, got[4].verdict) == ("example.org/en/1", "org/", "com/de/", "block")
    assert all(got[i].rule is None and got[i].verdict == "allow" for i in (5, 6, 7, 8, 9, 10))
    assert (got[6].host, got[6].path, got[7].host, got[10].host, got[10].path) == ("", "", "", "b.org", "")


def test_decisions_pass_to_aliases(spark):
    canon = '<html><link href="{}" rel="canonical">'
    got = judged(spark, [
        (1, "http://a.net/1#top", canon.format("http://b.com/de/1")), (2, "http://c.net/2", "<meta http-equiv='refresh' content='0; url=http://a.net/1'>"),
        (3, "http://d.net/3", canon.format("/4")), (4, "http://d.net/4", canon.format("http://b.com/de/2")), (5, "http://d.net/5", canon.format("http://d.net/4") + canon.format("//e.org/")),
        (6, "http://b.com/de/1", ""), (7, "http://lone.net/", canon.format("http://lone.net/")),
    ])
    assert [got[i].verdict for i in range(1, 8)] == ["block", "block", "allow", "allow", "allow", "block", "allow"]
    assert [got[i].reason for i in range(1, 8)] == ["alias", "alias", "alias", "alias", "alias", "rule", "default"]


def test_the_host_is_that_of_the_whole_url(spark):
    got = judged(spark, [(1, "a#b://sub.example.org/es/x", ""), (2, "x://sub.example.org/es/x#y://z.com/de/", ""), (3, "a#b", "")])
    assert [(got[i].host, got[i].rule, got[i].verdict) for i in (1, 2, 3)] == [("sub.example.org", "example.org/es/", "block")] * 2 + [("", None, "allow")]


def test_links_relative_to_the_path(spark):
    canon = '<html><link href="{}" rel="canonical">'
    pairs = [
        ("http://a.net/x/y?q=1", "z"), ("http://a.net/x/y", "../z/./w?k=/../m#f"), ("http://a.net", "z"), ("http://a.net/x/y?q", "?p=2"), ("http://a.net/x/", "./"), ("http://a.net/x/y/z", ".."),
        ("http://a.net/x", "mailto:me"), ("http://a.net/x", "../../.."), ("http://a.net/x", "z?to=http://b.org/"),
    ]
    pages = spark.createDataFrame([(i, u, canon.format(x)) for i, (u, x) in enumerate(pairs)], "page_id long, url string, html string")
    want = {(u, urljoin(u, x).split("#")[0]) for u, x in pairs if not x.startswith("mailto")}
    assert {(r.a, r.b) for r in url_equiv.alias_edges(pages).collect()} == want


def test_url_filters_of_odd_tables(spark):
    assert judged(spark, []) == {}
    schema = "page_id long, url string, html string, alias string, root string, decision string, a string"
    canon = '<link rel="canonical" href="http://b.com/de/1">'
    rows = [(1, "http://a.net/1", canon, "x", "y", "block", "z")] * 3 + [(None, None, None, None, None, None, None)] * 2
    rules = spark.createDataFrame(RULES, "decision string, host string, path string")
    got = url_equiv.judge_pages(spark.createDataFrame(rows, schema), rules).collect()
    assert Counter((r.page_id, r.verdict, r.reason) for r in got) == {(1, "block", "alias"): 3, (None, "allow", "default"): 2}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(30)] + [(None, 3)]
    least = {x: x for p in pairs if None not in p for x in p}
    for _ in range(n + 60):
        for a, b in pairs:
            if a is not None:
                least[a] = least[b] = min(least[a], least[b])
    assert {r.node: r.root for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == least


# -- 10 n-gram join --------------------------------------------------------
def same_groups(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Node string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.NgramJoin(docs, **options).groups().collect())
    assert got == Counter(B.groups(rows))


def test_ngram_join_odd_rows(spark, odd, empty):
    same_groups(spark, ROWS)
    assert ngram_join.NgramJoin(empty).groups().count() == 0


def edited(text, edits, rng):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", range(3))
def test_ngram_join_near_copies(spark, seed):
    rng = random.Random(seed)
    rows = [(i, prose(i, rng.randint(1, 80))) for i in range(60)]
    for g in range(12):
        base = prose(1000 + g, rng.randint(6, 150))
        rows += [(1000 + 50 * g + k, edited(base, rng.randint(0, max(1, len(base.split()) // 20)), rng)) for k in range(rng.randint(2, 9))]
    passage = prose(77, 60)
    rows += [(5000 + i, prose(5000 + i, rng.randint(5, 60)) + " " + passage) for i in range(40)]
    same_groups(spark, rows)


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join_large_groups(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(3):
        base = prose(2000 + g, 60)
        rows += [(1000 * g + k, edited(base, rng.choice([1, 1, 2, 3]), rng)) for k in range(40)]
    same_groups(spark, rows)
    same_groups(spark, rows, max_common=0, block_shingles=400)  # clusters in several blocks


def test_one_of_each(spark, odd, empty):
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    want = {(i, c) for i, n, c in B.groups(ROWS) if n and i == c}
    blank = Counter(i for i, n, _ in B.groups(ROWS) if not n)
    assert Counter(r.doc_id for r in rows if not B.shingle_set(r.text)) == blank
    assert Counter(r.doc_id for r in rows if B.shingle_set(r.text)) == Counter(i for i, _ in want)
    assert ngram_join.one_of_each(empty).count() == 0


def test_one_of_repeated_rows(spark):
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, prose(1, 50)), (3, prose(3, 9)), (3, prose(3, 9))]
    docs = spark.createDataFrame([(*r, None, None, *["x", None, 5, "y", "z", None, 7, "w"]) for r in rows], SCHEMA)
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == [1, 3]


def linked(x, y, percent):
    return 100 * len(set(x) & set(y)) >= percent * len(set(x) | set(y))


def near_sets(rng, families=4, members=25):
    """Families of near copies over a small universe, in which paths are shared and lengths differ."""
    sets = []
    for _ in range(families):
        base = rng.sample(range(400), rng.randint(4, 60))
        for _ in range(members):
            own = [v for v in base if rng.random() > 0.12] + rng.sample(range(400), rng.randint(0, 1 + len(base) // 6))
            sets.append(np.array(sorted(set(own)) or [1], np.uint64))
    return sets


@pytest.mark.parametrize("seed", range(20))
def test_trie_probe(seed):
    rng = random.Random(seed)
    sets = [np.array(sorted(rng.sample(range(30), rng.randint(1, 20))), np.uint64) for _ in range(60)]
    for own, percent in ((sets, 60), (near_sets(rng), 75)):
        trie = ngram_join.Trie(own)
        for x in own[::7]:
            assert sorted(trie.order[p] for p in trie.probe(x, percent)) == [i for i, y in enumerate(own) if linked(x, y, percent)]


@pytest.mark.parametrize("seed", range(12))
def test_block_links_span_the_components(seed):
    rng = random.Random(seed)
    sets = near_sets(rng)
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if linked(sets[i], sets[j], 75)]

    def least(links):
        own = list(range(n))
        for _ in range(n):
            before = list(own)
            for a, b in links:
                own[a] = own[b] = min(own[a], own[b])
            if own == before:
                return own

    links = list(ngram_join.Block(list(range(n)), list(range(n)), sets, 75).links())
    assert least(links) == least(pairs)
    assert len(links) == n - len(set(least(pairs)))
    # one half as a block, the other half asks
    half = ngram_join.Block(list(range(0, n, 2)), list(range(0, n, 2)), sets[::2], 75)
    asked = [x for i in range(1, n, 2) for x in half.ask(i, i, sets[i])]
    assert set(asked) <= {(i, j) for i, j in pairs} | {(j, i) for i, j in pairs}
    assert {i for i, _ in asked} == {x for p in pairs if (p[0] + p[1]) % 2 for x in p if x % 2}


def test_trie_walks_a_shorter_set_after_skipped_ones():
    x = np.arange(100, dtype=np.uint64) * np.uint64(1000)
    held = [[0, *range(7, 12)], [0, *range(7, 47)], [0, *range(7, 100)]]  # the first is left, the second skipped; the third shares more with the second than with the first
    sets = [np.array([1000 * i for i in own] + [1000 * own[-1] + 1 + i for i in range(more)], np.uint64) for own, more in zip(held, (114, 79, 6), strict=True)]
    assert [len(s) for s in sets] == [120, 120, 100]
    trie = ngram_join.Trie(sets)
    assert [trie.order[p] for p in trie.probe(x, 75)] == [2]


@pytest.mark.parametrize("hashes", [0, 500_000])
def test_near_copies_send_no_growing_table_whole(spark, odd, monkeypatch, hashes):
    def result():
        groups = sorted(map(str, ngram_join.NgramJoin(odd).groups().collect()))
        return groups, sorted(map(str, ngram_join.one_of_each(odd).collect()))

    plain, sent, broadcast = result(), [], ngram_join.F.broadcast
    monkeypatch.setattr(ngram_join.F, "broadcast", lambda df: (sent.append(df.count()), broadcast(df))[1])
    monkeypatch.setattr(ngram_join, "SEND_TABLE", 2, raising=False)
    monkeypatch.setattr(ngram_join, "SEND_ROWS", hashes)
    assert result() == plain
    assert max(sent, default=0) <= 2


def test_spark_sends_no_growing_table_of_its_own_accord(spark, tmp_path, monkeypatch):
    from codeloom.llm import common

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (common, ngram_join):
        monkeypatch.setattr(module, "SEND_TABLE", 3, raising=False)
    plans, stage = [], C.stage
    monkeypatch.setattr(C, "stage", lambda df, name: (plans.append(plan(df)), stage(df, name))[1])
    links = spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long")
    assert {tuple(r) for r in C.components(links).collect()} == {(i, 0) for i in range(6)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
    spark.range(5).write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    assert "BroadcastExchange" not in plan(ids.join(ngram_join._small(ids), "id"))
    assert "BroadcastExchange" in plan(ids.join(ngram_join._small(ids.filter("id < 3")), "id"))


def test_op7_split_words_change_no_score(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i % 17, 120), "en", "a") for i in range(60)], "doc_id long, text string, lang string, source string")
    score = lambda: {r.doc_id: (r.n_known, r.base_score, r.score) for r in suffix_lm.score_corpus(docs).collect()}
    whole = score()
    monkeypatch.setattr(suffix_lm, "CLASS", 25)
    split = score()
    assert split.keys() == whole.keys() and any(abs(s - b) > 1 for _, b, s in whole.values())
    for i in whole:
        assert split[i] == pytest.approx(whole[i], rel=1e-5)
