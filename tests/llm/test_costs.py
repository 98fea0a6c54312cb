"""Costs in proportion, and indexes that are not mixed up."""

from __future__ import annotations

import time

from codeloom.llm import exact_dedup, pii


def test_spans_cost_in_proportion_to_their_number(spark):
    def took(n):
        df = spark.createDataFrame([(1, "ab@c.de " * n)], "doc_id long, text string")
        began = time.time()
        assert pii.pii_report(df).first().n_email == n
        return time.time() - began

    took(100)
    assert took(32_000) < 7 * max(took(8_000), 1)


def test_indexes_whose_paths_end_alike(spark, tmp_path):
    tail = "x" * 60
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    one = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/one/{tail}", 2)
    exact_dedup.exact_dedup(texts, one).collect()
    two = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/two/{tail}", 2)
    assert (one.read().count(), two.read().count()) == (2, 0)
    exact_dedup.exact_dedup(texts.limit(1), two).collect()
    assert (one.read().count(), two.read().count()) == (2, 1)
