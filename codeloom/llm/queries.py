"""The operators' queries over the test tables, and their SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontam, exact_dedup, fixity, langid, mixing, ngram_join, pii, resampling, substring_dedup, suffix_lm, token_counts, url_equiv, vector_codes
from codeloom.llm.common import read

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers")
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
WEIGHTS = [5, 2, 1]
#: The second replica's bytes differ in pages whose id has this remainder.
DAMAGED = (97, 13)
#: Ids of a range, and children of a node.
TREE = (16, 4)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, exact_dedup.new_index(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages against a replica in which every page of one remainder lost its last byte."""
    pages = read(spark, sf_dir, "pages")
    modulus, rest = DAMAGED
    cut = F.when(F.col("page_id") % modulus == rest, F.substr("html", F.lit(1), F.length("html") - 1)).otherwise(F.col("html"))
    good, other = (fixity.MerkleTree(fixity.page_records(pages, html), *TREE) for html in (None, cut))
    return fixity.audit(good, other)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_mix(read(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op7_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_corpus(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the best path over the public vocabulary's pieces and scores, read as a unigram vocabulary."""
    pieces = token_counts.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), pieces)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "decision string, host string, path string")
    return url_equiv.judge_pages(read(spark, sf_dir, "pages"), rules).drop("reason")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.NgramJoin(read(spark, sf_dir, "documents")).groups().select("doc_id", "n_shingles", "component_id")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.SubstringDedup(read(spark, sf_dir, "documents")).removals().drop("passages")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.VectorCodes(read(spark, sf_dir, "embeddings")).report()


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_exact_dedup, op2_merkle_fixity, op3_pii, op4_language_id, op5_fair_mix, op6_decontamination, op7_suffix_lm, op8_token_counts, op9_url_filters, op10_ngram_jaccard, op11_substring_dedup, op12_vector_codes, op13_resampling, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from codeloom.llm import oracles

    return oracles.SQL
