"""Importance resampling toward a target distribution over hashed word n-grams.

Documents are collapsed by grouping full texts, so features are counted once per distinct text: the
buckets of its n-grams and how often each occurs. The corpus's bucket counts are the texts' counts times
their copies; the target's are those of the benchmark texts. A bucket's gain is the log ratio of
both smoothed shares in thousandths, a text's weight the floored mean of its features' gains. Weights are
joined back to the documents by the digest of the text, and only then does each document get noise of its own
(Gumbel, from a hash of its id), so the highest scores are a weighted draw without replacement.

Only the bucket counts reach the driver: ``buckets`` numbers, a parameter. A text that a large share of all
documents has is grouped by partial counts and joined back by broadcast (:func:`common.join_back`).
Scores are whole numbers in a range that arithmetic bounds, so a rank is the number of documents with a
higher score, from the table of counts by score, plus the place among equal scores.

Defined cases: a null text is the empty text, without features, of weight 0; repeated rows are documents
each; a null id has the noise of the empty id and ranks last among equal scores; rows with equal
scores and ids rank in any order; an empty table gives no rows; an empty target has no counts.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import join_back, stage
from codeloom.llm.textscan import LOWER, PUNCT, buffer_of, joined, pieces, words_of

#: Features longer than this many bytes are hashed one by one.
SHORT = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def crc32_of(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice ``raw[begin:end]``, one byte of all slices at a time."""
    out = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    size = end - begin
    left = np.flatnonzero(size <= SHORT)
    for k in range(SHORT):
        left = left[size[left] > k]
        if not len(left):
            break
        out[left] = _TABLE[(out[left] ^ raw[begin[left] + k]) & np.uint32(0xFF)] ^ (out[left] >> np.uint32(8))
    out = ~out
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = zlib.crc32(raw[begin[k] : end[k]].tobytes())
    return out


def gram_buckets(column: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, offsets of rows, buckets, counts): the rows' distinct buckets, one row after the other."""
    raw, _ = buffer_of(column)
    words = words_of(column, PUNCT, hashed=False)
    text, begin, end = joined(raw, words.start, words.end, LOWER)
    keys = []
    for k in range(max_n):
        at = np.arange(max(0, len(begin) - k))
        at = at[words.row[at] == words.row[at + k]]
        crc = crc32_of(text, begin[at], end[at + k])
        keys.append(words.row[at] * buckets + (crc % np.uint32(buckets)).astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return np.diff(words.first), np.searchsorted(key, np.arange(len(column) + 1) * buckets), key % buckets, count


def features(texts: DataFrame, max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """digest, copies, n_words, n_features, buckets, counts of each distinct text (columns text, copies)."""

    def count(batches):
        for batch in batches:
            for part in pieces(batch):
                n_words, at, bucket, counts = gram_buckets(part.column(0), max_n, buckets)
                total = np.append(0, np.cumsum(counts))
                lists = (pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (bucket, counts))
                columns = [part.column(2), part.column(1), pa.array(n_words, pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "copies", "n_words", "n_features", "buckets", "counts"])

    texts = texts.select("text", "copies", digest_of(F.col("text")).alias("digest"))
    return texts.mapInArrow(count, "digest binary, copies long, n_words long, n_features long, buckets array<int>, counts array<int>")


def digest_of(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text, copies: the distinct texts and how many documents have each."""
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of every entry of a batch of features."""
    bucket, counts = (batch.column(batch.schema.get_field_index(x)) for x in ("buckets", "counts"))
    size = np.diff(bucket.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), size), bucket.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)


def bucket_totals(counted: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Each bucket's count over all documents: the texts' counts times their copies."""

    def total(batches):
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            row, bucket, counts = _lists(batch)
            np.add.at(out, bucket, counts * batch.column(0).to_numpy()[row])
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in counted.select("copies", "buckets", "counts").mapInArrow(total, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of target to source shares, smoothed by one, in floored thousandths."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def text_weights(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, copies, n_words, n_features, weight of each distinct text."""

    def weigh(batches):
        for batch in batches:
            row, bucket, counts = _lists(batch)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, counts * gain[bucket])
            n = batch.column(3).to_numpy()
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64())], ["digest", "copies", "n_words", "n_features", "weight"])

    return counted.mapInArrow(weigh, "digest binary, copies long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 1, buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    Drawn are ``percent`` percent of the documents with at least ``min_words`` words.
    """
    counted = stage(features(distinct_texts(docs, text_col), max_n, buckets), "resampling-features")
    wanted = bucket_totals(features(distinct_texts(target, target_text), max_n, buckets), buckets)
    weights = stage(text_weights(counted, gains(bucket_totals(counted, buckets), wanted)), "resampling-weights")

    ids = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    total = weights.agg(F.sum("copies"), F.sum(F.when(F.col("n_words") >= min_words, F.col("copies")).otherwise(0))).first()
    rows = join_back(ids, weights, ["digest"], "copies", total[0] or 0).drop("digest")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return _ranked(stage(rows.withColumn("score", F.col("weight") + noise), "resampling-scores"), (total[1] or 0) * percent // 100, min_words)


def _ranked(scores: DataFrame, draw: int, min_words: int) -> DataFrame:
    """``scores`` with rank: the first ``draw`` by score, then id. One row per distinct score meets in one task."""
    eligible = F.col("n_words") >= min_words
    higher = Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = scores.filter(eligible).groupBy("score").agg(F.count("*").alias("n"))
    levels = levels.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above")).filter(F.col("above") < draw)
    # whole scores between log ratios of 64-bit counts: some 10**5 at most
    placed = scores.join(F.broadcast(levels), "score", "left").withColumn("above", F.when(eligible, F.col("above")))
    among = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    drawn = placed.filter("above IS NOT NULL").withColumn("rank", F.col("above") + F.row_number().over(among))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(placed.filter("above IS NULL").withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
