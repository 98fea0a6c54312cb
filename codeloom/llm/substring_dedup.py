"""Removal of long passages that documents share, by a compacted de Bruijn graph of word windows.

A graph's edge is a k-mer of ``window`` consecutive words, its nodes are the k-1 words that neighbouring
edges share. Storing every edge of every document would cost a row a word, so a document's edges come as
pieces, runs of neighbouring windows:

1. Each window is filed under its anchor, the run of ``anchor`` words in it with the least hash. Equal windows
   have equal anchors, wherever they occur. Windows in a row with one anchor form a piece (some 18 windows),
   known by its anchor and a hash of all its words.
2. Anchors that occur in documents of one id only drop out, with their pieces: none of their windows repeats.
3. Equal pieces of all documents are grouped: copies of a passage collapse into one path of edges, whose source is
   the place of its occurrence in the document with the smallest id.
4. Paths are compacted: two pieces that follow one another at their source are one path if neither has another
   neighbour in any document (no branch at the node between them) and the source is the same document.
   The pieces' occurrences, joined with the paths, become passages: whole runs where a document follows a path. A
   passage counts as one where its pieces lie end to end in the document, else piece by piece.
5. Where one anchor has several different pieces (a branch: a shared passage amid different texts), equality is
   decided window by window, on the words of each piece's source: the windows are grouped by anchor and hash, and those
   that a document with a smaller id has are marked in the piece.
6. A document's passages and marked windows are laid over its words.

A piece's occurrence outside its source has its source's document before it, so it is removed whole; only pieces
at their source need step 5. Texts travel twice at most: those with a removal that leaves words, or a
branch at a source, are joined with their passages and written in buckets, which the last step reads.

Pieces and windows are compared by 128 bits (anchor and whole, 64 bits each). A piece, anchor or window that a
large share of all rows has is grouped by partial sums and joined back by broadcast (:func:`common.join_back`).

Defined cases: a null text has no words; a null id counts as larger than all ids, and equal ids as one
document; repeated rows get the same result each; a text of fewer words than a window keeps all; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import free, join_back, shared_path, stage
from codeloom.llm.textscan import SAME, SPACE, Words, buffer_of, joined, pieces, rolled, words_of

_LAST = (1 << 63) - 1
#: Bits of an anchor's place; the others are its hash.
_PLACE = 30
_SALT = 0x2545F4914F6CDD1D


def default_anchor(window: int) -> int:
    """Words of an anchor: a third of the window, more where a piece would have more windows than a mask has bits."""
    return max((window + 2) // 3, window - 40)


def cut_pieces(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(first word, windows, anchor's hash, hash of all words) of every piece of a batch's rows, in order."""
    nothing = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    h, n = words.hash, len(words.hash)
    if n < window:
        return nothing
    at = np.arange(n - window + 1)
    at = at[words.row[at] == words.row[at + window - 1]]
    if not len(at):
        return nothing
    hashes = rolled(h, np.arange(n - anchor + 1), anchor)
    # the leftmost least of the window's anchors, by doubling: a hash's upper bits with its place below
    least = (hashes >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    span, size = window - anchor + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: size - span], least[span - size :])
    chosen = (least[at] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    count = np.diff(np.append(first, len(at)))
    return at[first], count, hashes[chosen[first]], rolled(h, at[first], count + window - 1, _SALT)


def _signed(x: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(x.view(np.int64), kind or pa.int64())


def _short(body: F.Column) -> F.Column:
    """31 bits of a piece's hash: which neighbour it is; a mix-up only joins paths, whose coordinates are compared."""
    return body.bitwiseAND(0x7FFFFFFF).cast("int")


def _texts_digest(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[bytes]:
    """SHA-256 of each row's words joined by one blank."""
    buffer, begin, stop = joined(raw, start, end)
    view = memoryview(buffer)
    return [hashlib.sha256(view[begin[a] : stop[b - 1]] if b > a else b"").digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _cutter(window: int, anchor: int):
    def cut(batches):
        for batch in batches:
            for part in pieces(batch):
                column = part.column(part.schema.get_field_index("text"))
                words = words_of(column, SPACE, fold=SAME)
                start, count, anchors, bodies = cut_pieces(words, window, anchor)
                row = words.row[start]
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = [_signed(anchors), _signed(bodies), pa.array(start - words.first[row], pa.int32()), pa.array(count, pa.int32())]
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for x in lists]
                digest = _texts_digest(buffer_of(column)[0], words.start, words.end, words.first)
                columns = [part.column(0), part.column(1), part.column(2), pa.array(np.diff(words.first), pa.int64()), pa.array(digest, pa.binary()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "text_key", "n_words", "whole", "anchors", "bodies", "starts", "sizes"])

    return cut


def _windows(window: int):
    """Hashes of the windows of the pieces named in ``branches`` (start, size, anchor, body)."""

    def extract(batches):
        for batch in batches:
            for part in pieces(batch):
                named = part.column(part.schema.get_field_index("branches"))
                inner = named.flatten()
                start, size, anchors, bodies = (inner.field(k).to_numpy() for k in range(4))
                row = np.repeat(np.arange(part.num_rows), np.diff(named.offsets.to_numpy()))
                words = words_of(part.column(part.schema.get_field_index("text")), SPACE, fold=SAME)
                nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                hashes = rolled(words.hash, np.repeat(words.first[row] + start, size) + nth, window)
                owner = np.repeat(np.arange(len(size)), size)
                doc = part.column(part.schema.get_field_index("doc")).to_numpy()
                columns = [pa.array(anchors[owner]), pa.array(bodies[owner]), pa.array(doc[row[owner]]), pa.array(nth, pa.int32()), _signed(hashes)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "body", "doc", "nth", "hash"])

    return extract


def _remover(window: int):
    """Lay removed passages and marked windows over the words of each text."""

    def remove(batches):
        for batch in batches:
            for part in pieces(batch):
                get = lambda name, part=part: part.column(part.schema.get_field_index(name))
                column = get("text")
                words = words_of(column, SPACE, hashed=False)
                change = np.zeros(len(words.start) + 1, np.int64)
                for name in ("passages", "marks"):
                    inner = get(name).flatten()
                    start, size = (inner.field(k).to_numpy().astype(np.int64) for k in range(2))
                    row = np.repeat(np.arange(part.num_rows), np.diff(get(name).offsets.to_numpy()))
                    at = words.first[row] + start
                    if name == "marks":  # the second number holds a bit for each window
                        bits = [np.flatnonzero(size >> k & 1) for k in range(63)]
                        at = np.concatenate([at[b] + k for k, b in enumerate(bits)])
                        size = np.ones(len(at), np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + size + window - 1, -1)
                stay = np.cumsum(change)[:-1] == 0
                kept = np.append(0, np.cumsum(stay))[words.first]
                digest = _texts_digest(buffer_of(column)[0], words.start[stay], words.end[stay], kept)
                columns = [get("doc"), get("text_key"), pa.array(np.diff(words.first) - np.diff(kept), pa.int64()), pa.array(digest, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "text_key", "removed", "left"])

    return remove


class SubstringDedup:
    """Passages of ``window`` words or more that documents with smaller ids have as well."""

    def __init__(self, docs: DataFrame, window: int = 50, anchor: int | None = None, id_col: str = "doc_id", text_col: str = "text"):
        self.window = window
        self.anchor = anchor or default_anchor(window)
        doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc.alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))
        schema = "doc_id long, doc long, text_key long, n_words long, whole binary, anchors array<long>, bodies array<long>, starts array<int>, sizes array<int>"
        self.docs = stage(self.texts.mapInArrow(_cutter(window, self.anchor), schema), "substring-pieces")
        self.spans = self._spans()

    def _occurrences(self) -> DataFrame:
        """Pieces whose anchor is in documents of several ids, with what comes before and after (0: the text's end)."""
        anchors = self.docs.select("doc", F.explode("anchors").alias("anchor"))
        alive = anchors.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
        alive = stage(alive.filter("low < high").select("anchor", "n", F.lit(True).alias("alive")), "substring-anchors")
        end, short = F.array(F.lit(0)), F.transform("bodies", _short)
        each = F.arrays_zip("anchors", "bodies", "starts", "sizes", F.concat(end, F.slice(short, 1, F.size(short) - 1)), F.concat(F.slice(short, 2, F.size(short)), end))
        rows = self.docs.filter("size(bodies) > 0").select("doc", "text_key", F.inline(each).alias("anchor", "body", "start", "size", "before", "after"))
        total = alive.agg(F.sum("n")).first()[0] or 0
        out = stage(join_back(rows, alive, ["anchor"], "n", total).filter("alive").drop("alive"), "substring-occurrences")
        free(alive)
        return out

    def _paths(self, found: DataFrame) -> DataFrame:
        """One row per distinct piece: its source, its place in the compacted path, and whether its anchor branches."""
        source = F.min(F.struct("doc", "text_key", "start"))
        ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("before", "after") for f in (F.min, F.max)]
        distinct = stage(found.groupBy("anchor", "body").agg(source.alias("source"), F.max("size").alias("size"), F.count("*").alias("n"), *ends), "substring-distinct")
        kinds = distinct.groupBy("anchor").agg(F.min("source.doc").alias("low"), F.max("source.doc").alias("high"), F.count("*").alias("kinds"))
        told = join_back(distinct, kinds.select("anchor", "kinds", (F.col("low") < F.col("high")).alias("branches")), ["anchor"], "kinds", distinct.count())
        # at its source, a piece goes on the path of the one before it, unless one of them has another neighbour
        of_source = Window.partitionBy("source.doc", "source.text_key").orderBy("source.start", "anchor", "body")
        last = F.lag(F.struct(F.col("source.start").alias("start"), "size", "body", "after_min", "after_max")).over(of_source)
        follows = (last["start"] + last["size"] == F.col("source.start")) & (last["after_min"] == last["after_max"]) & (F.col("before_min") == F.col("before_max")) & (F.col("before_min") == _short(last["body"]))
        first = F.max(F.when(~F.coalesce("follows", F.lit(False)), F.col("source.start"))).over(of_source)
        told = told.withColumn("follows", follows).withColumn("path", first)
        return stage(told.select("anchor", "body", "n", "source", "path", "branches"), "substring-paths")

    def _spans(self) -> DataFrame:
        """doc, text_key, passages (start, windows, source id, source's start), branches (start, size, anchor, body)."""
        found = self._occurrences()
        paths = self._paths(found)
        met = join_back(found, paths, ["anchor", "body"], "n", found.count())
        met = met.withColumn("offset", F.col("start") - (F.col("source.start") - F.col("path"))).withColumn("copied", F.col("source.doc") < F.col("doc"))
        met = met.filter("copied OR branches")
        # pieces of one path at one offset are a passage: end to end, or else each for itself
        same = ["doc", "text_key", F.col("source.doc").alias("source_doc"), F.col("source.text_key").alias("source_key"), "path", "offset", "copied"]
        part = F.struct("start", "size", "anchor", "body")
        parts = met.groupBy(*same).agg(F.collect_set(F.when(F.col("copied"), F.struct("start", "size"))).alias("parts"), F.collect_set(F.when(~F.col("copied"), part)).alias("branches"))
        long = F.array(F.struct(F.array_min("parts.start").alias("start"), F.aggregate("parts.size", F.lit(0), lambda a, b: a + b).alias("size")))
        whole = F.array_max(F.transform("parts", lambda p: p["start"] + p["size"])) - F.array_min("parts.start") == long[0]["size"]
        passage = F.transform(F.when(whole, long).otherwise(F.col("parts")), lambda p: F.struct(p["start"].alias("start"), p["size"].alias("windows"), F.col("source_doc").alias("source_doc"), (F.col("path") + p["start"] - F.col("offset")).alias("source_start")))
        parts = parts.select("doc", "text_key", F.when(F.col("copied"), passage).otherwise(F.array()).alias("passages"), "branches")
        joined_ = lambda name: F.flatten(F.collect_list(name)).alias(name)
        out = stage(parts.groupBy("doc", "text_key").agg(joined_("passages"), joined_("branches")), "substring-spans")
        free(found, paths)
        return out

    def _covered(self) -> F.Column:
        """Words that the passages cover together."""
        ends = F.transform(F.array_sort("passages"), lambda p: F.struct(p["start"].alias("a"), (p["start"] + p["windows"] + (self.window - 1)).alias("b")))
        zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
        more = lambda s, p: F.struct(F.greatest(s["upto"], p["b"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(s["upto"], p["a"]))).alias("n"))
        return F.aggregate(ends, zero, more)["n"].cast("long")

    def removals(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 and passages of every document."""
        keys = ["doc", "text_key"]
        sizes = self.docs.select(*keys, "n_words").distinct()
        known = stage(self.spans.withColumn("covered", self._covered()).join(sizes, keys), "substring-known")
        partly = known.filter("size(branches) > 0 OR (covered > 0 AND covered < n_words)").select(*keys, "passages", "branches")
        name = f"substring_texts_{uuid.uuid4().hex}"
        spark = self.docs.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.texts.drop("doc_id").join(partly, keys).write.bucketBy(buckets, *keys).option("path", shared_path(spark, "substring-texts")).saveAsTable(name)
        texts = spark.table(name)

        windows = stage(texts.filter("size(branches) > 0").select("doc", "text", "branches").mapInArrow(_windows(self.window), "anchor long, body long, doc long, nth int, hash long"), "substring-windows")
        held = windows.groupBy("anchor", "hash").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
        held = stage(held.filter("low < high").select("anchor", "hash", "low", "n"), "substring-held")
        hits = join_back(windows, held, ["anchor", "hash"], "n", windows.count()).filter("low < doc")
        marks = hits.groupBy("anchor", "body", "doc").agg(F.bit_or(F.expr("shiftleft(1L, nth)")).alias("mask"))
        asked = known.select(*keys, F.inline("branches").alias("start", "size", "anchor", "body"))
        marks = asked.join(marks, ["anchor", "body", "doc"]).groupBy(*keys).agg(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), "mask")).alias("marks"))

        none = F.array().cast("array<struct<start:long,mask:long>>")
        whole = texts.join(marks, keys, "left").select(*keys, "text", F.transform("passages", lambda p: F.struct(p["start"].cast("long").alias("start"), p["windows"].cast("long").alias("windows"))).alias("passages"), F.coalesce("marks", none).alias("marks"))
        cut = whole.mapInArrow(_remover(self.window), "doc long, text_key long, removed long, left binary").distinct()
        told = known.select(*keys, "passages", "covered").join(cut, keys, "left")
        told = stage(told.select(*keys, "passages", F.coalesce("removed", "covered").alias("removed"), "left"), "substring-told")
        spark.sql(f"DROP TABLE {name}")
        free(windows, held, known)
        out = self.docs.select("doc_id", *keys, "n_words", "whole").join(told, keys, "left").withColumn("removed", F.coalesce("removed", F.lit(0).cast("long")))
        empty = F.unhex(F.sha2(F.lit(""), 256))
        kept = F.when(F.col("removed") == 0, F.col("whole")).when(F.col("removed") == F.col("n_words"), empty).otherwise(F.col("left"))
        return out.select("doc_id", "n_words", F.col("removed").alias("n_removed"), F.lower(F.hex(kept)).alias("kept_sha256"), F.coalesce("passages", F.array().cast(told.schema["passages"].dataType)).alias("passages"))
