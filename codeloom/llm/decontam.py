"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is ``size`` consecutive words of an item (a shorter item is one window). Containment of a
whole window needs each of its shingles, so its prefix is one shingle: the rarest by count over all
documents (here a shingle is a word). Documents look up their words among the windows' prefix words;
a match at offset k of a window fixes where the window would start, which must lie in the document,
and leave room for the window's length; then all of the window's words are compared.

The windows of a block of items are broadcast: the block's word hashes, and for each distinct window where
it is in them and whose it is, so equal windows of many items are looked for once. A block's text is at most
``block_chars`` characters (a longer item stands alone), some 30 bytes each as sent. A larger benchmark is
worked off block by block over all documents, and what is found so far is carried along, so no size of
the benchmark changes results; each block reads the documents twice.

Words are compared by 64-bit hashes.

Defined cases: null texts have no words; items without words have no windows; repeated item ids count
once; repeated documents are judged each; an empty benchmark hits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stage
from codeloom.llm.textscan import PUNCT, Words, mix, pieces, words_of

#: Places of windows that are compared at a time, and those of one document word beyond it.
CANDIDATES = 1 << 20


@dataclass
class Block:
    """Distinct windows of some items, ordered by their prefix word."""

    items: list[str]
    words: np.ndarray  #: hashes of all items' words, one after the other
    at: np.ndarray  #: window -> its first word in ``words``
    length: np.ndarray
    offset: np.ndarray  #: where in the window its rarest word is
    keys: np.ndarray  #: the distinct prefix words, sorted
    first: np.ndarray  #: key -> first window
    owners: np.ndarray  #: indexes of the windows' items
    owned: np.ndarray  #: window -> first of its ``owners``

    def items_of(self, windows: np.ndarray) -> list[str]:
        found = [self.owners[self.owned[w] : self.owned[w + 1]] for w in np.unique(windows).tolist()]
        return [self.items[k] for k in np.unique(np.concatenate(found)).tolist()]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, index of its first word) of every occurrence in a batch of rows."""
        nothing = np.zeros(0, np.int64)
        if not len(self.keys) or not len(words.hash):
            return nothing, nothing
        small = np.zeros(1 << 16, bool)
        small[self.keys & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(small[words.hash & np.uint64(0xFFFF)])
        key = np.searchsorted(self.keys, words.hash[at])
        same = self.keys[np.minimum(key, len(self.keys) - 1)] == words.hash[at]
        at, key = at[same], key[same]
        many = self.first[key + 1] - self.first[key]
        # frequent words that lead many windows: their product is worked off in runs
        run = (np.cumsum(many) - many) // CANDIDATES
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1, [len(at)]))
        found = [self._verified(words, at[a:b], key[a:b], many[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        window, start = (np.concatenate(x) for x in zip(*found, strict=True))
        return window, start

    def _verified(self, words: Words, at: np.ndarray, key: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows that words ``at`` lead by ``key``, ``many`` each: those that occur whole, with their starts."""
        window = np.repeat(self.first[key] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        word = np.repeat(at, many)
        start, row = word - self.offset[window], words.row[word]
        room = (start >= words.first[row]) & (start + self.length[window] <= words.first[row + 1])
        window, start = window[room], start[room]
        for k in range(int(self.length.max())):
            longer = self.length[window] > k
            ok = ~longer
            ok[longer] = words.hash[start[longer] + k] == self.words[self.at[window[longer]] + k]
            window, start = window[ok], start[ok]
        return window, start


def _item_windows(texts: list[str], size: int) -> tuple[Words, list[tuple[int, int, int]]]:
    words = words_of(pa.array(texts, pa.string()), PUNCT)
    spans = []
    for i in range(len(texts)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b > a:
            spans += [(i, s, min(size, b - a)) for s in range(a, max(a + 1, b - size + 1))]
    return words, spans


def _counts(vocabulary: np.ndarray):
    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in pieces(batch):
                h = words_of(part.column(0), PUNCT).hash
                at = np.searchsorted(vocabulary, h)
                at = at[vocabulary[np.minimum(at, len(vocabulary) - 1)] == h]
                total += np.bincount(at, minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["word", "n"])

    return count


def make_block(docs: DataFrame, items: list[tuple[str, str]], size: int = 10) -> Block:
    """Windows of the items with their rarest words; ``docs`` has the column text."""
    ids = sorted({k for k, _ in items})
    place = {k: i for i, k in enumerate(ids)}
    words, spans = _item_windows([t for _, t in items], size)
    vocabulary = np.unique(words.hash)
    if len(vocabulary):
        counted = docs.select("text").mapInArrow(_counts(vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    else:
        counted = []
    seen = np.zeros(len(vocabulary), np.int64)
    for r in counted:
        seen[r["word"]] = r["n"]
    own = np.array([place[k] for k, _ in items], np.int64)
    item, at, length = (np.array(x, np.int64) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
    item = own[item]
    # windows with the same words are one: their 64-bit hash stands for them
    same = np.zeros(len(at), np.uint64)
    rare, rarest, offset = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    count = seen[np.searchsorted(vocabulary, words.hash)]
    for k in range(size):
        inside = np.flatnonzero(length > k)
        h, n = words.hash[at[inside] + k], count[at[inside] + k]
        same[inside] = mix(same[inside] + h)
        # ties of rarity go to the lesser hash: one order for all windows
        better = (n < rare[inside]) | ((n == rare[inside]) & (h < rarest[inside]))
        rare[inside[better]], rarest[inside[better]], offset[inside[better]] = n[better], h[better], k
    same = mix(same + length.astype(np.uint64))
    order = np.lexsort((item, same, rarest))
    item, at, length, offset, rarest, same = (x[order] for x in (item, at, length, offset, rarest, same))
    new = np.ones(len(at), bool)
    new[1:] = same[1:] != same[:-1]
    lead = np.flatnonzero(new)
    keys, first = np.unique(rarest[lead], return_index=True)
    return Block(ids, words.hash, at[lead], length[lead], offset[lead], keys, np.append(first, len(lead)), item, np.append(lead, len(item)))


def _marker(block):
    """A UDF (text, spans so far, items so far) -> struct(n_words, spans, items); spans: start, end, start, end ..."""

    @F.arrow_udf("struct<n_words:long,spans:array<int>,items:array<string>>")
    def mark(text: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        index: Block = block.value
        n_words, out_spans, out_items = [], [], []
        done = 0
        for part in pieces(pa.RecordBatch.from_arrays([text], ["text"])):
            words = words_of(part.column(0), PUNCT)
            window, start = index.find(words)
            row = words.row[start]
            n_words += np.diff(words.first).tolist()
            spans_of, items_of = [[]] * part.num_rows, [[]] * part.num_rows
            order = np.argsort(start, kind="stable")
            window, start, row = window[order], start[order], row[order]
            for r in np.unique(row).tolist():
                a, b = np.searchsorted(row, [r, r + 1])
                own = (start[a:b] - words.first[r]).tolist()
                merged: list[int] = []
                for s, n in zip(own, index.length[window[a:b]].tolist(), strict=True):
                    if merged and s <= merged[-1]:
                        merged[-1] = max(merged[-1], s + n)
                    else:
                        merged += [s, s + n]
                spans_of[r] = merged
                items_of[r] = index.items_of(window[a:b])
            for r in range(part.num_rows):
                before = spans[done + r].as_py() if len(spans) and spans[done + r].is_valid else []
                if before:
                    pairs = sorted(zip((before + spans_of[r])[::2], (before + spans_of[r])[1::2], strict=True))
                    merged = []
                    for s, e in pairs:
                        if merged and s <= merged[-1]:
                            merged[-1] = max(merged[-1], e)
                        else:
                            merged += [s, e]
                    spans_of[r] = merged
                    items_of[r] = sorted({*items_of[r], *items[done + r].as_py()})
            done += part.num_rows
            out_spans += spans_of
            out_items += items_of
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(out_spans, pa.list_(pa.int32())), pa.array(out_items, pa.list_(pa.string()))],
            ["n_words", "spans", "items"],
        )

    return mark


def _blocks(benchmark: DataFrame, block_chars: int):
    """Lists of (item id, text), of ``block_chars`` characters at most, one after the other."""
    now, size = [], 0
    for r in benchmark.toLocalIterator(prefetchPartitions=False):
        if now and size + len(r["text"]) > block_chars:
            yield now
            now, size = [], 0
        now.append((r["item"], r["text"]))
        size += len(r["text"])
    yield now


def mark_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, block_chars: int = 16_000_000) -> DataFrame:
    """``docs`` with a column ``name``: struct of n_words, spans (word positions hit) and items (ids as strings)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    texts = docs.select(F.col(text_col).alias("text"))
    out = docs
    for k, block in enumerate(_blocks(items, block_chars)):
        sent = spark.sparkContext.broadcast(make_block(texts, block, size))
        before = (F.col(name)["spans"], F.col(name)["items"]) if k else (F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>"))
        out = out.withColumn(name, _marker(sent)(F.col(text_col), *before))
        if k and k % 4 == 0:
            out = stage(out, "decontam-blocks")
    return out


def hit_words(hits: str) -> F.Column:
    """Words covered by the spans."""
    spans = F.col(hits)["spans"]
    ends = F.aggregate(F.transform(spans, lambda v, i: F.when(i % 2 == 0, -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return ends.cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the items themselves."""
    text_col = options.get("text_col", "text")
    marked = mark_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), benchmark, "hits", **options)
    items = F.array_sort(F.col("hits")["items"])
    marked = marked.select("doc_id", F.col("hits")["n_words"].alias("n_words"), hit_words("hits").alias("n_hit"), items.alias("items"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no window occurs in, all columns."""
    from codeloom.llm.common import fresh

    (name,) = fresh(docs, "decontam_hits")
    return mark_hits(docs, benchmark, name, **options).filter(F.size(F.col(name)["spans"]) == 0).select(*docs.columns)
