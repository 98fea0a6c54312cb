"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the lower-cased words of a text and one end. The root is the unigram distribution with half
a count for each word and for the unknown one (the base). A context is a suffix of the words before a
symbol: one word, then two. It is retained if its next symbols diverge from what its suffix foretells by
``DIVERGENCE`` nats or more, each occurrence being foretold by all others (leave one out), so a context
is kept where it foretells new text better and not for being rare. A retained context's distribution is
smoothed towards that of its suffix, (c + w p) / (n + w), with the weight w of ``WEIGHTS`` that diverges
most. The longest retained suffix at each place scores it; a context that is not retained hands on its
suffix's distribution to longer ones.

Distribution. All places of all documents go, packed, to the part of their nearest word, so a part holds
whole subtrees: it counts the training places, retains contexts and scores the places of all documents,
of which only sums return. The tree is never gathered or sent, has no bound but the corpus, and grows
with it. Equal places of a document travel as one.

Split words. The places of a word with more than ``CLASS`` training places are dealt by classes of the word before
it (a hash), each in a part of its own, which changes no result: contexts of two words are whole in a class, and what the
context of the one word needs is counted over all its classes. Tasks send the distinct (split word, next word) of a batch, with the
parts that hold them, to the pair's home, which counts it and sends the count to these parts; gains are summed
by word, so the weight of a split word's context is known to all tasks.

Counts of whole words are exact. Words that make up ``P_WORD`` of all words (at most 1 / P_WORD of them) are
sent to all tasks; all other words of a document are joined with their counts in a shuffle. For those a
part does not know the unigram probability p: it returns a and b of the score log10(a + b p), and takes
for p the largest that such a word can have when it tests divergence. Words are told apart by
64-bit hashes.

Defined cases: null counts as empty, which is one end; no training document: V and N are 0, base terms
log10(0.5 / 0.5), no context; repeated rows are scored each; null ids count as the empty id in the
choice of held-out rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import remainder, stage
from codeloom.llm.textscan import mix, pieces, words_of

DIVERGENCE = 3.0
WEIGHTS = (0.5, 2.0, 8.0, 32.0, 128.0, 512.0, 2048.0, 8192.0)
P_WORD = 2e-7
#: Training places of a word from which its places are split, and places of a part on average.
CLASS, PART = 1 << 17, 1 << 19
#: Most parts, so that a batch's share of one is worth a row; beyond them parts grow, and so must executors.
PARTS = 1 << 16
#: Places and documents that a task packs at a time; a document's index has 15 bits, the 16th tells training.
BATCH, BATCH_DOCS, TRAINS = 1 << 20, 1 << 15, 1 << 15
#: Codes of the start, the end, the first frequent word, and of words that are not frequent.
START, END, FIRST, RARE = 0, 1, 2, 0xFFFFFFFF
#: The end token's place among word hashes.
END_WORD = np.int64(-1)
_K = np.uint64(0x9E3779B97F4A7C15)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    at = np.argsort(key, kind="stable")
    key, count = key[at], count[at]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count, first, axis=0)


def _count_words(batches):
    """Partial counts of words: n in training documents, everywhere in all."""
    keys, counts, many = [], [], 0

    def counted():
        key, count = _merged(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count[:, 0]), pa.array(count[:, 1])], ["key", "n", "everywhere"])

    for batch in batches:
        for part in pieces(batch):
            learn = np.array(part.column(1).to_pylist(), bool)
            words = words_of(part.column(0))
            ends = np.full(part.num_rows, END_WORD).view(np.uint64)
            u, back = np.unique(np.concatenate((words.hash, ends)), return_inverse=True)
            total = np.bincount(back, minlength=len(u))
            n = np.bincount(back, weights=np.concatenate((learn[words.row], learn)).astype(float), minlength=len(u)).astype(np.int64)
            keys.append(u)
            counts.append(np.stack((n, total), axis=1))
            many += len(u)
            if many > 4_000_000:
                key, count = _merged(keys, counts)
                keys, counts, many = [key], [count], len(key)
                if many > 3_000_000:
                    yield counted()
                    keys, counts, many = [], [], 0
    if keys:
        yield counted()


@dataclass
class Words:
    """The frequent words, and what is known of all words."""

    keys: np.ndarray  #: hashes
    count: np.ndarray  #: of training documents, first that of ends (and starts), then by word
    n: int  #: training tokens
    v: int  #: distinct ones
    most: float  #: no other word is more frequent
    weight: np.ndarray | None = None  #: of the one-word contexts of split words, by code

    def __post_init__(self):
        by_count = np.argsort(-self.count[1:], kind="stable")  # low codes for frequent words pack well
        self.count = np.concatenate((self.count[:1], self.count[:1], self.count[1:][by_count]))
        at = np.argsort(self.keys[by_count])
        self.keys, self.code = self.keys[by_count][at], (at + FIRST).astype(np.uint32)
        self.p = (self.count + 0.5) / (self.n + 0.5 * (self.v + 1))
        self.p_most = (self.most + 0.5) / (self.n + 0.5 * (self.v + 1))
        self.classes = np.maximum(1, -(-self.count.astype(np.int64) // CLASS)).astype(np.uint64)

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), RARE, np.uint32)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.code[at], np.uint32(RARE))

    def split(self, code: np.ndarray) -> np.ndarray:
        return np.where(code == RARE, False, self.classes[np.minimum(code, len(self.classes) - 1)] > 1)

    def p_of(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities of words by id, for those that are not frequent the largest that they can have."""
        rare = ids >> np.uint64(63) > 0
        return np.where(rare, self.p_most, self.p[np.where(rare, 0, ids).astype(np.int64)])

    def part_of(self, near_ids: np.ndarray, nearest: np.ndarray, before_ids: np.ndarray, parts: int) -> np.ndarray:
        return mix(near_ids + self.class_of(nearest, before_ids) * _K) % np.uint64(parts)

    def class_of(self, code: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Class of the word before (by id), for words that are split."""
        classes = np.where(code == RARE, np.uint64(1), self.classes[np.minimum(code, len(self.classes) - 1)])
        return np.where(classes > 1, mix(before) % classes, np.uint64(0))


def _ids(code: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit id for each word: its code, or its hash with the top bit set."""
    return np.where(code == RARE, h | np.uint64(1 << 63), code.astype(np.uint64))


def _places(words: Words, n: np.ndarray, h: np.ndarray):
    """doc, spot of each word, and of each place the word's code and id, the nearest word's, and the id of the one before."""
    spot = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    code = np.full(len(h) + len(n), END, np.uint32)
    hashes = np.zeros(len(code), np.uint64)
    code[spot], hashes[spot] = words.codes(h), h
    doc = np.repeat(np.arange(len(n)), n + 1)
    ids = _ids(code, hashes)
    nearest, near_ids, before, before_ids = np.full_like(code, START), np.zeros_like(ids), np.full_like(code, START), np.zeros_like(ids)
    for k, c, i in ((1, nearest, near_ids), (2, before, before_ids)):
        same = np.flatnonzero(doc[k:] == doc[:-k]) + k
        c[same], i[same] = code[same - k], ids[same - k]
    return doc, spot, code, ids, nearest, near_ids, before_ids


def _pair_key(near: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(word + mix(near + _K))


def _bytes(*columns: np.ndarray) -> bytes:
    """Columns byte by byte, which compresses well."""
    flat = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return pa.Codec("zstd", 1).compress(flat, asbytes=True)


def _unpacked(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=size), np.uint8)


def _packed(kinds, *columns: np.ndarray) -> bytes:
    body = _bytes(*(c.astype(kind) for c, (_, kind) in zip(columns, kinds, strict=True)))
    return len(columns[0]).to_bytes(4, "little") + body


def _opened(kinds, blob: bytes) -> dict[str, np.ndarray]:
    n, at, out = int.from_bytes(blob[:4], "little"), 0, {}
    flat = _unpacked(blob[4:], n * sum(np.dtype(kind).itemsize for _, kind in kinds))
    for name, kind in kinds:
        out[name], at = _column(flat, at, n, kind)
    return out


def _column(flat: np.ndarray, at: int, n: int, kind) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    own = np.ascontiguousarray(flat[at : at + n * width].reshape(width, n).T).view(kind).reshape(n)
    return own, at + n * width


#: ``n``, ``raw`` and ``places`` are of a part's places; the other columns of a batch's documents, in one row for each batch.
SENT = "part long, batch long, n long, raw long, places binary, ids array<long>, no_id array<boolean>, held array<boolean>, tokens array<long>, known array<long>, base array<double>, rest_doc array<int>, rest_key array<long>, rest_times array<int>, counts binary"
_NAMES = [c.split()[0] for c in SENT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]


def _send_places(sent, parts: int):
    """Places (word, nearest word, the word before it, document) by part, and each batch's documents with their base."""

    def run(batches):
        words: Words = sent.value
        base = np.log10(words.p)
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        places = docs = 0

        def packed():
            n = np.concatenate([x[3] for x in held])
            h = np.concatenate([x[4] for x in held])
            row = np.repeat(np.arange(len(n)), n)
            doc, spot, code, ids, nearest, near_ids, before_ids = _places(words, n, h)
            learn = np.concatenate([x[2] for x in held])
            tag = (doc | np.where(learn, TRAINS, 0)[doc]).astype(np.uint16)
            part = words.part_of(near_ids, nearest, before_ids, parts)
            # by part, nearest word, word and document: equal places meet, and columns pack well
            bits = lambda x, n, at: (mix(x) >> np.uint64(64 - n)) << np.uint64(at)
            at = np.argsort((part << np.uint64(48)) | bits(near_ids, 12, 36) | bits(ids, 14, 22) | (doc.astype(np.uint64) << np.uint64(7)) | bits(before_ids, 7, 0))
            part, tag, key = part[at].astype(np.int64), tag[at], [x[at] for x in (ids, near_ids, before_ids)]
            new = np.ones(len(at), bool)
            new[1:] = (tag[1:] != tag[:-1]) | (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(at))).astype(np.uint32)
            part, tag, key = part[first], tag[first], [x[first] for x in key]
            codes = [np.where(x >> np.uint64(63) > 0, RARE, x & np.uint64(RARE)).astype(np.uint32) for x in key]
            own, start = np.unique(part, return_index=True)
            batch = task << 32 | made
            rows = []
            for p, a, b in zip(own.tolist(), start.tolist(), np.append(start, len(part))[1:].tolist(), strict=True):
                rare = [k[a:b][c[a:b] == RARE] for k, c in zip(key, codes, strict=True)]
                columns = [*(c[a:b] for c in codes), tag[a:b], times[a:b], *rare]
                raw = sum(c.nbytes for c in columns)
                rows.append((p, batch, b - a, raw, _bytes(*columns), *[None] * 10))
            hit = code[spot] != RARE
            rest_row, rest_h = row[~hit], h[~hit]
            order = np.lexsort((rest_h, rest_row))
            rest_row, rest_h = rest_row[order], rest_h[order]
            lead = np.flatnonzero(np.concatenate(([True], (rest_row[1:] != rest_row[:-1]) | (rest_h[1:] != rest_h[:-1])))) if len(order) else order
            total = np.bincount(row[hit], weights=base[code[spot][hit]], minlength=len(n)).astype(float) + base[END]
            known = np.bincount(row[hit], weights=(words.count[code[spot][hit]] > 0).astype(float), minlength=len(n)).astype(np.int64) + int(words.count[END] > 0)
            doc_ids = [i for x in held for i in x[0]]
            rows.append((
                (task + made) % parts, batch, None, None, None, [i or 0 for i in doc_ids], [i is None for i in doc_ids], [i for x in held for i in x[1]], (n + 1).tolist(), known.tolist(), total.tolist(),
                rest_row[lead].tolist(), rest_h[lead].view(np.int64).tolist(), np.diff(np.append(lead, len(order))).tolist(), None,
            ))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

        for batch in batches:
            for part in pieces(batch):
                found = words_of(part.column(2))
                out = np.array(part.column(1).to_pylist(), bool)
                if held and docs + part.num_rows > BATCH_DOCS:
                    yield packed()
                    held, places, docs, made = [], 0, 0, made + 1
                for a in range(0, part.num_rows, BATCH_DOCS):
                    b = min(part.num_rows, a + BATCH_DOCS)
                    one, rows = found.hash[found.first[a] : found.first[b]], b - a
                    held.append((part.column(0)[a:b].to_pylist(), out[a:b].tolist(), ~out[a:b], np.diff(found.first[a : b + 1]), one))
                    places, docs = places + len(one) + rows, docs + rows
                    if places >= BATCH or docs >= BATCH_DOCS:
                        yield packed()
                        held, places, docs, made = [], 0, 0, made + 1
        if held:
            yield packed()

    return run


#: Distinct (split word, next word) of a batch and a part, with their training places; a part's counts of such pairs.
PAIR = [("part", np.uint16), ("near", np.uint32), ("word", np.uint64), ("n", np.uint32)]
COUNT = [("near", np.uint32), ("word", np.uint64), ("c", np.int64)]
COUNTED = "part long, counts binary, near array<long>, gains array<array<double>>"


def _send_pairs(sent, parts: int, homes: int):
    """Pairs of split words and their next words by home, for each part that holds any of their places."""

    def run(batches):
        words: Words = sent.value
        for batch in batches:
            for piece in pieces(batch):
                found = words_of(piece.column(2))
                learn = ~np.array(piece.column(1).to_pylist(), bool)
                n = np.diff(found.first)
                doc, _, _, ids, nearest, near_ids, before_ids = _places(words, n, found.hash[found.first[0] : found.first[-1]])
                at = np.flatnonzero(words.split(nearest))
                if not len(at):
                    continue
                near, word, learned = near_ids[at], ids[at], learn[doc[at]]
                part = words.part_of(near, nearest[at], before_ids[at], parts)
                home = _pair_key(near, word) % np.uint64(homes)
                order = np.lexsort((word, (part << np.uint64(32)) | near, home))
                home, part, near, word, learned = (x[order] for x in (home, part, near, word, learned))
                new = np.ones(len(home), bool)
                new[1:] = (part[1:] != part[:-1]) | (near[1:] != near[:-1]) | (word[1:] != word[:-1])
                first = np.flatnonzero(new)
                count = np.add.reduceat(learned.astype(np.int64), first)
                own, start = np.unique(home[first], return_index=True)
                end = np.append(start, len(first))[1:]
                blobs = [_packed(PAIR, part[first[a:b]], near[first[a:b]], word[first[a:b]], count[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(blobs, pa.binary())], ["home", "pairs"])

    return run


def _count_pairs(sent):
    """Counts of one home's pairs for the parts that hold them, and the gains of its pairs by split word and weight."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words: Words = sent.value
        opened = [_opened(PAIR, x) for x in pdf["pairs"]]
        part, near, word, n = (np.concatenate([x[name] for x in opened]) for name, _ in PAIR)
        order = np.lexsort((part, word, near))
        part, near, word, n = part[order], near[order], word[order], n[order].astype(np.int64)
        new = np.ones(len(near), bool)
        new[1:] = (near[1:] != near[:-1]) | (word[1:] != word[:-1])
        pair, c = np.cumsum(new) - 1, np.add.reduceat(n, np.flatnonzero(new))
        once = np.ones(len(near), bool)
        once[1:] = new[1:] | (part[1:] != part[:-1])
        at = np.flatnonzero(once & (c[pair] > 0))
        at = at[np.argsort(part[at], kind="stable")]
        own, start = np.unique(part[at], return_index=True)
        out = []
        for p, a, b in zip(own.tolist(), start.tolist(), np.append(start, len(at))[1:].tolist(), strict=True):
            x = at[a:b]
            out.append((p, _packed(COUNT, near[x], word[x], c[pair[x]]), None, None))
        first = np.flatnonzero(new)[c > 0]
        c, split, group = c[c > 0].astype(float), *np.unique(near[first], return_inverse=True)
        p = words.p_of(word[first])
        total = [np.bincount(group, weights=c * np.log((c - 1 + w * p) / ((words.count[split].astype(float)[group] - 1 + w) * p)), minlength=len(split)) for w in WEIGHTS]
        out.append((None, None, split.astype(np.int64), np.stack(total, axis=1).tolist()))
        return pd.DataFrame(out, columns=["part", "counts", "near", "gains"])

    return run


def _weights(words: Words, near: np.ndarray, gains: list[np.ndarray]) -> np.ndarray:
    """The weights of split words' contexts by code, as :func:`retain` chooses them."""
    best, weight = np.full(len(near), DIVERGENCE), np.zeros(len(near))
    for w, total in zip(WEIGHTS, gains, strict=True):
        better = total >= best
        best[better], weight[better] = total[better], w
    out = np.zeros(len(words.count))
    out[near] = weight
    return out


def _after_split(words: Words, near_code: np.ndarray, near: np.ndarray, word: np.ndarray, blobs) -> tuple[np.ndarray, np.ndarray]:
    """a and b of places after split words, whose pairs' counts are given."""
    opened = [_opened(COUNT, x) for x in blobs]
    known, word_of, count = (np.concatenate([np.zeros(0, kind), *[x[name] for x in opened]]) for name, kind in COUNT)
    c = np.zeros(len(near))
    if len(known):
        key = _pair_key(known.astype(np.uint64), word_of)
        order = np.argsort(key)
        key, count = key[order], count[order]
        wanted = _pair_key(near, word)
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        c = np.where(key[at] == wanted, count[at], 0).astype(float)
    w, n = words.weight[near_code], words.count[near_code].astype(float)
    return np.where(w > 0, c / np.where(w > 0, n + w, 1), 0.0), np.where(w > 0, w / np.where(w > 0, n + w, 1), 1.0)


def retain(group: np.ndarray, n: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The weight of each context towards its suffix, 0 if it is not retained.

    ``n``: training places by context; ``group``, ``c`` and ``p``: context, count and the suffix's probability by
    distinct (context, next symbol).
    """
    best, weight = np.full(len(n), DIVERGENCE), np.zeros(len(n))
    seen = c > 0
    group, c, p = group[seen], c[seen], p[seen]
    for w in WEIGHTS:
        gain = c * np.log((c - 1 + w * p) / ((n[group] - 1 + w) * p))
        total = np.bincount(group, weights=gain, minlength=len(n))
        better = total >= best
        best[better], weight[better] = total[better], w
    return weight


def _deeper(context: np.ndarray, symbol: np.ndarray, symbols: int, learned: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b of the probability a + b p of each place, from those of the suffixes, after contexts of one more word."""
    pair, first, back = np.unique(context * symbols + symbol, return_index=True, return_inverse=True)
    n = np.bincount(context, weights=learned)
    c = np.bincount(back, weights=learned, minlength=len(pair))
    weight = retain(context[first], n, c, (a + b * p)[first])
    on = weight[context] > 0
    w, n = weight[context], n[context]
    return np.where(on, (c[back] + w * a) / np.where(on, n + w, 1), a), np.where(on, w * b / np.where(on, n + w, 1), b)


RETURNED = "batch long, ids array<long>, no_id array<boolean>, held array<boolean>, tokens array<long>, known array<long>, base array<double>, rest_doc array<int>, rest_key array<long>, rest_times array<int>, gains binary, open binary"
#: What returns is packed by column, in single precision: a document's gain from one part, and places whose word
#: is not frequent, where the probability is a + b p.
GAIN = [("doc", np.uint16), ("gain", np.float32)]
OPEN = [("doc", np.uint16), ("times", np.uint32), ("key", np.int64), ("a", np.float32), ("b", np.float32)]
#: Ids of words that are not frequent, without their top bit.
BARE = (1 << 63) - 1


def _score_part(sent):
    """Learns the subtrees of one part and scores its places: sums by document, and places whose word's p is not known here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words: Words = sent.value
        heads = pdf[pdf["places"].isna() & pdf["counts"].isna()]
        names = [c.split()[0] for c in RETURNED.split(", ")]
        none = dict.fromkeys(names)
        out = [{**none, **dict(zip(_NAMES, r, strict=True))} for r in heads.itertuples(index=False, name=None)]
        slices = pdf[pdf["places"].notna()]
        if len(slices):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for n, raw, blob in zip(slices["n"].astype(int), slices["raw"].astype(int), slices["places"], strict=True):
                flat = _unpacked(blob, raw)
                at, codes = 0, []
                for _ in range(3):
                    own, at = _column(flat, at, n, np.uint32)
                    codes.append(own)
                tag, at = _column(flat, at, n, np.uint16)
                times, at = _column(flat, at, n, np.uint32)
                for k, code in enumerate(codes):
                    rare = code == RARE
                    own = code.astype(np.uint64)
                    own[rare], at = _column(flat, at, int(rare.sum()), np.uint64)
                    columns[k].append(own)
                columns[3].append(tag)
                columns[4].append(times)
            word, nearest, before, tag, times = (np.concatenate(c) for c in columns)
            near_code = np.where(nearest >> np.uint64(63) > 0, np.uint64(RARE), nearest).astype(np.uint32)
            learned = np.where(tag & TRAINS, times, 0).astype(float)
            symbols, symbol = np.unique(word, return_inverse=True)
            rare = symbols >> np.uint64(63) > 0
            p = words.p_of(symbols)[symbol]
            _, one = np.unique(mix(nearest + words.class_of(near_code, before) * _K), return_inverse=True)
            _, two = np.unique(mix(before + mix(nearest + _K)), return_inverse=True)
            a, b = np.zeros(len(word)), np.ones(len(word))
            split = np.flatnonzero(words.split(near_code))
            for context in (one, two):
                a, b = _deeper(context, symbol, len(symbols), learned, a, b, p)
                if context is one and len(split):
                    a[split], b[split] = _after_split(words, near_code[split], nearest[split], word[split], pdf["counts"].dropna())
            unknown = rare[symbol]
            open_ = unknown & (a > 0)
            gain = np.where(open_, 0.0, np.log10(np.where(unknown, b, a / p + b))) * times
            doc, end = (tag & (TRAINS - 1)).astype(np.int64), np.cumsum(slices["n"].astype(int).to_numpy())
            for batch, s, e in zip(slices["batch"], np.append(0, end[:-1]).tolist(), end.tolist(), strict=True):
                own, back = np.unique(doc[s:e], return_inverse=True)
                at = s + np.flatnonzero(open_[s:e])
                at = at[np.argsort(doc[at], kind="stable")]
                out.append({
                    **none, "batch": batch, "gains": _packed(GAIN, own, np.bincount(back, weights=gain[s:e])),
                    "open": _packed(OPEN, doc[at], times[at], (word[at] & np.uint64(BARE)).view(np.int64), a[at], b[at]),
                })
        return pd.DataFrame(out, columns=names)

    return run


SCORED = "row array<long>, doc_id array<long>, no_id array<boolean>, held_out array<boolean>, n_tokens array<long>, known array<long>, base array<double>, gain array<double>, rest_row array<long>, rest_key array<long>, rest_times array<long>, rest_a array<double>, rest_b array<double>"


def _assemble(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a batch: its documents with the sums of all parts, and the words to join with their counts.

    ``rest``: words of the base (a below 0), and open places.
    """
    head = pdf[pdf["ids"].notna()].iloc[0]
    parts = pdf[pdf["ids"].isna()]
    total = np.zeros(len(head["ids"]))
    for blob in parts["gains"]:
        rows = _opened(GAIN, blob)
        total[rows["doc"]] += rows["gain"]
    opened = [_opened(OPEN, x) for x in parts["open"]]
    left = {name: np.concatenate([np.zeros(0, kind), *[x[name] for x in opened]]) for name, kind in OPEN}
    n = len(head["rest_doc"])
    row = int(head["batch"]) * BATCH_DOCS + np.arange(len(total))
    joined = lambda own, name: np.concatenate((own, left[name]))
    out = [
        row, head["ids"], head["no_id"], head["held"], head["tokens"], head["known"], head["base"], total, row[joined(np.asarray(head["rest_doc"], np.int64), "doc")],
        joined(np.asarray(head["rest_key"], np.int64) & BARE, "key"), joined(np.asarray(head["rest_times"], np.int64), "times"), joined(np.full(n, -1.0), "a"), joined(np.zeros(n), "b"),
    ]
    return pd.DataFrame([out], columns=[c.split()[0] for c in SCORED.split(", ")])


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    The model learns from documents whose crc32 of the id modulo ``folds`` is not ``held``.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, folds) == held).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.select("text", (~F.col("held_out")).alias("learn")).mapInArrow(_count_words, "key long, n long, everywhere long")
    words = stage(counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere")), "suffix-words")
    sums = words.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("v"), F.sum("everywhere").alias("all")).first()
    n, v, everywhere = sums["n"] or 0, sums["v"] or 0, sums["all"] or 0
    end = words.filter(F.col("key") == int(END_WORD)).first()
    c_end = end["n"] if end else 0
    often = words.filter((F.col("everywhere") >= P_WORD * everywhere) & (F.col("key") != int(END_WORD))).select("key", "n").toArrow()  # at most 1 / P_WORD
    key, count = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
    known = Words(key, np.concatenate(([c_end], count)), n, v, P_WORD * everywhere)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(PARTS, max(shuffled, -(-everywhere // PART)))
    sent, pairs = spark.sparkContext.broadcast(known), None
    if (known.classes > 1).any():
        homes = max(shuffled, parts // 8)
        pairs = texts.mapInArrow(_send_pairs(sent, parts, homes), "home long, pairs binary")
        pairs = stage(pairs.groupBy("home").applyInPandas(_count_pairs(sent), COUNTED), "suffix-pairs")
        gains = pairs.filter("gains is not null").select(F.explode(F.arrays_zip("near", "gains")).alias("x")).groupBy("x.near")
        gains = gains.agg(*[F.sum(F.col("x.gains")[k]).alias(f"g{k}") for k in range(len(WEIGHTS))]).toArrow()  # split words, at most places / CLASS
        known.weight = _weights(known, gains.column(0).to_numpy(), [gains.column(k + 1).to_numpy() for k in range(len(WEIGHTS))])
        sent = spark.sparkContext.broadcast(known)
    places = texts.mapInArrow(_send_places(sent, parts), SENT)
    if pairs is not None:
        places = places.unionByName(pairs.filter("counts is not null").select("part", "counts"), allowMissingColumns=True)
    scored = places.groupBy("part").applyInPandas(_score_part(sent), RETURNED).groupBy("batch").applyInPandas(_assemble, SCORED)
    scored = stage(scored, "suffix-scored")
    p = F.expr(f"(coalesce(n, 0) + 0.5D) / ({n} + 0.5D * ({v} + 1))")
    unzipped = lambda names: scored.select(F.explode(F.arrays_zip(*names)).alias("x")).select("x.*")
    rest = unzipped(["rest_row", "rest_key", "rest_times", "rest_a", "rest_b"]).toDF("row", "key", "times", "a", "b")
    counts = words.filter("n > 0").select(F.col("key").bitwiseAND(BARE).alias("key"), "n")
    rest = rest.join(counts.groupBy("key").agg(F.sum("n").alias("n")), "key", "left").withColumn("p", p)
    bare = F.col("a") < 0
    rest = rest.groupBy("row").agg(
        F.sum(F.when(bare, F.col("times") * F.log10("p"))).alias("rare_base"),
        F.sum(F.when(bare & (F.col("n") > 0), F.col("times"))).alias("rare_known"),
        F.sum(F.when(~bare, F.col("times") * F.log10(F.col("a") / F.col("p") + F.col("b")))).alias("rare_gain"),
    )
    out = unzipped(["row", "doc_id", "no_id", "held_out", "n_tokens", "known", "base", "gain"]).join(rest, "row", "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    return out.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") + F.coalesce("rare_gain", F.lit(0.0))).alias("score"),
    )
