"""Vectorised scanning of Arrow text columns: words and their 64-bit hashes without a Python object per word.

A batch's texts lie end to end in one UTF-8 buffer. Words are found by one table look-up per byte, and
a word's hash is a difference of prefix sums of a polynomial hash (random value per byte, arithmetic
modulo 2**64) taken back to position 0 with the inverse power, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that end a word: the six ASCII white-space characters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that end a word of letters and digits: ASCII characters other than 0-9, A-Z, a-z.
PUNCT = np.zeros(256, bool)
PUNCT[:0x80] = True
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    start: np.ndarray  #: byte at which each word starts
    end: np.ndarray  #: byte after its last
    row: np.ndarray  #: row it belongs to
    first: np.ndarray  #: for each row, and one past the last: index of its first word
    hash: np.ndarray  #: 64-bit hash of the lower-cased word


def words_of(column: pa.Array, ends: np.ndarray = SPACE, hashed: bool = True, fold: np.ndarray = LOWER) -> Words:
    """All words of all rows. ``ends`` tells which bytes separate words, ``fold`` what bytes count as in hashes (A-Z are lower-cased)."""
    raw, at = buffer_of(column)
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    if n:
        np.logical_not(ends[raw], out=inside[1:-1])
    # a boundary between rows separates as well: compare each byte with the one before in the same row
    is_start = inside[1:] & ~inside[:-1]
    is_end = inside[:-1] & ~inside[1:]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    touching = cut[inside[cut] & inside[cut + 1]]
    is_start[touching] = True
    is_end[touching] = True
    start, end = np.flatnonzero(is_start), np.flatnonzero(is_end)
    first = np.searchsorted(start, at, side="left")
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    if hashed and len(start):
        value = _RANDOM[fold[raw]] * _power(_BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        h = (total[end] - total[start]) * _power(_INVERSE, n + 1)[start]
        h = mix(h ^ ((end - start).astype(np.uint64) << np.uint64(56)))
    else:
        h = np.zeros(len(start), np.uint64)
    return Words(start, end, row, first, h)


def joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words ``raw[start:end]`` one after the other, each followed by a blank, and where each begins and ends."""
    size = end - start
    begin = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    at = np.arange(int(size.sum()))
    out[at + np.repeat(np.arange(len(size)), size)] = fold[raw[at + np.repeat(start - (np.cumsum(size) - size), size)]]
    return out, begin, begin + size


def rolled(h: np.ndarray, begin: np.ndarray, size: np.ndarray | int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` values of ``h`` from ``begin`` on; runs of other lengths differ too."""
    value = (mix(h ^ np.uint64(salt)) if salt else h) * _power(_BASE, len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    own = (total[begin + size] - total[begin]) * _power(_INVERSE, len(h) + 1)[begin]
    return mix(own + np.asarray(size).astype(np.uint64) * np.uint64(_SPREAD[0]))


_SPREAD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' distinct runs of ``size`` words, sorted within each row, and each row's first index.

    A row of fewer words, but not none, has its whole word sequence as one shingle; the sequence's
    length is part of the hash.
    """
    h, first = words.hash, words.first
    count = np.diff(first)
    out, at = [], [0]
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        if len(rolled):
            rolled += h[k : k + len(rolled)] * np.uint64(_SPREAD[k % 5] + 2 * (k // 5))
    rolled = mix(rolled)
    total = 0
    for i, n in enumerate(count.tolist()):
        if n >= size:
            own = np.sort(rolled[first[i] : first[i] + n - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            part = np.uint64(n)
            for k in range(n):
                part = mix(np.array([part ^ h[first[i] + k]], np.uint64) * np.uint64(_SPREAD[k % 5]))[0]
            own = np.array([part], np.uint64)
        else:
            own = np.zeros(0, np.uint64)
        total += len(own)
        out.append(own)
        at.append(total)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(at, np.int64)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 19):
    """Slices of a batch with about ``limit`` bytes of text each (a longer row stands alone).

    Scanning takes some tens of bytes of memory per byte of a slice, so slices are small.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if not batch.num_rows:
        return
    _, at = buffer_of(col)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
    del col, at
    pa.default_memory_pool().release_unused()
