"""Vector compression to short codes: product quantisation trained by Lloyd's rounds over kd-trees.

Components become whole numbers (``floor(scale * x)``), a vector is cut into ``parts`` equal parts, and each
part position has a codebook. Every partition deals its vectors into blocks and builds a kd-tree per
part position over each block, once: an ordering of the block's parts by halving along the widest
side, and for every node its bounding box, sum and count. A round walks the trees with the current
codebooks: of the entries left to a node, the one nearest to the box's middle eliminates each entry
that is farther at the box's corner most in favour of that entry, and so at every point of the box. A node
with one entry left goes to it as a whole, by its cached sum and count; entries that survive to a leaf
are compared with its parts one by one. All arithmetic is of whole numbers, so the result equals plain rounds,
ties included.

What a round sends on is a sum and a count per part position and entry from each task; what is sent to
the tasks are the codebooks. Both are bounded by parameters.

Defined cases: rows whose vector is null or empty or holds a null or non-finite component are dropped, and so are
vectors of another length than that of the smallest kept id's; a length that ``parts`` does not divide
is an error, and so are components whose squares 64 bits cannot sum; fewer vectors than ``entries`` give
smaller codebooks; equal ids are ordered by their vectors, null ids last; repeated rows are coded each; a
null label is a label; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import join_back, stage

#: Bytes of a block's components, and parts of a leaf at most.
BLOCK_BYTES, LEAF = 1 << 20, 16
_TREES = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(name, T.BinaryType()) for name in ("points", "places", "boxes", "sums")]])


def _levels(n: int) -> int:
    """Levels below the root until a node has at most ``LEAF`` of n parts."""
    return max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))


def _bounds(n: int, level: int) -> np.ndarray:
    """Nodes of a level are runs of the ordering; halving n parts gives these ends."""
    return (np.arange((1 << level) + 1) * n) >> level


def _whole(values: np.ndarray, scale: int, most: int) -> np.ndarray:
    whole = np.floor(values * scale)
    if np.abs(whole).max(initial=0) > most:
        raise ValueError(f"a component beyond {most / scale:g} has no exact distance in 64 bits")
    return whole.astype(np.int64)


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, boxes, sums) of a kd-tree over n points; nodes level by level, boxes as (low, high)."""
    n, d = points.shape
    order = np.arange(n)
    boxes, sums = [], []
    for level in range(_levels(n) + 1):
        ends = _bounds(n, level)
        own = points[order]
        low, high = np.minimum.reduceat(own, ends[:-1]), np.maximum.reduceat(own, ends[:-1])
        boxes.append(np.stack([low, high], 1))
        sums.append(np.add.reduceat(own, ends[:-1]))
        if level < _levels(n):
            # sort every node's run along its widest side: the lower half goes to the first child
            side = np.argmax(high - low, axis=1)
            node = np.repeat(np.arange(1 << level), np.diff(ends))
            order = order[np.lexsort((own[np.arange(n), side[node]], node))]
    return order, np.concatenate(boxes), np.concatenate(sums)


def walk(points: np.ndarray, boxes: np.ndarray, sums: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point, entries' sums, entries' counts); points are in the tree's order."""
    n, d = points.shape
    k = len(entries)
    chosen = np.zeros(n, np.int64)
    total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    norm = (entries * entries).sum(1)
    node, left, skip = np.zeros(1, np.int64), np.ones((1, k), bool), 0
    for level in range(_levels(n) + 1):
        ends = _bounds(n, level)
        box = boxes[skip + node]
        # nearest to the middle, in doubled coordinates; ties go to the lower index
        far = (((2 * entries)[None] - (box[:, 0] + box[:, 1])[:, None]) ** 2).sum(2)
        best = np.argmin(np.where(left, far, np.iinfo(np.int64).max), axis=1)
        lead = entries[None] - entries[best][:, None]
        corner = np.where(lead > 0, box[:, 1][:, None], box[:, 0][:, None])
        # distance to an entry less the distance to the best, at the corner where it is least
        more = norm[None] - norm[best][:, None] - 2 * (corner * lead).sum(2)
        index = np.arange(k)[None]
        left &= (index == best[:, None]) | (more < 0) | ((more == 0) & (index < best[:, None]))
        whole = left.sum(1) == 1
        to, at = best[whole], node[whole]
        np.add.at(total, to, sums[skip + at])
        np.add.at(count, to, ends[at + 1] - ends[at])
        for a, b, z in zip(ends[at].tolist(), ends[at + 1].tolist(), to.tolist(), strict=True):
            chosen[a:b] = z
        node, left = node[~whole], left[~whole]
        if level < _levels(n):
            skip += 1 << level
            node, left = np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(left, 2, axis=0)
    if len(node):
        size = ends[node + 1] - ends[node]
        at = np.arange(int(size.sum())) + np.repeat(ends[node] - (np.cumsum(size) - size), size)
        own = points[at]
        far = ((own[:, None] - entries[None]) ** 2).sum(2)
        to = np.argmin(np.where(np.repeat(left, size, axis=0), far, np.iinfo(np.int64).max), axis=1)
        chosen[at] = to
        np.add.at(total, to, own)
        np.add.at(count, to, 1)
    return chosen, total, count


class VectorCodes:
    """Codebooks of ``entries`` entries for each of ``parts`` parts, trained on and applied to all rows of a table."""

    def __init__(self, vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"):
        self.spark = vectors.sparkSession
        self.parts = parts
        vector = F.col(vector_col).cast("array<double>")
        bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
        rows = rows.filter(vector.isNotNull() & (F.size(vector) > 0) & ~bad)
        self.kinds = [rows.schema[c].dataType for c in ("vec_id", "label")]
        order = [F.col("vec_id").asc_nulls_last(), "vector"]
        first = rows.select("vec_id", "vector").orderBy(*order).limit(1).collect()
        self.width = len(first[0]["vector"]) // parts if first else 0
        if first and len(first[0]["vector"]) % parts:
            raise ValueError(f"vectors of {len(first[0]['vector'])} components cannot be cut into {parts} equal parts")
        #: Components up to this size have distances that 64 bits hold.
        self.most = int((2**62 / (16 * max(self.width, 1))) ** 0.5)
        rows = rows.filter(F.size("vector") == self.width * parts)
        start = rows.select("vec_id", "vector").orderBy(*order).limit(entries).collect()
        books = [_whole(np.array(r["vector"]), scale, self.most).reshape(parts, self.width) for r in start]
        self.codebooks = np.stack(books, 1) if start else np.zeros((parts, 0, 0), np.int64)
        self.blocks = stage(self._blocks(rows, scale), "vector-blocks") if start else None
        for _ in range(rounds if start else 0):
            self._round()

    def _blocks(self, rows: DataFrame, scale: int) -> DataFrame:
        parts, width, most = self.parts, self.width, self.most
        size = max(LEAF, BLOCK_BYTES // (4 * parts * width))

        def deal(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    ids, labels, vectors = batch.slice(at, size).columns
                    n = len(ids)
                    whole = _whole(vectors.flatten().to_numpy(zero_copy_only=False), scale, most).reshape(n, parts, width)
                    made = [build(whole[:, p]) for p in range(parts)]
                    row = {
                        "n": n,
                        "points": np.concatenate([whole[order, p] for p, (order, _, _) in enumerate(made)]).astype(np.int32).tobytes(),
                        "places": np.concatenate([order for order, _, _ in made]).astype(np.int32).tobytes(),
                        "boxes": np.concatenate([box for _, box, _ in made]).astype(np.int32).tobytes(),
                        "sums": np.concatenate([total for _, _, total in made]).tobytes(),
                    }
                    lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (ids, labels)]
                    trees = [pa.array([n], pa.int32()), *[pa.array([row[name]], pa.binary()) for name in _TREES.names[1:]]]
                    yield pa.RecordBatch.from_arrays([*lists, *trees], ["vec_id", "label", *_TREES.names])

        lists = [T.StructField(name, T.ArrayType(kind)) for name, kind in zip(("vec_id", "label"), self.kinds, strict=True)]
        return rows.mapInArrow(deal, T.StructType([*lists, *_TREES.fields]))

    def _trees(self):
        """A reader of a block's row: points, places, boxes and sums by part."""
        parts, width = self.parts, self.width

        def read(row: dict) -> tuple[np.ndarray, ...]:
            of = lambda name, kind, *shape: np.frombuffer(row[name], kind).astype(np.int64).reshape(parts, *shape)
            return of("points", np.int32, row["n"], width), of("places", np.int32, row["n"]), of("boxes", np.int32, -1, 2, width), of("sums", np.int64, -1, width)

        return read

    def _round(self) -> None:
        books, read = self.codebooks, self._trees()
        parts, k, width = books.shape

        def sums(batches):
            out = np.zeros((parts, k, width + 1), np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    points, _, boxes, cached = read(row)
                    for p in range(parts):
                        _, total, count = walk(points[p], boxes[p], cached[p], books[p])
                        out[p, :, :width] += total
                        out[p, :, width] += count
            flat = out.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], ["slot", "total"])

        found = np.zeros(parts * k * (width + 1), np.int64)
        for r in self.blocks.select(*_TREES.names).mapInArrow(sums, "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect():
            found[r["slot"]] = r["total"]
        found = found.reshape(books.shape[:2] + (width + 1,))
        count = found[:, :, width:]
        self.codebooks = np.where(count > 0, found[:, :, :width] // np.maximum(count, 1), books)

    @property
    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """vec_id, label, code, error of every kept row."""
        books, read = self.codebooks, self._trees()
        hexes = np.array([f"{k:02x}" for k in range(books.shape[1])])
        schema = T.StructType([T.StructField(name, kind) for name, kind in zip(("vec_id", "label", "code", "error"), [*self.kinds, T.StringType(), T.LongType()], strict=True)])
        if self.blocks is None:
            return self.spark.createDataFrame([], schema)

        def code(batches):
            for batch in batches:
                trees = batch.select(_TREES.names)
                for i, row in enumerate(trees.to_pylist()):
                    points, places, boxes, cached = read(row)
                    names, error = [], np.zeros(row["n"], np.int64)
                    for p in range(len(books)):
                        chosen, _, _ = walk(points[p], boxes[p], cached[p], books[p])
                        at = np.empty(row["n"], np.int64)
                        at[places[p]] = chosen
                        names.append(hexes[at])
                        error[places[p]] += ((points[p] - books[p][chosen]) ** 2).sum(1)
                    text = ["".join(x) for x in zip(*names, strict=True)]
                    one = [batch.column(c).slice(i, 1).flatten() for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*one, pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

        return self.blocks.mapInArrow(code, schema)

    def report(self) -> DataFrame:
        """vec_id, code, error, label_error (errors summed over equal labels), codebooks_sha256."""
        rows = stage(self.codes().withColumn("key", F.struct("label")), "vector-codes")
        sums = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
        whole = join_back(rows, sums, ["key"], "n", rows.count())
        return whole.select("vec_id", "code", "error", "label_error", F.lit(self.digest).alias("codebooks_sha256"))
