"""Hard negatives by bit-sliced integer products.

Rows are packed once, where they are read, into chunks: ids, labels and the
bit-planes of the integer components (two's complement, the most significant plane
first). The anchors of several chunks form a block, the chunks of the table form
slices, and one group of the job compares one block with one slice, so that no group
holds more than a bounded number of anchors and rows. Inside a group the planes of a
chunk are taken from the top: after each plane every product is known to lie between
two bounds, which the planes that are left narrow by half each time, and a pair whose
bounds can't reach the best scores found so far, or lie outside all bands that are
asked for, is dropped. What is left after the last plane has its exact product.

The first pass finds the positives of every anchor, the second one the rows of other
labels whose products lie in a band of each positive's. Both end in a window over the
best few rows of each slice.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; an empty vector has product 0 with any other; of vectors of
different lengths the shorter one is filled with zeros; a null id is never an anchor
and is the largest among equal scores; repeated rows are rows of their own, and an
anchor's copy can be its positive; equal scores go by id; an empty table gives an
empty table; other columns are ignored. Integer components or products of 2^50 or
more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalore.session import bound_batches, materialize, ship, shuffle_partitions

#: Rows of a chunk, anchors of a block (about), rows of a slice (at most about), anchors that are compared at once.
CHUNK, BLOCK, SLICE, TILE = 2048, 8192, 1 << 19, 256
#: No product, and so no component, may reach this.
LIMIT = 1 << 50
_NONE = np.iinfo(np.int64).min + 1
_LAST = np.iinfo(np.int64).max

_PACKED = "chunk long, n int, dims int, width int, ids array<bigint>, labels array<bigint>, planes binary, rows array<int>, anchor_ids array<bigint>, anchor_labels array<bigint>, anchor_planes binary"


def planes_needed(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1).bit_length() + 1


def to_planes(values: np.ndarray, width: int) -> bytes:
    """Bit-planes of integers (rows x components), the sign plane first."""
    return b"".join(np.packbits((values >> b & 1).astype(np.uint8), axis=1).tobytes() for b in range(width - 1, -1, -1))


def plane(planes: bytes, number: int, n: int, dims: int) -> np.ndarray:
    """One plane as 0 and 1 (rows x components)."""
    size = n * (-(-dims // 8))
    return np.unpackbits(np.frombuffer(planes, np.uint8, size, number * size).reshape(n, -1), axis=1, count=dims)


def from_planes(planes: bytes, width: int, n: int, dims: int) -> np.ndarray:
    out = np.zeros((n, dims), np.int64)
    for k in range(width):
        out += plane(planes, k, n, dims).astype(np.int64) * weight(k, width)
    return out


def weight(number: int, width: int) -> int:
    """What a bit of a plane counts; the first plane has the sign."""
    return -(1 << width - 1) if number == 0 else 1 << width - 1 - number


def integers(vectors: pa.ListArray, scale: float) -> np.ndarray:
    """floor(scale * x) of lists of floats, rows x components, short rows filled with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() >= LIMIT:
        raise ArithmeticError("an integer component is too large for exact products")
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _pack(rows: DataFrame, scale: float) -> DataFrame:
    """Chunks of (id, label, anchor, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.hard_negatives import CHUNK, integers, planes_needed, to_planes
        from stratalore.llm.token_files import gathered

        base, number = TaskContext.get().partitionId() << 32, 0
        for big in gathered(batches, 16 << 20):
            for at in range(0, big.num_rows, CHUNK):
                b = big.slice(at, CHUNK)
                b = b.take(pa.compute.sort_indices(b.column(0)))  # null ids last
                values = integers(b.column(3), scale)
                chosen = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
                width, picked = planes_needed(values), pa.array(chosen)
                lists = [x.to_pylist() for x in (b.column(0), b.column(1), picked, b.column(0).take(picked), b.column(1).take(picked))]
                row = [base + number, len(values), values.shape[1], width, *lists[:2], to_planes(values, width), *lists[2:], to_planes(values[chosen], width)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)
                number += 1

    many = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), many, many, pa.binary(), pa.list_(pa.int32()), many, many, pa.binary()]
    names = [x.split()[0] for x in _PACKED.split(", ")]
    return rows.mapInArrow(run, _PACKED)


@dataclass
class Anchors:
    """Anchors of a block, their bands (anchors x bands), and the best rows found for each band."""

    chunk: np.ndarray
    at: np.ndarray
    row: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    low: np.ndarray
    high: np.ndarray
    keep: int

    def __post_init__(self):
        self.scores = np.full((*self.low.shape, self.keep), _NONE)
        self.found = np.full((*self.low.shape, self.keep), _LAST)

    def compare(self, chunk: int, ids: np.ndarray, labels: np.ndarray, planes: bytes, width: int, dims: int, same: bool) -> None:
        """Takes the rows of one chunk into the best ones; ``same``: rows of the anchor's label, else of others."""
        for a in range(0, len(self.ids), TILE):
            part = slice(a, a + TILE)
            alive = (self.labels[part, None] == labels) == same
            own = np.flatnonzero(self.chunk[part] == chunk)
            alive[own, self.row[part][own]] = False
            alive &= (self.low[part] <= self.high[part]).any(axis=1)[:, None]
            if alive.any():
                self._take(part, ids, self._products(part, planes, width, len(ids), dims, alive))

    def _reach(self, part: slice, low: np.ndarray, high: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Whether products between two bounds can lie in a band and reach its best rows."""
        at = slice(None) if rows is None else rows
        least, most = np.maximum(self.low[part], self.scores[part, :, -1])[at], self.high[part][at]
        out = np.zeros(low.shape, bool)
        for k in range(least.shape[1]):
            x, y = (least[:, k], most[:, k]) if rows is not None else (least[:, k, None], most[:, k, None])
            out |= (high >= x) & (low <= y)
        return out

    def _products(self, part: slice, planes: bytes, width: int, n: int, dims: int, alive: np.ndarray) -> np.ndarray:
        """Products of the pairs that can matter (anchors x rows); ``_NONE`` for others."""
        both = min(dims, self.values.shape[1])
        a = self.values[part, :both]
        plus, minus = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
        most = int((plus - minus).max(initial=0))
        if most * (1 << width - 1) >= LIMIT:
            raise ArithmeticError("a product is too large")
        kind = np.float32 if most < 1 << 24 else np.float64
        floats, out = a.astype(kind), np.full(alive.shape, _NONE)
        known, columns, pairs = np.zeros(alive.shape, np.int64), np.arange(n), None
        for k in range(width):
            bits, rest = plane(planes, k, n, dims)[:, :both], (1 << width - 1 - k) - 1
            if pairs is None:
                known += weight(k, width) * (floats @ bits[columns].T.astype(kind)).astype(np.int64)
                alive &= self._reach(part, known + rest * minus[:, None], known + rest * plus[:, None])
                if 64 * np.count_nonzero(alive) < alive.size:  # few are left: go on pair by pair
                    i, j = np.nonzero(alive)
                    known, pairs = known[i, j], (i, columns[j])
                elif 2 * np.count_nonzero(some := alive.any(axis=0)) < len(columns):
                    known, alive, columns = known[:, some], alive[:, some], columns[some]
            else:
                i, j = pairs
                known += weight(k, width) * np.einsum("pd,pd->p", a[i], bits[j], dtype=np.int64)
                left = self._reach(part, known + rest * minus[i], known + rest * plus[i], i)
                known, pairs = known[left], (i[left], j[left])
        if pairs is None:
            i, j = np.nonzero(alive)
            out[i, columns[j]] = known[i, j]
        else:
            out[pairs] = known
        return out

    def _take(self, part: slice, ids: np.ndarray, products: np.ndarray) -> None:
        n, k = products.shape[1], self.keep
        # Rows of a chunk are in id order, so of equal products the first one is wanted: no two keys are equal.
        keys = np.where(products == _NONE, _NONE, products * n + (n - 1 - np.arange(n)))
        for band in range(self.low.shape[1]):
            low, high = self.low[part, band, None], self.high[part, band, None]
            mine = np.where((products >= low) & (products <= high), keys, _NONE)
            rows = np.flatnonzero((mine != _NONE).any(axis=1))
            if not len(rows):
                continue
            mine = mine[rows]
            top = np.argpartition(mine, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), mine.shape)
            there = np.take_along_axis(mine, top, axis=1) != _NONE
            new = np.where(there, np.take_along_axis(products[rows], top, axis=1), _NONE)
            at = rows + part.start
            scores = np.concatenate((self.scores[at, band], new), axis=1)
            found = np.concatenate((self.found[at, band], np.where(there, ids[top], _LAST)), axis=1)
            order = np.lexsort((found, -scores), axis=1)[:, :k]
            self.scores[at, band] = np.take_along_axis(scores, order, axis=1)
            self.found[at, band] = np.take_along_axis(found, order, axis=1)


def _numbers(lists: list) -> np.ndarray:
    """Values of lists in one array; a null is the largest number."""
    return np.array([_LAST if x is None else x for xs in lists for x in xs], np.int64)


def _anchors(left: pa.Table, keep: int) -> Anchors:
    rows = left.to_pylist()
    parts = [from_planes(r["anchor_planes"], r["width"], len(r["rows"]), r["dims"]) for r in rows]
    values = np.zeros((sum(map(len, parts)), max(p.shape[1] for p in parts)), np.int64)
    at = 0
    for p in parts:
        values[at : at + len(p), : p.shape[1]] = p
        at += len(p)
    sizes = [len(r["rows"]) for r in rows]
    places = np.concatenate([np.arange(n) for n in sizes])
    low, high = np.full((len(values), 1), _NONE), np.full((len(values), 1), _LAST)
    if "bands" in left.column_names:
        ranks = max(b["rank"] for r in rows for b in r["bands"])
        low, high = np.full((len(values), ranks), _LAST), np.full((len(values), ranks), _NONE)
        start = 0
        for r, n in zip(rows, sizes, strict=True):
            for b in r["bands"]:
                low[start + b["at"], b["rank"] - 1], high[start + b["at"], b["rank"] - 1] = b["low"], b["high"]
            start += n
    return Anchors(np.repeat([r["chunk"] for r in rows], sizes), places, _numbers([r["rows"] for r in rows]), _numbers([r["anchor_ids"] for r in rows]), _numbers([r["anchor_labels"] for r in rows]), values, low, high, keep)


_FOUND = "chunk long, at int, band int, id long, score long"


def _best(left: pa.Table, right: pa.Table, keep: int, same: bool) -> pa.Table:
    """The best rows of one slice for each anchor and band of one block."""
    schema = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("band", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    anchors = _anchors(left, keep)
    for batch in right.to_batches(max_chunksize=1):
        r = batch.to_pylist()[0]
        anchors.compare(r["chunk"], _numbers([r["ids"]]), _numbers([r["labels"]]), r["planes"], r["width"], r["dims"], same)
    i, band, k = np.nonzero(anchors.scores != _NONE)
    ids = anchors.found[i, band, k]
    return pa.table([pa.array(anchors.chunk[i]), pa.array(anchors.at[i].astype(np.int32)), pa.array(band.astype(np.int32) + 1), pa.array(ids, mask=ids == _LAST), pa.array(anchors.scores[i, band, k])], schema)


def _pass(blocks: DataFrame, chunks: DataFrame, n_blocks: int, n_slices: int, keep: int, same: bool) -> DataFrame:
    """Every block of anchors against every slice of chunks; the best ``keep`` rows of each anchor and band."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from stratalore.llm.hard_negatives import _best

        return _best(left, right, keep, same)

    blocks = blocks.select(*[F.col(c).alias(c) for c in blocks.columns])  # columns of its own: both come from one table
    block, part = F.pmod(F.xxhash64("chunk"), F.lit(n_blocks)), F.pmod(F.xxhash64("chunk", F.lit(1)), F.lit(n_slices))
    left = blocks.withColumn("block", block.cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    right = chunks.withColumn("slice", part.cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    # By name and number, so that adaptive execution doesn't put groups together: they are small in bytes, but much work.
    left, right = (x.repartition(n_blocks * n_slices, "block", "slice") for x in (left, right))
    found = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(run, _FOUND)
    order = Window.partitionBy("chunk", "at", "band").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def usable(vectors: DataFrame, label: Column, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, label, anchor, vector) of the rows that take part."""
    vector = vectors[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(label.isNotNull() & vectors[vector_col].isNotNull() & finite).select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("vector"))


def mine(vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors.

    ``label`` and ``anchor`` are expressions over ``vectors``. An anchor's positives
    are its ``positives`` best rows of its label; the negatives of a positive are the
    ``negatives`` best rows of other labels with ``band[0] * positive_score <= 100 *
    negative_score <= band[1] * positive_score``.
    """
    spark = vectors.sparkSession
    ship(spark)
    bound_batches(spark)
    packed = materialize(_pack(usable(vectors, label, anchor, id_col, vector_col), scale), "vector-chunks")
    total = packed.agg(F.sum("n").alias("n"), F.sum(F.size("rows")).alias("a")).first()
    n, n_anchors = total["n"] or 0, total["a"] or 0
    n_blocks = max(1, -(-n_anchors // BLOCK))
    # Enough groups to keep all tasks busy, and never more rows in one than a task should take at once.
    n_slices = max(1, -(-n // SLICE), min(-(-n // (2 * CHUNK)), -(-2 * shuffle_partitions(spark) // n_blocks)))
    chunks = packed.select("chunk", "n", "dims", "width", "ids", "labels", "planes")
    blocks = packed.where(F.size("rows") > 0).select("chunk", "dims", "width", "rows", "anchor_ids", "anchor_labels", "anchor_planes")
    best = _pass(blocks, chunks, n_blocks, n_slices, positives, same=True)
    pairs = materialize(best.select("chunk", "at", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "anchor-positives")
    # lo = ceil(band * score / 100) and hi = floor(band * score / 100), in integers.
    low, high = F.expr(f"-((-{band[0]} * positive_score - pmod(-{band[0]} * positive_score, 100L)) div 100L)"), F.expr(f"({band[1]} * positive_score - pmod({band[1]} * positive_score, 100L)) div 100L")
    bands = pairs.groupBy("chunk").agg(F.collect_list(F.struct("at", "rank", low.alias("low"), high.alias("high"))).alias("bands"))
    found = _pass(blocks.join(bands, "chunk"), chunks, n_blocks, n_slices, negatives, same=False)
    named = blocks.select("chunk", F.posexplode("anchor_ids").alias("at", "anchor_id"))
    kept = found.select("chunk", "at", F.col("band").alias("pair"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return kept.join(pairs.withColumnRenamed("rank", "pair"), ["chunk", "at", "pair"]).join(named, ["chunk", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
