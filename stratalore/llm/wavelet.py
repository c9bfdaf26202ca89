"""Token-id files as wavelet matrices.

A shard holds the ids of consecutive documents (ascending id) in one compressed
file: bit-planes from the highest bit down, each plane listing its bit of all
tokens in the order that stable partitions by the planes above leave, with
running counts of ones every ``BLOCK`` bits. Rank and select on the planes give
token access, counting and occurrence lookup without unpacking the sequence.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"SLWM0001"
#: Bits between two stored running counts of ones.
BLOCK = 512


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, packed: np.ndarray, n: int, counts: np.ndarray | None = None):
        self.packed, self.n = packed, n
        if counts is None:
            step = BLOCK // 8
            padded = np.zeros(-(-max(len(packed), 1) // step) * step, np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.int64)
            counts = np.r_[0, np.cumsum(ones)].astype(np.uint32)
        self.counts = counts
        self.zeros = n - int(counts[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n).view(bool)

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3] >> (7 - (i & 7)) & 1)

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        block = i // BLOCK
        part = self.packed[block * (BLOCK // 8) : (i >> 3) + 1]
        ones = int(self.counts[block]) + int(np.bitwise_count(part).sum())
        if i >> 3 < len(self.packed):
            ones -= int(np.bitwise_count(self.packed[i >> 3] & np.uint8(255 >> (i & 7))))
        return ones

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        edges = self.counts.astype(np.int64) if bit else np.minimum(np.arange(len(self.counts)) * BLOCK, self.n) - self.counts
        block = int(np.searchsorted(edges, k, "right")) - 1
        start = block * BLOCK
        part = np.unpackbits(self.packed[start // 8 : start // 8 + BLOCK // 8], count=min(BLOCK, self.n - start))
        return start + int(np.flatnonzero(part == bit)[k - int(edges[block])])


class WaveletMatrix:
    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n = planes, n

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        kind = np.uint16 if width <= 16 else np.uint32
        left, planes = ids.astype(kind), []
        for k in range(width - 1, -1, -1):
            bit = (left & kind(1 << k)) != 0
            planes.append(Plane(np.packbits(bit), len(left)))
            zeros = planes[-1].zeros
            # By positions: about three times as fast as by a mask that is hard to predict.
            other = np.empty_like(left)
            np.compress(bit, left, out=other[zeros:])
            np.compress(np.logical_not(bit, out=bit), left, out=other[:zeros])
            left = other
        return cls(planes, len(ids))

    def decode(self) -> np.ndarray:
        """All ids in order: the stable partitions are undone from the lowest plane up."""
        width = len(self.planes)
        kind = np.uint16 if width <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for k, plane in enumerate(reversed(self.planes)):
            bit = plane.bits()
            before = np.empty(self.n, kind)
            before[np.flatnonzero(bit)] = ids[plane.zeros :] | kind(1 << k)
            before[np.flatnonzero(np.logical_not(bit, out=bit))] = ids[: plane.zeros]
            ids = before
        return ids

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for plane in self.planes:
            bit = plane.bit(i)
            value = value << 1 | bit
            i = plane.rank(bit, i) + (plane.zeros if bit else 0)
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        width = len(self.planes)
        if token >> width:
            return 0, 0
        for k, plane in enumerate(self.planes):
            bit = token >> (width - 1 - k) & 1
            shift = plane.zeros if bit else 0
            a, b = plane.rank(bit, a) + shift, plane.rank(bit, b) + shift
        return a, b

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``token`` in [start, end)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``; IndexError if there are fewer."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level, plane in reversed([*enumerate(self.planes)]):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = plane.select(bit, i - (plane.zeros if bit else 0))
        return i


class Shard:
    """The documents of one file: ids, token counts and tokens."""

    def __init__(self, doc_ids: np.ndarray, null_ids: int, lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.null_ids, self.lengths, self.matrix = doc_ids, null_ids, lengths, matrix

    @classmethod
    def build(cls, doc_ids: list, lengths: list[int], ids: np.ndarray, width: int) -> Shard:
        """``doc_ids`` ascend, nulls first."""
        nulls = sum(d is None for d in doc_ids)
        return cls(np.array([d or 0 for d in doc_ids], np.int64), nulls, np.array(lengths, np.int64), WaveletMatrix.build(ids, width))

    def to_bytes(self, level: int = 1) -> bytes:
        sections, z = [], zstandard.ZstdCompressor(level=level)
        arrays = [np.diff(self.doc_ids, prepend=np.int64(0)), self.lengths]
        for plane in self.matrix.planes:
            arrays += [plane.packed, np.diff(plane.counts, prepend=np.uint32(0)).astype(np.uint16)]
        sections = [z.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]
        head = json.dumps({"docs": len(self.doc_ids), "null_ids": self.null_ids, "tokens": self.matrix.n, "width": len(self.matrix.planes), "sections": [len(s) for s in sections]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (n,) = struct.unpack("<I", data[8:12])
        head, at = json.loads(data[12 : 12 + n]), 12 + n
        z, parts = zstandard.ZstdDecompressor(), []
        for size in head["sections"]:
            parts.append(z.decompress(data[at : at + size]))
            at += size
        ids = np.cumsum(np.frombuffer(parts[0], np.int64))
        planes = [Plane(np.frombuffer(parts[2 + 2 * k], np.uint8), head["tokens"], np.cumsum(np.frombuffer(parts[3 + 2 * k], np.uint16), dtype=np.uint32)) for k in range(head["width"])]
        return cls(ids, head["null_ids"], np.frombuffer(parts[1], np.int64), WaveletMatrix(planes, head["tokens"]))

    def ids(self) -> list:
        return [None] * self.null_ids + self.doc_ids[self.null_ids :].tolist()
