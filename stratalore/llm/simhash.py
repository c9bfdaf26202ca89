"""SimHash near-duplicate groups by anchor-point covering.

Anchors are the words of a covering code: the product of two binary Golay codes
over bits 0-22 and 23-45 of a fingerprint (the other 18 bits are free). A Golay
code has covering radius 3, so every fingerprint has exactly one *home* anchor
with at most 3 differing bits in either half. A fingerprint y that differs from
x in at most T bits differs from x's home in at most 3 + t1 and 3 + t2 bits with
t1 + t2 <= T. Replicating every fingerprint to all anchors within that reach
(61 on average for T = 2, of 2^24) makes all linked pairs meet at a home, where
fingerprints at home are compared with all others.

Exact copies are folded into one fingerprint before replication. The homes of a
crowded anchor are dealt to several salts and its other rows go to each salt, so
a bucket is split over tasks and a task holds a bounded number of homes. A
bucket emits at most one edge for each row that joins a group, never all pairs.

Defined results: a text without words (null, empty, white space) has fingerprint
0 and is linked like any other; repeated rows stay, one result row each; a null
id takes part, but never names a group unless all ids of the group are null; an
empty table gives an empty table; other columns are ignored by the operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratalore.llm.components import connected_components
from stratalore.llm.places import Placed
from stratalore.session import bound_batches, materialize, ship, shuffle_partitions

SEED = 42
#: Bytes of a text whose words are held at once.
CHUNK = 1 << 20
#: Homes of an anchor that one task compares; a crowded anchor is salted beyond it.
HOMES = 2048
_WHITE = re.compile(rb"[\x20\x09-\x0d]")

# The binary Golay code as a cyclic code: 23 bits, 12 of them free, generator polynomial below.
_LENGTH, _DATA, _GENERATOR, _RADIUS = 23, 12, 0b110001110101, 3
_HALF = (1 << _LENGTH) - 1


def word_runs(data: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from about ``size`` bytes each."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            m = _WHITE.search(data, end)
            end = m.start() if m else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; ASCII letters count as lower case."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    bits, total, carry = np.zeros(64, np.int64), 0, []
    for run in word_runs((data or b"").lower()):
        words = carry + run
        n = len(words) - shingle + 1
        if n > 0:
            hashes = np.fromiter(map(digest, map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))), np.uint64, n)
            for k in range(0, n, 1 << 16):
                part = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                bits += part.sum(axis=0, dtype=np.int64)
            total += n
            words = words[n:]
        carry = words
    if not total:
        return digest(b" ".join(carry)) if carry else 0
    return int.from_bytes(np.packbits(bits * 2 > total, bitorder="little").tobytes(), "little")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; none for a null text."""
    return F.coalesce(F.unhex(F.md5(text.cast("string"))), F.lit(b""))


def _fingerprinted(picked: DataFrame, shingle: int) -> DataFrame:
    """``picked`` with fingerprints (fp long) in place of its last column, the text."""
    ship(picked.sparkSession)
    bound_batches(picked.sparkSession)
    names = [*picked.columns[:-1], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.simhash import fingerprint

        for b in batches:
            got = np.array([fingerprint(t, shingle) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got.view(np.int64))], names)

    return picked.mapInArrow(run, StructType([*picked.schema.fields[:-1], StructField("fp", LongType())]))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row."""
    return _fingerprinted(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), shingle)


@lru_cache(maxsize=2)
def _code(reach: int):
    """Tables of the Golay code: remainder of each byte, leader of each coset, and per coset the nearby words by excess."""

    def rest(x: int) -> int:
        for k in range(_LENGTH - 1, _LENGTH - _DATA - 1, -1):
            if x >> k & 1:
                x ^= _GENERATOR << (k - (_LENGTH - _DATA))
        return x

    by_byte = np.array([[rest(b << s & _HALF) for b in range(256)] for s in (0, 8, 16)], np.int64)
    words = np.array([m << 11 | rest(m << 11) for m in range(1 << _DATA)], np.int64)
    leader = np.zeros(1 << 11, np.int64)
    ones = [1 << k for k in range(_LENGTH)]
    errors = [0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[i + 1 :]), *(a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[i + 1 :], i + 1) for c in ones[j + 1 :])]
    for e in errors:
        leader[rest(e)] = e
    near = []
    for excess in range(reach + 1):
        lists = []
        for s in range(1 << 11):
            away = np.bitwise_count(words ^ leader[s])
            lists.append(words[away <= _RADIUS] if excess == 0 else words[away == _RADIUS + excess])
        sizes = np.array([len(x) for x in lists])
        near.append((np.concatenate(lists), np.cumsum(sizes) - sizes, sizes))
    return by_byte, leader, near


def _home(half: np.ndarray, code) -> tuple[np.ndarray, np.ndarray]:
    """Coset of each 23-bit value and its nearest code word."""
    by_byte, leader, _ = code
    s = by_byte[0][half & 255] ^ by_byte[1][half >> 8 & 255] ^ by_byte[2][half >> 16]
    return s, half ^ leader[s]


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    return (u & np.uint64(_HALF)).astype(np.int64), (u >> np.uint64(_LENGTH) & np.uint64(_HALF)).astype(np.int64)


def _name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Anchor number: the 12 free bits of either code word."""
    return a >> 11 << _DATA | b >> 11


def homes_of(fp: np.ndarray) -> np.ndarray:
    code = _code(2)
    a, b = _halves(fp)
    return _name(_home(a, code)[1], _home(b, code)[1])


def anchors_of(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, at home) of all replicas."""
    code = _code(threshold)
    near = code[2]
    a, b = _halves(fp)
    (sa, ca), (sb, cb) = _home(a, code), _home(b, code)
    rows, names, home = [], [], []
    for ea in range(threshold + 1):
        words_a, first_a, size_a = near[ea]
        for eb in range(threshold + 1 - ea):
            words_b, first_b, size_b = near[eb]
            many = size_a[sa] * size_b[sb]
            at = np.repeat(np.arange(len(fp)), many)
            k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            nb = size_b[sb][at]
            wa = words_a[first_a[sa][at] + k // nb] if len(at) else k
            wb = words_b[first_b[sb][at] + k % nb] if len(at) else k
            rows.append(at)
            names.append(_name(ca[at] ^ wa, cb[at] ^ wb))
            home.append(np.full(len(at), ea + eb == 0))
    return np.concatenate(rows), np.concatenate(names), np.concatenate(home)


class _Groups:
    """Union-find over the rows of one batch."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            q = self.up[r]
            if np.array_equal(q, r):
                self.up[x] = r
                return r
            r = q

    def join(self, a: int, b: int) -> bool:
        while self.up[a] != a:
            a = self.up[a]
        while self.up[b] != b:
            b = self.up[b]
        self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_edges(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links in each bucket; rows sorted by key, homes first."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.empty(0, np.int64)
    last = np.repeat(np.r_[starts[1:], n] - 1, np.diff(np.r_[starts, n])) if n else starts
    groups, left, right = _Groups(n), [], []
    at, k = np.flatnonzero(home), 1
    while True:
        at = at[at + k <= last[at]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= threshold]
        if len(hit):
            hit = hit[groups.find(hit) != groups.find(hit + k)]
            for i in hit.tolist():
                if groups.join(i, i + k):
                    left.append(i)
                    right.append(i + k)
        k += 1
    return fp[left], fp[right]


def links(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (fp) that span every group linked at ``threshold`` bits."""
    spark = nodes.sparkSession

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.simhash import homes_of

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(homes_of(b.column(0).to_numpy()).astype(np.int32))], ["anchor"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.simhash import anchors_of

        for b in batches:
            fp = b.column(0).to_numpy()
            row, name, home = anchors_of(fp, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int32)), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.simhash import bucket_edges

        kept = None  # homes of the bucket that the next batch may go on with
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            fp, home = b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy(zero_copy_only=False)
            if kept is not None and len(key) and kept[0][0] == key[0]:
                key, fp, home = (np.concatenate(x) for x in zip(kept, (key, fp, home), strict=True))
            u, v = bucket_edges(key, fp, home, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
            if len(key):
                tail = (key == key[-1]) & home
                kept = (key[tail], fp[tail], home[tail]) if tail.any() else None

    fps = nodes.select("fp")
    crowded = materialize(fps.mapInArrow(at_home, "anchor int").groupBy("anchor").count().where(F.col("count") > HOMES).select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("salts")), "simhash-crowded")
    salts = F.coalesce("salts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), salts).cast("int")
    dealt = (
        fps.mapInArrow(replicate, "anchor int, fp long, home boolean")
        .join(crowded, "anchor", "left")
        .select("anchor", "fp", "home", own.alias("own"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        .select("anchor", "salt", "fp", (F.col("home") & (F.col("own") == F.col("salt"))).alias("home"))
    )
    buckets = dealt.repartition(shuffle_partitions(spark), "anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))
    return buckets.mapInArrow(compare, "u long, v long").distinct()


def rooted(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, rep, root) of distinct fingerprints (fp, rep); root is a fingerprint and names the group."""
    roots = materialize(connected_components(links(nodes, threshold)), "simhash-roots")
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    found = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    named = rooted(nodes, threshold)
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = materialize(named.join(smallest, "root").select(F.col("fp").alias("of"), "component_id"), "simhash-components")
    return found.join(of_fp, found.fp == of_fp.of).select("doc_id", "fp", "component_id")


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each group of ``docs``, whatever its ids are; columns stay as they are.

    The row with the smallest id stays (a null id is the largest), of equal ids the
    one with the smallest ``text_key``, of equal texts the one that comes first in
    the files. Rows are told apart by their place in the files, so null and repeated
    ids are no special case, and the choice goes back to each file as a short list:
    no text is shuffled.
    """
    rows = Placed.of(docs)
    found = materialize(_fingerprinted(rows.df.select(*rows.place, rows.df["doc_id"].cast("long").alias("doc_id"), text_key(rows.df["text"]).alias("key"), rows.df["text"].cast("string").alias("text")), shingle), "simhash-fp")
    # Structs compare field by field, so the first says that null ids come last.
    nodes = materialize(found.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key", "file", "row")).alias("rep")), "simhash-nodes")
    kept = rooted(nodes, threshold).groupBy("root").agg(F.min("rep").alias("rep")).select("rep.file", "rep.row")
    return rows.only(kept)
