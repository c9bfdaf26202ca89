"""One document of each group of near copies: texts that share four fifths of their five-word shingles.

A fingerprint of 64 bits tells texts of that likeness apart by ten bits or so, far beyond
the two that anchors can bridge at a bearable number of replicas. So SimHash links
(``simhash.links``, by anchor-point covering) only propose pairs here, and bands of
min-wise hashes propose more: pairs of a Jaccard similarity of 0.8 share one of
``BANDS`` bands of ``ROWS`` hashes with a probability over 0.999. First, every text is
paired with the first, the last and the most central one of each of its bands. Then all pairs
of a band (or of a fingerprint) that these left in different groups are decided too; pairs
within a group can't change it. Texts of crowded bands are not paired one with another: two sets
of that similarity have a member in common among the rarest of either, and only pairs that have
one (and sizes that fit its place) are made, so no link is lost. Each proposed pair is decided
by its exact similarity, so texts that are merely alike stay, and groups are the components of
the pairs that hold.

One pass makes a narrow profile of each row. Texts with equal sets of shingles are folded
before pairs are made; only the texts of proposed pairs are read a second time, and the
choice goes back to the files as short lists: no whole text is shuffled.

Defined results: a text of fewer than five words is one shingle; texts without words
(null, empty, white space) form one group; the row with the smallest id stays (a null id
is the largest), of equal ids the one with the smallest text key, of equal texts the one
that comes first in the files; repeated rows are copies; an empty table stays empty.
Shingles are compared by 32 bits of a hash, sets by 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalore.llm.components import connected_components
from stratalore.llm.places import Placed
from stratalore.llm.simhash import links, text_key
from stratalore.llm.token_files import gathered, ragged
from stratalore.session import bound_batches, give_back, materialize, ship

SHINGLE, BANDS, ROWS = 5, 20, 5
#: Similarity of near copies, as a fraction.
SIMILARITY = (4, 5)
#: Nodes of a band or fingerprint of which all pairs are made; those of larger ones are paired by rare members of their sets.
CROWD = 8
#: Counters that put members of sets in order; members share them, which changes the number of pairs and no result.
SLOTS = 1 << 16
#: Bytes of text that are profiled at once.
BATCH = 2 << 20
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + np.uint8(32), _BYTES)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(7).integers(0, 2**64, (BANDS * ROWS, 2), np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread bits of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (ASCII letters count as lower case) of some texts, and the number of each text's words."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(low)]))
    words = lists.flatten().view(pa.binary())
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    real = pc.binary_length(words).to_numpy() > 0
    coded = words.dictionary_encode()
    distinct = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return distinct[coded.indices.to_numpy()][real] if len(words) else np.zeros(0, np.uint64), np.bincount(rows[real], minlength=len(texts))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of some texts, in order of their upper 32 bits in each text, and the number of each text's."""
    words, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    owners, hashes = [], []
    for size in range(1, shingle + 1):
        whole = np.flatnonzero(counts == size if size < shingle else counts >= size)
        n = counts[whole] - size + 1
        at = ragged(starts[whole], n)
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            total = total * _MULTIPLIER + words[at + k]
        owners.append(np.repeat(whole, n))
        hashes.append(mixed(total))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    # Texts are fewer than 2^31 in a batch.
    _, first = np.unique(owner.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32), return_index=True)
    return h[first], np.bincount(owner[first], minlength=len(texts))


def _packed(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The upper 32 bits of each text's hashes."""
    data, ends = (h >> np.uint64(32)).astype("<u4").tobytes(), np.cumsum(sizes) * 4
    return [data[z - 4 * n : z] for n, z in zip(sizes.tolist(), ends.tolist(), strict=True)]


def nodes_of(sets: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s) for s in sets], np.uint64).view(np.int64)


def profile(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: a number for its set of shingles, the SimHash fingerprint of the set, and its bands (texts x bands)."""
    h, sizes = shingle_sets(texts, shingle)
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    fp, bands = np.zeros(len(texts), np.uint64), np.zeros((len(texts), BANDS), np.uint64)
    if len(some):
        for k in range(64):
            ones = np.add.reduceat((h >> np.uint64(k) & np.uint64(1)).astype(np.int64), starts)
            fp[some] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(k)
        for k, (a, b) in enumerate(_FACTORS):
            least = np.minimum.reduceat(h * a + b, starts)
            bands[some, k // ROWS] = mixed(bands[some, k // ROWS] * _MULTIPLIER + least + np.uint64(k))
    return nodes_of(_packed(h, sizes)), fp.view(np.int64), bands.view(np.int64)


def _profiles(rows: DataFrame, shingle: int) -> DataFrame:
    """(file, row, doc_id, key, node, fp, bands) of (file, row, doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.near_copies import BATCH, profile

        for b in gathered(batches, BATCH):
            node, fp, bands = profile(b.column(4), shingle)
            # A text without words shares no band with any other.
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(node), pa.array(fp), lists], ["file", "row", "doc_id", "key", "node", "fp", "bands"])
        give_back()

    return rows.mapInArrow(run, "file binary, row long, doc_id long, key binary, node long, fp long, bands array<bigint>")


def _proposed(nodes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (u, v) of nodes that share a band or a SimHash link."""
    in_bands = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    ends = in_bands.groupBy("band", "value").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).where("first < last")
    members = materialize(in_bands.join(ends, ["band", "value"]), "copies-bands")
    # The node that shares its bands with most others is the most central one: an original lies in the bands of all its copies.
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    # Written, so that both sides of the next join are plain tables and the rows of a crowded band can be split.
    central = materialize(members.select("node", "band", "value").join(company, "node").groupBy("band", "value").agg(F.max(F.struct("company", "node"))["node"].alias("central")), "copies-central")
    shared = members.join(central, ["band", "value"]).select(F.col("node").alias("u"), F.explode(F.array("first", "last", "central")).alias("v"))
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "copies-prints")
    same = nodes.join(prints, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    of = lambda name: prints.select(F.col("fp").alias(f"{name}_fp"), F.col("first").alias(name))
    linked = links(prints, threshold).withColumnsRenamed({"u": "u_fp", "v": "v_fp"}).join(of("u"), "u_fp").join(of("v"), "v_fp").select("u", "v")
    both = shared.unionByName(same).unionByName(linked).where("u <> v")
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _apart(nodes: DataFrame, roots: DataFrame, done: DataFrame, sets_of: Callable[[DataFrame], DataFrame] | None = None, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Pairs (u, v) of nodes that share a band or a fingerprint and lie in different groups, but for those in ``done``.

    With ``sets_of``, which gives (node, hashes) of some nodes, nodes of more than ``CROWD`` in a
    band are paired by their sets; pairs that can't be similar are left out then.
    """
    groups = nodes.join(roots, F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("group"), F.posexplode(F.concat("bands", F.array("fp"))).alias("band", "value"))
    groups = materialize(groups, "copies-groups")
    mixed_up = groups.groupBy("band", "value").agg(F.min("group").alias("a"), F.max("group").alias("z"), F.count("*").alias("n")).where("a < z").select("band", "value", "n")
    some = materialize(groups.join(mixed_up, ["band", "value"]), "copies-mixed")
    few = some if sets_of is None else some.where(F.col("n") <= CROWD)
    other = few.select("band", "value", F.col("node").alias("v"), F.col("group").alias("v_group"))
    pairs = few.join(other, ["band", "value"]).where("group <> v_group and node > v").select(F.col("node").alias("u"), "v")
    if sets_of is not None:
        crowd = materialize(some.where(F.col("n") > CROWD).select("node", "group").distinct(), "copies-crowd")
        pairs = pairs.unionByName(_possible(crowd, sets_of(crowd), similarity))
    return pairs.distinct().join(done, ["u", "v"], "left_anti")


def _slots(sets: DataFrame) -> np.ndarray:
    """How many members of all sets (hashes) fall on each of ``SLOTS`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4") % SLOTS, minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    found = sets.select("hashes").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SLOTS, np.int64)
    total[found["slot"].to_numpy()] = found["n"].to_numpy()
    return total


def rarest(h: np.ndarray, slots: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The members of a set, rare slots first, that can be the first in common with a similar set, and the size that it has at most.

    Of two sets of sizes a and b, c members are common. They are similar if whole * c >= part * (a + b - c).
    If the first common one has k others before it, c <= a - k, so b <= (part + whole) * (a - k) / part - a.
    """
    part, whole = similarity
    h = h[np.lexsort((h, slots[h % SLOTS]))]
    most = (part + whole) * (len(h) - np.arange(len(h))) // part - len(h)
    n = int(np.count_nonzero(whole * most >= part * len(h)))
    return h[:n], most[:n]


def _possible(nodes: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of nodes (node, group) in different groups that may be similar by their sets (node, hashes): all that are, and some others."""
    slots = _slots(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.near_copies import rarest

        for b in batches:
            of = [np.frombuffer(x, "<u4") for x in b.column(2).to_pylist()]
            found = [rarest(h, slots, similarity) for h in of]
            at = np.repeat(np.arange(len(of)), [len(h) for h, _ in found])
            if len(at):
                size = np.array([len(h) for h in of])[at]
                member, most = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(member), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(size), pa.array(most)], ["member", "node", "group", "size", "most"])
        give_back()

    posted = materialize(nodes.join(sets, "node").select("node", "group", "hashes").mapInArrow(run, "member long, node long, group long, size long, most long"), "copies-posted")
    in_group = posted.groupBy("member", "group").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("most").alias("most"))
    of_member = in_group.groupBy("member").agg(F.max(F.struct("n", "group"))["group"].alias("main"), F.min("least").alias("low"), F.max("most").alias("high"), F.count("*").alias("groups")).where("groups > 1")
    of_member = materialize(of_member, "copies-members")
    posted = materialize(posted.join(of_member, "member").where("most >= low and size <= high").select("member", "node", "group", "size", "most", "main"), "copies-rare")
    # One node of a pair at least is outside the group that holds the member most often.
    one = posted.where("group <> main").select("member", F.col("node").alias("u"), F.col("group").alias("u_group"), F.col("size").alias("u_size"), F.col("most").alias("u_most"))
    other = posted.select("member", F.col("node").alias("v"), F.col("group").alias("v_group"), F.col("size").alias("v_size"), F.col("most").alias("v_most"))
    pairs = one.join(other, "member").where("u_group <> v_group and u_size <= v_most and v_size <= u_most")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    part, whole = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                common = len(np.intersect1d(x, y, assume_unique=True)) if whole * min(len(x), len(y)) >= part * max(len(x), len(y)) else 0
                keep.append(whole * common >= part * (len(x) + len(y) - common))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    of = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "of_u", "of_v").mapInArrow(run, "u long, v long")


def drop_near_copies(docs: DataFrame, threshold: int = 2, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies; columns stay as they are."""
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark, 1000)
    rows = Placed.of(docs)
    text = rows.df[text_col].cast("string")
    found = materialize(_profiles(rows.df.select(*rows.place, rows.df[id_col].cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text")), shingle), "copies-profiles")
    # Structs compare field by field, so the first says that null ids come last.
    rep = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key", "file", "row")).alias("rep")
    nodes = materialize(found.groupBy("node").agg(rep, F.min("fp").alias("fp"), F.min("bands").alias("bands")), "copies-nodes")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.near_copies import BATCH, _packed, nodes_of, shingle_sets

        for b in gathered(batches, BATCH):
            sets = _packed(*shingle_sets(b.column(0), shingle))
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of(sets)), pa.array(sets, pa.binary())], ["node", "hashes"])
        give_back()

    def sets(named: DataFrame) -> DataFrame:
        """(node, hashes) of the named nodes."""
        # Written before it is read again, so that no task has two Python workers at a time.
        texts = materialize(rows.only(nodes.join(named, "node", "left_semi").select("rep.file", "rep.row"), [text_col]), "copies-texts")
        return materialize(texts.select(F.col(text_col).cast("string")).mapInArrow(sets_of, "node long, hashes binary"), "copies-sets")

    def decided(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        return materialize(_confirmed(pairs, sets(named), similarity), "copies-links")

    def grouped(edges: DataFrame) -> DataFrame:
        return materialize(connected_components(edges).withColumnRenamed("node", "of"), "copies-roots")

    pairs = materialize(_proposed(nodes.select("node", "fp", "bands"), threshold), "copies-pairs")
    found_links = decided(pairs)
    roots = grouped(found_links)
    rest = materialize(_apart(nodes.select("node", "fp", "bands"), roots, pairs, sets, similarity), "copies-apart")
    if not rest.isEmpty() and not (more := decided(rest)).isEmpty():
        roots = grouped(found_links.unionByName(more))
    kept = nodes.select("node", "rep").join(roots, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("rep").alias("rep"))
    return rows.only(kept.select("rep.file", "rep.row"))
