"""Ranked lexical search by Fagin's threshold algorithm.

The first scan counts the terms of every document where it lies and keeps, for each
shard of documents, a forward index of the terms that the items use: documents, terms
and numbers of occurrences as packed arrays, one row of a written table for each shard.
Term and length statistics over all documents are summed from the shards. The second
scan takes a shard at a time. Its postings are sorted by impact into one list a term,
and each item reads its lists round-robin; a document met for the first time is looked
up in the forward index and scored in full; an item stops when the threshold, which is
the score of a document at all the places reached so far, is strictly below its k-th
score. The best k of each shard meet in a window. No text and no posting is shuffled.

Items are read in blocks of at most ``BLOCK_BYTES``, and only the terms of such a block
are ever broadcast; documents are scanned once for each block.

Defined results: a null or term-less text has no terms and is never found; a null or
term-less item has no rows; items with one id are ranked each for itself; repeated
documents have a rank each; a null doc_id is the largest among equal scores; no items or
no documents give an empty table; texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalore.session import bound_batches, materialize, ship

#: Bytes of item text in one block, of document text in one shard, and postings that a list gives in the first round.
BLOCK_BYTES, SHARD_BYTES, STEP = 16 << 20, 32 << 20, 32
#: Lower-cases A-Z; every other ASCII character but digits and letters parts terms.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_NULL = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD.tobytes()).split()


def term_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All terms of some texts (binary), the row of each, and the number of terms of each row."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    folded = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(folded)]))
    words = lists.flatten().view(pa.binary())
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    real = pc.binary_length(words).to_numpy() > 0
    return words.filter(pa.array(real)), rows[real], np.bincount(rows[real], minlength=len(texts))


def count_terms(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each row; then the wanted terms of the rows: their number in each row, which, and how often."""
    words, rows, n = term_lists(texts)
    found = pc.index_in(words, value_set=terms)
    hit = found.is_valid().to_numpy(zero_copy_only=False)
    key, tf = np.unique(rows[hit] * len(terms) + found.drop_null().to_numpy(), return_counts=True)
    owner, term = np.divmod(key, max(1, len(terms)))
    return n, np.bincount(owner, minlength=len(texts)), term.astype(np.int32), tf


_SHARD = "docs long, terms long, ids array<bigint>, n binary, sizes binary, term binary, tf binary, df array<struct<term:int,docs:bigint>>"


def _index(docs: DataFrame, terms, id_col: str, text_col: str) -> DataFrame:
    """A row for each shard: its documents in the order of the scan and their postings of ``terms`` (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.ranked_search import SHARD_BYTES, count_terms
        from stratalore.llm.token_files import gathered

        wanted, held, size = pa.array(terms.value, pa.binary()), [], 0

        def shard():
            ids = [x for part in held for x in part[0].to_pylist()]
            n, sizes, term, tf = (np.concatenate([part[1][k] for part in held]) for k in range(4))
            seen, df = np.unique(term, return_counts=True)
            row = [int((n > 0).sum()), int(n.sum()), ids, n.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), term.astype("<i4").tobytes(), tf.astype("<i8").tobytes(), [{"term": a, "docs": b} for a, b in zip(seen.tolist(), df.tolist(), strict=True)]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for b in gathered(batches, 8 << 20):
            held.append((b.column(0), count_terms(b.column(1), wanted)))
            size += b.nbytes
            if size >= SHARD_BYTES:
                yield shard()
                held, size = [], 0
        if held:
            yield shard()

    names = [x.split()[0] for x in _SHARD.split(", ")]
    many = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), many, *[pa.binary()] * 4, pa.list_(pa.struct([("term", pa.int32()), ("docs", pa.int64())]))]
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, _SHARD)


class Shard:
    """Forward index and impact-sorted lists of some documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, docs: int, terms: int, vocabulary: int):
        self.ids, self.term = ids, term
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        owner = np.repeat(np.arange(len(ids)), sizes)
        m = 25 + 75 * n * docs // max(terms, 1)
        #: What a posting adds for each unit of its term's weight; at most 10^6.
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[owner])
        order = np.argsort(term.astype(np.int64) << 20 | (1_000_000 - self.impact), kind="stable")
        self.by_impact, self.doc = order, owner[order].astype(np.int32)
        self.list_impact = self.impact[order]
        self.lists = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.of_term = np.zeros(vocabulary, np.int64)
        self.seen = np.zeros(len(ids), bool)
        self.reads = 0

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Full scores of documents by the weights in ``of_term``: lookups in the forward index; each has a posting."""
        from stratalore.llm.token_files import ragged

        sizes = self.ends[docs] - self.starts[docs]
        at = ragged(self.starts[docs], sizes)
        return np.add.reduceat(self.of_term[self.term[at]] * self.impact[at], np.cumsum(sizes) - sizes)

    def top(self, item: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k documents (scores and ids) for an item, a list of terms and their weights times repeats."""
        item = [(t, w) for t, w in item if w > 0 and self.lists[t] < self.lists[t + 1]]
        best, who = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not item:
            return best, who
        begin, end = (self.lists[[t + x for t, _ in item]] for x in (0, 1))
        weights = np.array([w for _, w in item], np.int64)
        self.of_term[[t for t, _ in item]] = weights
        depth, step, met = 0, STEP, []
        while True:
            upto = np.minimum(begin + depth + step, end)
            new = np.unique(np.concatenate([self.doc[a:z] for a, z in zip(np.minimum(begin + depth, end).tolist(), upto.tolist(), strict=True)]))
            new = new[~self.seen[new]]
            self.seen[new] = True
            met.append(new)
            self.reads += len(new)
            if len(new):
                best, who = np.concatenate((best, self.scores(new))), np.concatenate((who, new))
                order = np.lexsort((self.ids[who], -best))[:k]
                best, who = best[order], who[order]
            threshold = int((weights * np.where(upto < end, self.list_impact[upto - 1], 0)).sum())
            if (upto == end).all() or (len(best) == k and threshold < best[-1]):
                break
            depth, step = depth + step, step * 2
        self.seen[np.concatenate(met)] = False
        self.of_term[[t for t, _ in item]] = 0
        return best[best > 0], self.ids[who[best > 0]]


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


_FOUND = "item long, doc_id long, score long"


def _search(index: DataFrame, items, weights, totals: tuple[int, int], k: int) -> DataFrame:
    """The best k documents of each shard for each item; ``items``: term counts, ``weights``: of the terms, both broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.ranked_search import _NULL, Shard

        wanted = [[(t, f * weights.value[t]) for t, f in item] for item in items.value]
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0)[r].values.fill_null(_NULL).to_numpy()
                n, sizes, term, tf = (np.frombuffer(batch.column(c)[r].as_py(), kind) for c, kind in ((1, "<i8"), (2, "<i4"), (3, "<i4"), (4, "<i8")))
                shard = Shard(ids, n, sizes, term, tf, *totals, len(weights.value))
                found = [shard.top(item, k) for item in wanted]
                who = np.concatenate([x[1] for x in found])
                number = np.repeat(np.arange(len(found)), [len(x[1]) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(who, mask=who == _NULL), pa.array(np.concatenate([x[0] for x in found]))], ["item", "doc_id", "score"])

    return index.select("ids", "n", "sizes", "term", "tf").mapInArrow(run, _FOUND)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items as (id, terms and their numbers), in blocks of bounded text; those without a term are left out."""
    block, size = [], 0
    for item, text in items.select(items[id_col], items[text_col].cast("string")).toLocalIterator():
        if terms := Counter(terms_of(text)):
            if block and size + len(text) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((item, terms))
            size += len(text)
    if block:
        yield block


def _rank(docs: DataFrame, block: list[tuple], k: int, id_col: str, text_col: str, item_type) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, counts in block for t in counts})
    place = {t: i for i, t in enumerate(terms)}
    index = materialize(_index(docs, spark.sparkContext.broadcast(terms), id_col, text_col), "term-shards")
    sums = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    totals = (sums["docs"] or 0, sums["terms"] or 0)
    df = index.select(F.inline("df")).groupBy("term").agg(F.sum("docs").alias("docs"))
    weights = [weight(0, totals[0])] * len(terms)
    for row in df.toLocalIterator():
        weights[row["term"]] = weight(row["docs"], totals[0])
    items = spark.sparkContext.broadcast([[(place[t], f) for t, f in counts.items()] for _, counts in block])
    found = _search(index, items, spark.sparkContext.broadcast(weights), totals, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item long, item_id {item_type}")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of each item with a score above 0.

    A term weighs ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; an item's score sums
    ``w * (10^9 tf div (1000 tf + 8 m))`` over its terms, repeats included, with
    ``m = 25 + 75 n N div L`` for a document of n terms; N documents have L terms.
    """
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    kind = items.schema[item_id].dataType.simpleString()
    parts = [_rank(docs, block, k, id_col, text_col, kind) for block in _blocks(items, item_id, item_text)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
