"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the benchmark items; the alphabet is words, so
one step of the search passes over a whole word. With m the length of the
shortest pattern and blocks of two words, a shift table says how far the search
may move on for the block under its end (a block in no pattern skips m - 1
words); where the shift is zero, the block picks the bucket of patterns whose
first m words end in it, a prefix block narrows the bucket, and the words are
compared one by one. Patterns are grouped by length class, so one short item
does not shrink the shifts of the others.

Benchmark windows are read in blocks of at most ``BLOCK_BYTES``, and only such a
block is ever broadcast. With more than one, documents are scanned for each block
where they lie; the hits, named by the rows' places, are written as narrow rows,
and those of a row are put together at the end. No text is written or shuffled.

Defined results: a null or word-less text has 0 words, 0 hits and no items; a
null or word-less item has no windows; repeated items with one id count once,
repeated documents give a row each; no items or no documents work; a null
item_id is left out of the list; other columns are ignored by the operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalore.llm.places import Placed
from stratalore.session import bound_batches, materialize, ship

WINDOW = 13
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z; every other ASCII character but digits and letters parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class WuManber:
    """Search tables of one length class of patterns (tuples of words, all at least m long)."""

    def __init__(self, patterns: dict[tuple[bytes, ...], int]):
        self.m = m = min(map(len, patterns))
        self.block = block = 2 if m > 1 else 1
        self.skip = m - block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, number in patterns.items():
            for end in range(block, m + 1):
                key = p[end - block : end] if block == 2 else p[0]
                if m - end < self.shift.get(key, self.skip):
                    self.shift[key] = m - end
            key = p[m - block : m] if block == 2 else p[0]
            self.buckets.setdefault(key, {}).setdefault(p[:block], []).append((p, number))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(start, end, pattern number) of every occurrence."""
        m, n, block, skip = self.m, len(words), self.block, self.skip
        shift, buckets = self.shift.get, self.buckets
        at = m - 1
        if block == 1:
            for i, w in enumerate(words):
                for p, number in (x for same in buckets.get(w, {}).values() for x in same):
                    if tuple(words[i : i + len(p)]) == p:
                        yield i, i + len(p), number
            return
        while at < n:
            key = (words[at - 1], words[at])
            move = shift(key, skip)
            if move:
                at += move
                continue
            start = at - m + 1
            for p, number in buckets[key].get((words[start], words[start + 1]), ()):
                if tuple(words[start : start + len(p)]) == p:
                    yield start, start + len(p), number
            at += 1


class Patterns:
    """All windows of a block of items, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        numbers: dict[tuple[bytes, ...], int] = {}
        self.items: list[list[str]] = []
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                number = numbers.setdefault(tuple(words[i : i + window]), len(self.items))
                if number == len(self.items):
                    self.items.append([])
                self.items[number].append(item)
        classes: dict[int, dict] = {}
        for p, number in numbers.items():
            classes.setdefault(len(p).bit_length() if len(p) < window else window + 1, {})[p] = number
        self.machines = [WuManber(c) for c in classes.values()]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, items = [], set()
        for machine in self.machines:
            for start, end, number in machine.search(words):
                spans.append((start, end))
                items.update(x for x in self.items[number] if x is not None)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_tables: dict = {}


def patterns_of(name: str, broadcast, window: int) -> Patterns:
    """Search tables of a broadcast block; a worker keeps those of the last block it used."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = Patterns(broadcast.value, window)
    return _tables[name]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        text = row[1].encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def _scan(rows: DataFrame, head: list[str], block, window: int, all_rows: bool = True) -> DataFrame:
    """Columns ``head`` of ``rows`` (these, then text), n_words, spans and items for a broadcast block; of all rows or of those with hits."""
    schema = rows.select(*head, F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<int>").alias("spans"), F.lit(None).cast("array<string>").alias("items")).schema
    name, width, names = uuid.uuid4().hex, len(head), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.decontaminate import merged, patterns_of, words_of

        table = patterns_of(name, block, window)
        for b in batches:
            n_words, spans, items = [], [], []
            for text in b.column(width).cast(pa.binary()).to_pylist():
                words = words_of(text)
                new, found = table.hits(words)
                n_words.append(len(words))
                spans.append([x for s in merged(new) for x in s])
                items.append(sorted(found))
            out = pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names)
            yield out if all_rows else out.filter(pa.array([bool(x) for x in spans], pa.bool_()))

    return rows.mapInArrow(run, schema)


def _together(hits: DataFrame) -> DataFrame:
    """Hits of one row from several blocks as one: spans merged, items once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.llm.decontaminate import merged

        for b in batches:
            spans = [[x for s in merged([*zip(flat[::2], flat[1::2], strict=True)]) for x in s] for flat in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(spans, pa.list_(pa.int32())), b.column(5)], b.schema.names)

    once = hits.groupBy("file", "row").agg(F.max("doc").alias("doc"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return once.mapInArrow(run, once.schema)


def _in_blocks(placed: Placed, blocks: Iterator[list], window: int, id_col: str, text_col: str) -> DataFrame:
    """(file, row, doc, n_words, spans, items) of every row, searched for one block after another."""
    spark, found = placed.df.sparkSession, []
    for items in blocks:
        block = spark.sparkContext.broadcast(items)
        rows = placed.df.select(*placed.place, placed.df[id_col].cast("long").alias("doc"), placed.df[text_col].cast("string").alias("text"))
        found.append(materialize(_scan(rows, ["file", "row", "doc"], block, window, all_rows=not found), "decontaminate"))
        block.destroy()
    return _together(reduce(DataFrame.unionByName, found))


def _search(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_id: str, item_text: str, carry: bool) -> tuple[DataFrame, Placed | None]:
    """Hits of all rows; with several blocks they name rows by their places, otherwise ``doc`` has the id or (``carry``) the row."""
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    blocks = _blocks(items, item_id, item_text) if items.columns else iter(())
    some = list(islice(blocks, 2))
    if len(some) > 1:
        placed = Placed.of(docs)
        return _in_blocks(placed, chain(some, blocks), window, id_col, text_col), placed
    head = F.struct(*[docs[c] for c in docs.columns]) if carry else docs[id_col].cast("long")
    rows = docs.select(head.alias("doc"), docs[text_col].cast("string").alias("text"))
    return _scan(rows, ["doc"], spark.sparkContext.broadcast(some[0] if some else []), window), None


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: id, n_words, hit word spans and items.

    ``spans`` lists start and end word numbers of merged hits, one after the other.
    """
    return _search(docs, items, window, id_col, text_col, item_id, item_text, carry=False)[0].select("doc", "n_words", "spans", "items")


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds hit counts, the digest of the items and the verdict: 5% of the words in hits."""
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    return found.withColumns(
        {
            "n_hit": F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x),
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256),
        }
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    return with_verdict(find_contamination(docs, items, **options)).select(F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated; columns stay as they are."""
    found, placed = _search(docs, items, window, id_col, text_col, item_id, item_text, carry=True)
    clean = with_verdict(found).where("not contaminated")
    return placed.only(clean.select("file", "row")) if placed else clean.select("doc.*")
