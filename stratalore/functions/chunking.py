"""Cutting documents into sections and paragraphs.

The splitter is recursive over a list of separators and so is the one text
function that runs in Python, over Arrow batches. Sizes are UTF-8 bytes. Reported
positions are sums of chunk lengths, in which dropped separators do not count;
``exact_start`` is where the chunk really begins.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalore.functions.text import chunk_size, should_chunk
from stratalore.session import bound_batches, give_back, ship

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Bytes of text that a worker holds as chunks before it hands them on; a document's chunks stay together.
PIECE = 1 << 20
_HEAD = re.compile(r"(\n#{1,6}\s)|(\n\n\n+)")

CHUNK_SCHEMA = "doc_id long, chunk_index int, level int, parent_index int, char_start int, char_end int, exact_start int, text string"


def split_text(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` bytes, but for stretches that no separator cuts.

    All pieces are measured first; with running totals at hand, each group of
    neighbours ends where its total would pass ``size``. Pieces too large for any
    group are cut by the later separators. A group that follows a full one does not
    count the separator before its first piece; other groups do.
    """
    if not any(separators[:1]):
        return [text] * bool(text)
    sep, rest = separators[0], separators[1:]
    gap, pieces = len(sep.encode()), text.split(sep)
    sizes = [len(p.encode()) for p in pieces]
    totals = [0, *accumulate(n + gap for n in sizes)]
    out: list[str] = []
    for large, run in groupby(range(len(pieces)), lambda i: sizes[i] > size):
        places = [*run]
        if large:
            out += chain.from_iterable(split_text(pieces[i], size, rest) for i in places)
            continue
        at, stop, spared = places[0], places[-1] + 1, 0
        while at < stop:
            end = min(stop, max(at + 1, bisect_right(totals, totals[at] + size + spared) - 1))
            out.append(sep.join(pieces[at:end]))
            at, spared = end, gap
    return [p for p in out if p]


def sections(text: str) -> list[tuple[int, str]]:
    """(start, text) of trimmed sections, cut before headings and at wide gaps; the whole text if there is no cut."""
    cuts = [m.start() for m in _HEAD.finditer(text)]
    if not cuts:
        return [(0, text)]
    edges = [0, *cuts, len(text)]
    found = [(a, text[a:b].strip()) for a, b in zip(edges, edges[1:], strict=False)]
    return [(a, t) for a, t in found if t]


def hierarchy(text: str, size: int) -> list[dict]:
    """Sections (level 0), each followed by its paragraphs (level 1), numbered through."""
    out: list[dict] = []
    for start, section in sections(text):
        base = len(text[:start].encode())
        parent, at, real = len(out), base, text.find(section, start)
        out.append({"chunk_index": parent, "level": 0, "parent_index": None, "char_start": base, "char_end": base + len(section.encode()), "exact_start": len(text[:real].encode()), "text": section})
        look = real
        for piece in split_text(section, size):
            n = len(piece.encode())
            found = text.find(piece, look)
            look = found + len(piece) if found >= 0 else look
            out.append({"chunk_index": len(out), "level": 1, "parent_index": parent, "char_start": at, "char_end": at + n, "exact_start": len(text[: max(found, 0)].encode()), "text": piece})
            at += n
    return out


def chunk_batches(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Chunks of (doc_id, text, cut, size) rows, in batches that end with the document that passes ``most`` bytes."""
    types = {"doc_id": pa.int64(), "text": pa.string()}
    names = ["doc_id", "chunk_index", "level", "parent_index", "char_start", "char_end", "exact_start", "text"]

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(k, pa.int32())) for k in names], names)

    rows, held = [], 0
    for k in range(batch.num_rows):
        doc, text, cut, size = (c[k].as_py() for c in batch.columns)
        n = len(text.encode())
        whole = [{"chunk_index": 0, "level": 1, "parent_index": None, "char_start": 0, "char_end": n, "exact_start": 0, "text": text}]
        rows += [{"doc_id": doc, **c} for c in (hierarchy(text, size) if cut else whole)]
        held += n
        if held >= most:
            yield made(rows)
            rows, held = [], 0
    yield made(rows)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ext_col: str | None = None) -> DataFrame:
    """Chunks of every document: one whole chunk for short ones, else sections and paragraphs.

    A null text has no chunks. Long and short documents take one pass; the Python
    stage sees only the columns it needs.
    """
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    ext = F.col(ext_col) if ext_col else F.lit(None).cast("string")
    ready = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), should_chunk(F.col(text_col), ext).alias("cut"), chunk_size(ext).cast("int").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratalore.functions.chunking import chunk_batches

        for b in batches:
            yield from chunk_batches(b)
        give_back()

    return ready.mapInArrow(run, CHUNK_SCHEMA)
