"""Detecting, masking and restoring personal data in native expressions.

Spans of all types are found from the pieces between matches, sorted by start and
then by length, and folded so that later spans do not overlap earlier ones.
Offsets are code points; ``byte_start`` and ``byte_end`` are UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalore.functions.expressions import let, prefix_sums
from stratalore.functions.vocabulary import PII_PATTERNS

_SPAN = "array<struct<start:int,neg_end:int,place:int,type:string,text:string>>"


def _typed_spans(text: Column, place: int, name: str, pattern: str) -> Column:
    p = F.lit("(?U)" + pattern)
    sizes = lambda xs: F.transform(xs, lambda x: F.char_length(x).cast("long"))

    def spans(hits: Column, gaps: Column) -> Column:
        # A match starts after the gaps up to it and the matches before it.
        ends = prefix_sums(F.zip_with(sizes(F.slice(gaps, 1, F.size(hits))), sizes(hits), lambda a, b: a + b))
        return let(ends, lambda e: F.transform(hits, lambda m, i: F.struct((F.get(e, i) - F.char_length(m)).cast("int").alias("start"), (-F.get(e, i)).cast("int").alias("neg_end"), F.lit(place).alias("place"), F.lit(name).alias("type"), m.alias("text"))))

    found = let(F.regexp_extract_all(text, p, 0), lambda hits: let(F.split(text, "(?U)" + pattern, -1), lambda gaps: spans(hits, gaps)))
    return F.when(text.rlike("(?U)" + pattern), found).otherwise(F.array()).cast(_SPAN)


_KEPT = "array<struct<start:int,end:int,type:string,text:string>>"


def detect(text: Column) -> Column:
    """Array of non-overlapping spans (start, end, type, text) in order; empty for null."""
    found = F.sort_array(F.concat(*[_typed_spans(text, i, k, p) for i, (k, p) in enumerate(PII_PATTERNS.items())]))
    zero = F.struct(F.lit(0).alias("last"), F.array().cast(_KEPT).alias("some"), F.array().cast(f"array<{_KEPT}>").alias("full"))

    def fold(acc: Column, s: Column) -> Column:
        """Kept spans gather in blocks, so a long list is not copied for each span."""
        end = -s["neg_end"]
        some = F.concat(acc["some"], F.array(F.struct(s["start"].alias("start"), end.alias("end"), s["type"].alias("type"), s["text"].alias("text"))))
        closed = F.struct(end.alias("last"), F.array().cast(_KEPT).alias("some"), F.concat(acc["full"], F.array(some)).alias("full"))
        return F.when(s["start"] < acc["last"], acc).when(F.size(acc["some"]) >= 255, closed).otherwise(F.struct(end.alias("last"), some.alias("some"), acc["full"].alias("full")))

    return F.coalesce(F.aggregate(found, zero, fold, lambda acc: F.concat(F.flatten(acc["full"]), acc["some"])), F.array().cast(_KEPT))


#: Code points of a block of text, from which pieces are cut without going over all that is before them.
BLOCK = 4096


def _blocks(text: Column) -> Column:
    last = F.floor(F.greatest(F.char_length(text) - 1, F.lit(0)) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * BLOCK + 1, F.lit(BLOCK)))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` up to ``end``, out of the blocks that it lies in."""
    first = F.floor(start / BLOCK).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(held, start - first * BLOCK + 1, end - start)).otherwise("")


def _gaps(text: Column, spans: Column) -> Column:
    """The text before each span, from the end of the one before, and the text after the last."""
    end_before = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)

    def cut(blocks: Column) -> Column:
        before = F.transform(spans, lambda s, i: _piece(blocks, end_before(i), s["start"]))
        return F.concat(before, F.array(_piece(blocks, end_before(F.size(spans)), F.char_length(text))))

    return let(_blocks(text), cut)


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, byte_start, byte_end, type, text), one row for each span."""
    found = docs.select(F.col(id_col), F.col(text_col).alias("_text"), detect(F.col(text_col)).alias("spans")).where(F.size("spans") > 0)

    def placed(spans: Column) -> Column:
        # Running totals of the bytes of gaps and spans, so no text is measured twice.
        sizes = F.zip_with(F.slice(_gaps(F.col("_text"), spans), 1, F.size(spans)), spans, lambda g, s: (F.octet_length(g) + F.octet_length(s["text"])).cast("long"))
        return let(prefix_sums(sizes), lambda ends: F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.get(ends, i) - F.octet_length(s["text"])).cast("int").alias("byte_start"), F.get(ends, i).cast("int").alias("byte_end"), s["type"].alias("type"), s["text"].alias("text"))))

    return found.select(id_col, F.inline(placed(F.col("spans"))))


def token(doc_id: Column, span: Column) -> Column:
    """Eight hex digits from the document, the place and the type, so masking can be repeated."""
    return F.left(F.sha2(F.concat_ws("|", doc_id.cast("string"), span["start"].cast("string"), span["type"]), 256), F.lit(8))


def anonymize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, masked, tokens): text with <PII:TYPE:token> in place of spans, and the map from token to (original, type)."""
    found = docs.select(F.col(id_col), F.col(text_col).alias("_text"), detect(F.col(text_col)).alias("spans"))
    key = F.col(id_col)
    mark = lambda s: F.concat(F.lit("<PII:"), s["type"], F.lit(":"), token(key, s), F.lit(">"))
    spans = F.col("spans")
    # Every gap is followed by the mark of its span, the last one by nothing.
    masked = let(_gaps(F.col("_text"), spans), lambda gaps: F.array_join(F.transform(gaps, lambda g, i: F.when(i < F.size(spans), F.concat(g, mark(F.get(spans, i)))).otherwise(g)), ""))
    tokens = F.map_from_entries(F.transform("spans", lambda s: F.struct(token(key, s), F.struct(s["text"].alias("original"), s["type"].alias("type")))))
    return found.select(id_col, F.when(F.size("spans") == 0, F.col("_text")).otherwise(masked).alias("masked"), tokens.alias("tokens"))


def deanonymize(masked: Column, tokens: Column) -> Column:
    """Put the originals of known tokens back; the text is gone over once."""
    pattern = "<PII:([A-Z_]+):([0-9a-f]{8})>"

    def original(mark: Column) -> Column:
        known = F.element_at(tokens, F.regexp_extract(mark, pattern, 2))
        return F.when(known["type"] == F.regexp_extract(mark, pattern, 1), known["original"]).otherwise(mark)

    def joined(gaps: Column, marks: Column) -> Column:
        return F.array_join(F.transform(gaps, lambda g, i: F.when(i < F.size(marks), F.concat(g, original(F.get(marks, i)))).otherwise(g)), "")

    return let(F.split(masked, pattern, -1), lambda gaps: let(F.regexp_extract_all(masked, F.lit(pattern), 0), lambda marks: joined(gaps, marks)))


def counts_by_type(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return detect_pii(docs, id_col, text_col).groupBy("type").agg(F.count("*").alias("n"))
