"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, where u is a uniform number derived from
its id and text (so reruns agree) and w its quality weight; small keys come
first. A source whose target is T words of its S has floor(T / S) complete
epochs; the remaining words go to the documents with the smallest keys, up to the
budget. Only DataFrame functions are used.

The order within a source is never built in one place: keys are dealt to
``BUCKETS`` parts, word totals of the parts are summed, and the part in which a
budget ends is cut again until it has ``EDGE`` documents at most or one key only.
Documents with one key, such as repeated rows, go by their place in the files, of
which again only ``SPAN`` rows are ordered. What comes out is one cutoff for each
source, so the documents themselves are never shuffled.

Defined results: a null text has 0 words and is never taken; a null source is a
source of its own and comes last; repeated rows are separate documents with equal
keys, and the first in the files are taken first; an empty table gives an empty
table; other columns of the input are ignored by the operator. Sources are ranked
in one task, which holds one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalore.llm.places import Placed
from stratalore.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>!]"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BUCKETS = 4096
#: Documents of a source, and rows of a file, that are ordered at the cutoff.
EDGE, SPAN = 1 << 16, 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.1 and 1: falls as marks of markup and shouting reach the number of words."""
    marks = F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0))
    return F.greatest(F.lit(0.1), F.lit(1.0) - marks / F.greatest(size, F.lit(1)))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number strictly between 0 and 1 from the MD5 of id and text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row for each source, null last.

    Shares of ``share`` times all words are proportional to the repeating weights;
    a source stops at ``most`` times its size and the rest is shared again. Sorted
    by size over weight, the capped sources are the first ones: a source is capped
    if what is left for it and all later ones would give it more than its cap.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("w", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")).cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("all") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = ranked.withColumn("all", F.sum("source_size").over(everything)).withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    # The level of the first source that is not capped holds for all that are not.
    free = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("free", free).select("source", "source_size", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("w"))).alias("target"))


def _measured(docs: Placed, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Source, size, key and place of a row."""
    text, doc_id = docs.df[text_col].cast("string"), docs.df[id_col].cast("long")
    size = word_count(text)
    key = -F.log(uniform(doc_id, text)) / quality_weight(text, size)
    return [docs.df[source_col].cast("string").alias("source"), size.alias("size"), key.alias("key"), *docs.place]


def _cut(parts: DataFrame, budgets: DataFrame) -> DataFrame:
    """Of (source, part, words, ...) the part of each source in which its budget ends.

    ``budgets`` has (of, base, rest): words before the first part, and words to take.
    The result has ``base``, the words before the part found, in place of the former one.
    """
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = parts.withColumn("before", before).join(budgets, F.col("source").eqNullSafe(F.col("of"))).withColumn("base", F.col("base") + F.col("before"))
    return met.where("base <= rest and base + words > rest").drop("before", "of")


def _keys(rows: DataFrame, part: Column) -> DataFrame:
    return rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


def _narrowed(rows: DataFrame, ends: DataFrame, buckets: int, edge: int) -> DataFrame:
    """``ends`` (source, base, rest, n, low, high) with its parts cut until each is small or has one key.

    Each step leaves out at least one of the two end keys and cuts the width to one
    in ``buckets``, so a few steps suffice.
    """
    wide = (F.col("n") > edge) & (F.col("low") < F.col("high"))
    while ends.where(wide).limit(1).count():
        bounds = ends.where(wide).select(F.col("source").alias("of"), "base", "rest", F.col("low").alias("a"), F.col("high").alias("z"))
        inside = rows.join(bounds.drop("base", "rest"), rows.source.eqNullSafe(F.col("of")) & (F.col("key") >= F.col("a")) & (F.col("key") <= F.col("z")))
        part = F.least(F.floor((F.col("key") - F.col("a")) / (F.col("z") - F.col("a")) * buckets), F.lit(buckets - 1))
        cut = _cut(_keys(inside, part), bounds.drop("a", "z")).select(*ends.columns)
        ends = materialize(ends.where(~wide).unionByName(cut), "mix-ends")
    return ends


def _last(rows: DataFrame, ends: DataFrame, span: int) -> DataFrame:
    """(source, below, last): all keys under ``below`` are in, and in the part itself those up to ``last`` (key, file, row)."""
    tied = F.col("low") == F.col("high")
    at = ends.select(F.col("source").alias("of"), "base", "rest", "low", "high")
    here = lambda keys: rows.join(keys.select("of", "low", "high"), rows.source.eqNullSafe(F.col("of")) & (F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high"))).drop("of")
    # Documents of one key: first the span of rows of a file in which the budget ends.
    block = F.struct("file", F.floor(F.col("row") / span).alias("block"))
    spans = here(at.where(tied)).groupBy("source", block.alias("part")).agg(F.sum("size").alias("words"), F.first("low").alias("low"))
    spans = materialize(_cut(spans, at.where(tied).select("of", "base", "rest")).select(F.col("source").alias("of"), "base", "rest", "low", F.col("part").alias("place")), "mix-spans")
    of_span = rows.join(spans, rows.source.eqNullSafe(F.col("of")) & (F.col("key") == F.col("low")) & (block == F.col("place"))).select("source", "key", "file", "row", "size", "base", "rest")
    of_part = here(at.where(~tied)).drop("low", "high").join(at.where(~tied).select("of", "base", "rest"), F.col("source").eqNullSafe(F.col("of"))).select("source", "key", "file", "row", "size", "base", "rest")
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "file", "row").rowsBetween(Window.unboundedPreceding, 0))
    # A document is in if the budget reaches its middle, so a source misses its target by half a document at most.
    inside = of_span.unionByName(of_part).withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = inside.groupBy(F.col("source").alias("s1")).agg(F.max(F.struct("key", "file", "row")).alias("inside"))
    ahead = spans.select(F.col("of").alias("s2"), F.struct(F.col("low").alias("key"), F.col("place.file").alias("file"), (F.col("place.block") * span - 1).alias("row")).alias("ahead"))
    out = ends.join(last, F.col("source").eqNullSafe(F.col("s1")), "left").join(ahead, F.col("source").eqNullSafe(F.col("s2")), "left")
    return out.select("source", F.col("low").alias("below"), F.coalesce("inside", "ahead").alias("last"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, buckets: int = BUCKETS, edge: int = EDGE, span: int = SPAN) -> DataFrame:
    """(source, source_size, target, epochs, below, last) from (source, size, key, file, row) rows.

    A source takes its documents ``epochs`` times, and those with a key under
    ``below`` or with (key, file, row) up to ``last`` (null: none) once more.
    """
    # 1 - exp(-key) grows with the key and spreads keys of weight 1 evenly.
    first = materialize(_keys(rows.where("size > 0"), F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1))), "mix-parts")
    sizes = first.groupBy("source").agg(F.sum("words").alias("source_size")).unionByName(rows.where("size = 0").select("source", F.lit(0).cast("long").alias("source_size")).distinct())
    goal = targets(sizes.groupBy("source").agg(F.sum("source_size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = materialize(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goals")
    budgets = goal.where(F.col("epochs") < most).select(F.col("source").alias("of"), F.lit(0).cast("long").alias("base"), "rest")
    ends = materialize(_cut(first, budgets).select("source", "base", "rest", "n", "low", "high"), "mix-ends")
    words = rows.where("size > 0")
    found = _last(words, _narrowed(words, ends, buckets, edge), span).withColumnRenamed("source", "s3").withColumn("ends", F.lit(True))
    out = goal.join(found, F.col("source").eqNullSafe(F.col("s3")), "left")
    # Sources whose budget no part exceeds take all their documents once more.
    full = F.col("ends").isNull() & (F.col("epochs") < most) & (F.col("rest") > 0)
    return materialize(out.select("source", "source_size", "target", "epochs", F.when(full, F.lit(float("inf"))).otherwise(F.col("below")).alias("below"), "last"), "mix-plan")


def _copies() -> Column:
    once_more = (F.col("key") < F.col("below")) | F.coalesce(F.struct("key", "file", "row") <= F.col("last"), F.lit(False))
    return F.when(F.col("size") > 0, F.col("epochs") + F.coalesce(once_more, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, buckets: int = BUCKETS, edge: int = EDGE, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row.

    ``copies`` is how often the mix takes the document, ``taken`` that many times its words.
    """
    placed = Placed.of(docs)
    rows = materialize(placed.df.select(placed.df[id_col].cast("long").alias("doc_id"), *_measured(placed, id_col, text_col, source_col)), "mix-rows")
    goals = plan(rows, weights, share, most, buckets, edge, span).withColumnRenamed("source", "of")
    out = rows.join(goals, rows.source.eqNullSafe(goals.of)).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, buckets: int = BUCKETS, edge: int = EDGE, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; columns stay as they are.

    Sizes and keys alone make the plan; the rows meet it source by source, so no text is shuffled.
    """
    placed = Placed.of(docs)
    measured = _measured(placed, id_col, text_col, source_col)
    rows = materialize(placed.df.select(*measured), "mix-rows")
    goals = plan(rows, weights, share, most, buckets, edge, span).select(F.col("source").alias("of"), "epochs", "below", "last")
    whole = placed.df.select(F.struct(*[placed.df[c] for c in docs.columns]).alias("doc"), *measured)
    taken = whole.join(goals, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies()).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")
