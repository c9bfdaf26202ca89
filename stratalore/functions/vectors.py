"""Vectors as arrays: quantization, norms and cosine similarity, computed in double."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalore.functions.expressions import let

#: Ranges and norms below this count as zero.
TINY = 1e-9


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; a vector of nearly no length stays as it is."""
    return let(doubles(v), lambda d: let(norm(d), lambda n: F.when(n > TINY, F.transform(d, lambda x: x / n)).otherwise(d)))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has nearly no length."""
    return F.when((norm(a) > TINY) & (norm(b) > TINY), dot(a, b) / (norm(a) * norm(b)))


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector, whose length is computed once; null if either has nearly no length."""
    q, length = F.array(*[F.lit(float(x)) for x in query]), math.sqrt(sum(float(x) * float(x) for x in query))
    if length <= TINY:
        return F.lit(None).cast("double")
    return let(doubles(v), lambda d: let(norm(d), lambda n: F.when(n > TINY, dot(d, q) / (n * length))))


def quantize(v: Column) -> Column:
    """Struct of codes (0-255), scale and offset; a constant vector has zeros and scale 0, no vector has none."""

    def coded(d: Column, low: Column, high: Column) -> Column:
        scale = (high - low) / 255
        codes = F.transform(d, lambda x: F.when(high - low < TINY, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x - low) / scale + 0.5)))).cast("smallint"))
        return F.struct(codes.alias("codes"), F.when(high - low < TINY, 0.0).otherwise(scale).alias("scale"), low.alias("offset"))

    # The vector and its ends are bound once, or each code would compute them again.
    ends = lambda d: F.struct(F.array_min(d).alias("low"), F.array_max(d).alias("high"))
    return let(doubles(v), lambda d: let(ends(d), lambda e: coded(d, e["low"], e["high"])))


def dequantize(codes: Column, scale: Column, offset: Column) -> Column:
    return F.transform(codes, lambda c: c * scale + offset)


def mean_pool(token_vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1; null if none is."""
    kept = F.transform(F.filter(F.arrays_zip(token_vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: doubles(x["v"]))
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), F.get(kept, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, i, mean): the mean vector of each key, one row for each place; sums form where rows are read."""
    each = rows.select(key, F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    return each.groupBy(key, "i").agg(F.avg("x").alias("mean"))
