"""Building blocks for long native expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that parts words, as a regular-expression class.
SPACE = "\\x20\\x09-\\x0D"
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """The words of a text; an empty array if there are none or the text is null."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE}]+")))


def prefix_sums(numbers: Column, block: int = 256) -> Column:
    """Running totals of an array of longs, in blocks so that long arrays stay cheap."""
    return _running(numbers, lambda a, b: a + b, 0, block)


def prefix_maxima(numbers: Column, least: int, block: int = 256) -> Column:
    """Running maxima of an array of longs of at least ``least``, in blocks."""
    return _running(numbers, F.greatest, least, block)


def _running(numbers: Column, combine: Callable[[Column, Column], Column], first: int, block: int) -> Column:
    zero = F.array(F.lit(first).cast("long"))

    def run(xs: Column) -> Column:
        """The first value and the running ones of a short array."""
        return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def offset(parts: Column) -> Column:
        starts = run(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(starts, lambda s: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: combine(x, F.get(s, i))))))

    return let(numbers, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(let(_blocks(xs, run, block), offset)))


def _blocks(xs: Column, run: Callable[[Column], Column], block: int) -> Column:
    last = F.floor((F.size(xs) - 1) / block).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: run(F.slice(xs, b * block + 1, F.lit(block))))
