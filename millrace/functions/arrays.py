"""Array expressions: values computed once, sums of what comes before, positions of matches, pieces of texts.

A substring at a position costs as much as the position, so loops over positions are quadratic in long texts.
Pieces are therefore extracted by one pass of a regular expression, and positions are sums of lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 64


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def sums_before(lengths: Column) -> Column:
    """The sum of all integers before each, in chunks: the work is linear but for one term of n * n / _CHUNK ** 2."""

    def both(s: Column) -> Column:
        v, n = s["v"], F.size(s["v"])
        chunks = F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int"))
        sums = F.transform(chunks, lambda c: _sum(F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK))))
        bases = let(sums, lambda t: F.aggregate(t, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
        return let(bases, lambda b: F.transform(v, lambda _, i: F.get(b, F.floor(i / _CHUNK).cast("int")) + _sum(F.slice(v, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK))))

    return F.when(F.size(lengths) > 0, let(F.struct(lengths.alias("v")), both)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points) and text of all leftmost non-overlapping matches; they must not be empty.

    A split gives what lies between the matches, an extraction the matches; positions are sums of their lengths."""
    p = F.lit(pattern)

    def spans(s: Column) -> Column:
        pair = F.transform(s["m"], lambda m, i: F.char_length(F.get(s["gap"], i)) + F.char_length(m))
        ends = let(pair, lambda q: F.zip_with(sums_before(q), q, lambda a, b: a + b))
        return F.zip_with(ends, s["m"], lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("m")))

    found = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern).alias("gap"))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    return F.when(F.regexp_like(text, p), let(found, spans)).otherwise(none)


def pieces(text: Column, size: int, stride: int | None = None) -> Column:
    """Substrings of ``size`` characters at every ``stride`` (its own size: blocks); a shorter rest is left out."""
    if stride is None or stride == size:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{{size}}}"), F.lit(0))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}})).{{{stride}}}"), F.lit(1))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def byte_values(binary: Column) -> Column:
    """The bytes of a binary or text as integers."""
    return F.transform(pieces(F.hex(binary), 2), lambda b: F.conv(b, 16, 10).cast("int"))
