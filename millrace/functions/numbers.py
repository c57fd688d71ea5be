"""Number packing: zigzag, varint sizes, bit widths, dates and addresses as integers; colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1).cast("bigint"))))


def varint_bytes(v: Column) -> Column:
    """Bytes of an unsigned varint of seven bits a byte."""
    out = F.when(v < 0, 10)
    for k in range(1, 9):
        out = out.when(v < 1 << (7 * k), k)
    return out.otherwise(9).cast("int")


def enum_bits(n: Column) -> Column:
    """Bits of an index among n values."""
    return F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 16, 4).when(n <= 256, 8).otherwise(16).cast("int")


def epoch_days(d: Column) -> Column:
    """Days since 2000-01-01."""
    return F.datediff(d, F.lit("2000-01-01").cast("date"))


def compact_date(d: Column) -> Column:
    """YYYYMMDD as an integer."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def second_of_day(t: Column) -> Column:
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("int")


def ipv4(address: Column) -> Column:
    """The address as a long; null if it isn't one."""
    p = F.split(address, r"\.")
    part = lambda i: F.element_at(p, i).cast("bigint")
    return F.when(F.regexp_like(address, F.lit(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def hsl_to_hex(h: Column, s: Column, light: Column) -> Column:
    """Colour of hue (degrees), saturation and lightness (0 to 1); channels are truncated to bytes."""
    m2 = F.when(light <= 0.5, light * (1 + s)).otherwise(light + s - light * s)
    m1 = 2 * light - m2

    def channel(offset: float) -> Column:
        t = F.pmod(h / 360.0 + offset, F.lit(1.0))
        v = F.when(t < 1 / 6, m1 + (m2 - m1) * t * 6).when(t < 0.5, m2).when(t < 2 / 3, m1 + (m2 - m1) * (F.lit(2 / 3) - t) * 6).otherwise(m1)
        return F.lpad(F.lower(F.hex(F.floor(v * 255).cast("int"))), 2, "0")

    return F.concat(F.lit("#"), channel(1 / 3), channel(0.0), channel(-1 / 3))


def luminance(colour: Column) -> Column:
    """Relative luminance of ``#rrggbb``."""

    def channel(at: int) -> Column:
        c = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(luminance(a), luminance(b)) + 0.05) / (F.least(luminance(a), luminance(b)) + 0.05)
