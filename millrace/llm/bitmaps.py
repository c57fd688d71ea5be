"""Sets of hashes as bitmaps of a fixed size, to leave out rows before a shuffle.

A bitmap has BITS bits (4 MB) in blocks of BLOCK, whatever the number of keys, and is built by a grouped aggregation that
combines in each task. It lets all keys of the set pass and others with a probability that grows with the set, so it never
changes a result, only how much is shuffled. Everything is DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
BLOCK = 1 << 15


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """``__block`` and its ``__bits`` (at most BITS / BLOCK rows) of the hashes in the column ``key``."""
    p = F.pmod(F.col(key), F.lit(BITS))
    return keys.groupBy(F.shiftright(p, 15).alias("__block")).agg(F.bitmap_construct_agg(p.bitwiseAND(F.lit(BLOCK - 1))).alias("__bits"))


def maybe_in(df: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """``df`` with ``__maybe``: false if ``key`` isn't in the set. The bitmap's size is bounded, so it is broadcast."""
    p = F.pmod(key, F.lit(BITS))
    at = p.bitwiseAND(F.lit(BLOCK - 1))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = df.withColumn("__place", F.shiftright(p, 15)).join(F.broadcast(bits), F.col("__place") == F.col("__block"), "left")
    return out.withColumn("__maybe", F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))).drop("__place", "__block", "__bits")
