"""Positions in a global order without a window over the whole table in one task, and reports that show the first rows of each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOUNDS = 200


def numbered(df: DataFrame, order: list[str], name: str, bounds: int = BOUNDS) -> DataFrame:
    """The rows with their position from 0 in the ascending order of the columns, which must tell all rows apart (equal rows get positions in any order).

    Rows are dealt to ranges and ranked in each; a range starts where the rows of all former ones end. The bounds of the ranges are the keys of
    ``bounds`` rows with the smallest hashes, so they follow the distribution; they decide how even tasks are, never the result. Nulls come first."""
    key = F.struct(*order)
    some = df.select(key.alias("k"), F.xxhash64(*order).alias("h")).distinct().orderBy("h", "k").limit(bounds)
    ends = some.agg(F.sort_array(F.collect_list("k")).alias("ends")).scalar()
    d = df.withColumn("__ends", ends).withColumn("__range", F.size(F.filter("__ends", lambda e: e <= key))).drop("__ends")
    sizes = d.groupBy("__range").agg(F.count("*").alias("__n"))
    w = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # at most bounds + 1 rows
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    at = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1
    return d.withColumn("__at", at).join(F.broadcast(starts), "__range").withColumn(name, (F.col("__start") + F.col("__at")).cast("bigint")).drop("__range", "__at", "__start")


def capped(findings: DataFrame, kind: str, order: list[str | Column], caps: dict[str, int], default: int) -> DataFrame:
    """The first rows of each kind, at most as many as ``caps`` names for it (else ``default``), each with its ``rank`` and with ``total``, how many the kind has.

    That is the feature: a report shows so many and counts all. A row outside a task's own first ones goes before the shuffle."""
    most = F.lit(default)
    for k, n in caps.items():
        most = F.when(F.col(kind) == k, n).otherwise(most)
    totals = findings.groupBy(kind).agg(F.count("*").alias("total"))
    first = findings.withColumn("rank", F.row_number().over(W.partitionBy(kind).orderBy(*order))).where(F.col("rank") <= max([default, *caps.values()]))
    return first.where(F.col("rank") <= most).join(F.broadcast(totals) if caps else totals, kind)
