"""Pivots, summary statistics, evaluation metrics, splits and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def aggregate(value: Column, how: str) -> Column:
    """sum, count, average, max or min of numbers; nothing gives 0; an unknown name means sum."""
    fns = {"sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min}
    return F.round(F.coalesce(fns.get(how, F.sum)(value).cast("double"), F.lit(0.0)), 2)


def group_key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def header(field: str, how: str, many: bool) -> str:
    return f"{field} ({how})" if many else field


def pivot_flat(df: DataFrame, rows: list[str], values: list[tuple[str, str]], where: Column | None = None) -> DataFrame:
    """A row for each group of string keys that has a number in some value field; filters are applied."""
    d = df if where is None else df.where(where)
    has = None
    for v, _ in values:
        has = F.col(v).isNotNull() if has is None else has | F.col(v).isNotNull()
    return d.where(has).groupBy(*(group_key(r).alias(r) for r in rows)).agg(*(aggregate(F.col(v), how).alias(f"{v}_{how}") for v, how in values))


def pivot_cross(df: DataFrame, rows: list[str], column: str, value: str, how: str, keys: list[str] | None = None) -> DataFrame:
    """A column for each value of ``column``, sorted; a missing cell is 0. Given ``keys``, the table isn't scanned for them."""
    d = df.where(F.col(value).isNotNull()).select(*(group_key(r).alias(r) for r in rows), group_key(column).alias("__c"), F.col(value).alias("__v"))
    g = d.groupBy(*rows).pivot("__c", keys) if keys else d.groupBy(*rows).pivot("__c")
    return g.agg(aggregate(F.col("__v"), how)).fillna(0.0)


def summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (one value: 0), least and largest value, to four places; without a value 0."""
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return df.groupBy(*group).agg(z(F.avg(value)).alias("mean"), z(F.stddev_samp(value)).alias("stddev"), z(F.min(value)).alias("min"), z(F.max(value)).alias("max"))


def delta(summaries: DataFrame, group: str, primary: str, baseline: str, value: str = "mean") -> DataFrame:
    """The primary group's value less the baseline's."""
    pick = lambda g: F.coalesce(F.max(F.when(F.col(group) == g, F.col(value))), F.lit(0.0))
    return summaries.agg(pick(primary).alias("primary"), pick(baseline).alias("baseline"), F.round(pick(primary) - pick(baseline), 4).alias("delta"))


def trigger_rates(runs: DataFrame, query: str, triggered: str, expected: str, threshold: float = 0.5) -> DataFrame:
    """Share of runs that trigger, and whether it is on the expected side of the threshold. Equal queries merge."""
    g = runs.groupBy(query).agg(F.avg(F.col(triggered).cast("double")).alias("__r"), F.max(F.col(expected).cast("int")).alias("__e"), F.count("*").alias("runs"))
    ok = F.when(F.col("__e") == 1, F.col("__r") >= threshold).otherwise(F.col("__r") < threshold)
    return g.select(query, F.round("__r", 4).alias("rate"), "runs", ok.alias("pass"))


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """Counts and metrics; precision and recall are 1 where nothing could be wrong, accuracy is 0 without rows."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    c = df.agg(n(actual & predicted).alias("tp"), n(~actual & predicted).alias("fp"), n(actual & ~predicted).alias("fn"), n(~actual & ~predicted).alias("tn"))
    ratio = lambda a, b, d: F.round(F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(d)), 4)
    return c.withColumns({"precision": ratio("tp", "tp + fp", 1.0), "recall": ratio("tp", "tp + fn", 1.0), "accuracy": ratio("tp + tn", "tp + tn + fp + fn", 0.0)})


def best_iteration(df: DataFrame, iteration: str, test: str, train: str) -> DataFrame:
    """The first iteration with the most passes, of the test set if there is one."""
    score = F.coalesce(F.col(test), F.col(train))
    return df.agg(F.max_by(iteration, F.struct(score, -F.col(iteration))).alias("best"), F.max(score).alias("passes"))


def stratified_split(df: DataFrame, key: str, stratum: str, share: float = 0.4, salt: str = "") -> DataFrame:
    """Holds out max(1, floor(n * share)) rows of each class, those with the smallest md5 of their key.

    A class can be most of the table, so no row is ranked in a window over its class. Hashes fall into 65,536 buckets, which are
    counted; running sums over those counts say which buckets are held out whole, and only the one bucket that is cut is ranked."""
    h = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    d = df.select(key, stratum, h.alias("__h"), F.substring(h, 1, 4).alias("__b"))
    counts = d.groupBy(stratum, "__b").agg(F.count("*").alias("__n"))
    w = W.partitionBy(stratum)
    upto = F.sum("__n").over(w.orderBy("__b"))
    want = F.greatest(F.lit(1), F.floor(F.sum("__n").over(w) * share))
    plan = counts.select(stratum, "__b", (upto <= want).alias("__whole"), (want - (upto - F.col("__n"))).alias("__left"))
    marked = d.join(plan, [stratum, "__b"])
    cut = marked.where("not __whole and __left > 0").withColumn("__k", F.row_number().over(W.partitionBy(stratum, "__b").orderBy("__h", key)))
    cut = cut.select(key, stratum, F.when(F.col("__k") <= F.col("__left"), "test").otherwise("train").alias("split"))
    rest = marked.where("__whole or __left <= 0").select(key, stratum, F.when(F.col("__whole"), "test").otherwise("train").alias("split"))
    return rest.unionByName(cut)


def members(df: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in ``chosen``, and the others."""
    return df.join(chosen.select(key), key, "left_semi"), df.join(chosen.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], removed: DataFrame | None = None) -> DataFrame:
    """Rows by upper-cased key; only the fields that ``new`` supplies (not null) are overwritten; removed keys go."""
    o = old.select(F.upper(F.col(key)).alias(key), *(F.col(c).alias(f"__o_{c}") for c in columns), F.lit(True).alias("__old"))
    n = new.select(F.upper(F.col(key)).alias(key), *(F.col(c).alias(f"__n_{c}") for c in columns), F.lit(True).alias("__new"))
    out = o.join(n, key, "full_outer")
    action = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "kept").otherwise("updated")
    out = out.select(key, *(F.coalesce(f"__n_{c}", f"__o_{c}").alias(c) for c in columns), action.alias("action"))
    return out if removed is None else out.join(removed.select(F.upper(F.col(key)).alias(key)), key, "left_anti")


def lookup_enrich(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Optional lookup: rows without a partner stay."""
    return facts.join(dimension, key, "left")


def top_fanout(hits: DataFrame, query: str, rank: Column, hit: str, details: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The best hit of each query with its first ``n`` details."""
    top = hits.groupBy(query).agg(F.max_by(hit, rank).alias(hit))
    w = W.partitionBy(query).orderBy(*by)
    j = top.join(details, hit)
    return j.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
