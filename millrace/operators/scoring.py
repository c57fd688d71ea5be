"""Rule-based scores, checks and alerts of quotes, news and watch lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import clamp
from millrace.operators.ranking import numbered


def payout_band(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio < 40, "safe").when(ratio < 60, "moderate").when(ratio < 80, "high").otherwise("unsustainable")


def safety(payout: Column, growth: Column, years: Column, dividend_yield: Column) -> tuple[Column, Column]:
    """Score from 0 to 100 (50 without any figure) and the factors that moved it or are worth a note."""
    steps = [
        (F.when(payout < 40, 20).when(payout < 60, 10).when(payout < 80, -10).when(payout >= 80, -20), "payout"),
        (F.when(growth > 10, 15).when(growth > 5, 10).when(growth > 0, 5).when(growth <= 0, -15), "growth"),
        (F.when(years >= 25, 15).when(years >= 10, 10).when(years >= 5, 5), "years"),
        (F.when(dividend_yield > 8, -10).when(dividend_yield < 1, 0), "yield"),
    ]
    total = F.lit(50)
    for points, _ in steps:
        total = total + F.coalesce(points, F.lit(0))
    factors = F.array_compact(F.array(*(F.when(p.isNotNull(), F.concat(F.lit(f"{name} "), p.cast("string"))) for p, name in steps)))
    return clamp(total, 0, 100).cast("int"), factors


def income_rating(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "moderate").otherwise("poor")


#: What a kind of news adds to a score of 1.
IMPACT = {"ma": 5, "insider": 4, "analyst": 3, "regulatory": 3, "earnings": 2}
URGENT = r"(?i)breaking|just in|alert|urgent"


def impact(kind: Column, text: Column, engaged: Column) -> Column:
    base = None
    for k, v in IMPACT.items():
        base = F.when(kind == k, v) if base is None else base.when(kind == k, v)
    score = 1 + base.otherwise(1) + F.when(F.regexp_like(text, F.lit(URGENT)), 2).otherwise(0) + F.when(engaged, 2).otherwise(0)
    return F.least(F.lit(10), score).cast("int")


def market(code: Column) -> Column:
    return F.when(F.regexp_like(code, F.lit(r"^\d{6}$")), "CN").when(F.regexp_like(code, F.lit(r"(?i)^\d{4,5}\.HK$")), "HK").otherwise("US")


def missing(c: Column) -> Column:
    """Null and 0 both mean that there is no figure."""
    return c.isNull() | (c == 0)


def quote_warnings(price: Column, ma5: Column, ma20: Column, overbought: Column, roe: Column, pe: Column) -> Column:
    return F.array_compact(F.array(F.when(missing(price), "no price"), F.when(missing(ma5) & missing(ma20), "no averages"), F.when(overbought, "overbought"), F.when(missing(roe) & missing(pe), "no fundamentals")))


VERDICTS = "强烈买入|买入|观望|卖出"


def verdict(text: Column, default: str = "观望") -> Column:
    """The first pattern that matches anywhere: a conclusion line, a core conclusion, a bold word."""
    patterns = [rf"结论[：:]\s*[💚🟢🟡🔴⚪]?\s*({VERDICTS})", rf"核心结论[：:]\s*[💚🟢🟡🔴⚪]?\s*({VERDICTS})", rf"\*\*({VERDICTS})\*\*"]
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns), F.lit(default))


def percent(now: Column, was: Column, base: Column) -> Column:
    """(now - was) / base in percent to two places, null where a figure is missing."""
    return F.when(~missing(now) & ~missing(was) & ~missing(base), F.round((now - was) / base * 100, 2))


def watch_list(items: DataFrame, price: Column, added: Column, target: Column, stop: Column) -> DataFrame:
    return items.withColumns({"change_pct": percent(price, added, added), "to_target_pct": percent(target, price, price), "to_stop_pct": percent(stop, price, price)})


def alerts(items: DataFrame, key: str, price: Column, target: Column, stop: Column, signal: Column, last_signal: Column, wanted: Column) -> DataFrame:
    """A row for each alert: target reached, stop reached, signal changed. Without a price there is none."""
    kinds = F.array_compact(F.array(
        F.when(~missing(target) & (price >= target), "target_hit"),
        F.when(~missing(stop) & (price <= stop), "stop_hit"),
        F.when(wanted & signal.isNotNull() & last_signal.isNotNull() & (signal != last_signal), "signal_change"),
    ))
    return items.where(price.isNotNull()).select(key, F.explode(kinds).alias("alert_type"))


def top_entities(df: DataFrame, entity: str, n: int = 10) -> DataFrame:
    """The most frequent entities; ties go to the smaller one."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), entity).limit(n)


def compression_report(df: DataFrame, original: str, packed: str, baseline: str) -> DataFrame:
    """Mean of ratios, share saved and how often the packed size beats the baseline's."""
    ratio = F.when(F.col(packed) > 0, F.col(original) / F.col(packed)).otherwise(0.0)
    return df.agg(F.round(F.avg(ratio), 4).alias("mean_ratio"), F.round(100 * (1 - F.sum(packed) / F.sum(original)), 4).alias("saved_pct"), F.count_if(F.col(packed) < F.col(baseline)).alias("wins"))


def ranked_rumors(rumors: DataFrame, key: str, score: str) -> DataFrame:
    """Rumors from the highest impact down, ties by key, with their position from 0."""
    return numbered(rumors.withColumn("__down", -F.col(score)), ["__down", key], "position").drop("__down")
