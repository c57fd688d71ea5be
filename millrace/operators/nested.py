"""JSON of any depth: its keys, its leaves, and renamed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A quoted string, and the colon that makes it a key. Every string is matched, so that a quote or a colon inside one is never taken for a key.
STRING = r'"((?:[^"\\]|\\.)*+)"(\s*:)?'


def keys(json: Column) -> Column:
    """The distinct keys at any depth, in the order of the text, as they are written."""
    found = F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(STRING), F.lit(0))
    names = F.transform(F.filter(found, lambda x: F.endswith(x, F.lit(":"))), lambda x: F.regexp_extract(x, STRING, 1))
    return F.array_distinct(names)


def key_counts(df: DataFrame, json: str) -> DataFrame:
    """How many rows have each key at any depth."""
    return df.select(F.explode(keys(F.col(json))).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))


def depth(json: Column) -> Column:
    """How deep objects and arrays are nested; brackets in strings don't count."""
    open_close = F.regexp_replace(F.regexp_replace(F.coalesce(json, F.lit("")), STRING, ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(open_close, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """(row, path, value) of all values at any depth that are neither objects nor arrays; a path reads ``$.a.b[0].c``, a null's value is null.

    One pass finds the depth; then each level's objects and arrays are exploded where they are, without a shuffle. What isn't JSON has no leaves,
    empty objects and arrays have none either."""
    spark = df.sparkSession
    levels = df.agg(F.max(depth(F.col(json)))).first()[0] or 0
    d = df.select(F.col(key).alias("row"), F.lit("$").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    nested = F.regexp_like(F.schema_of_variant("v"), F.lit("^(OBJECT|ARRAY)<"))
    out = None
    for _ in range(levels + 1):
        kind = d.withColumn("__nested", nested)
        flat = kind.where("not __nested").select("row", "path", F.col("v").cast("string").alias("value"))
        out = flat if out is None else out.unionAll(flat)
        deep = kind.where("__nested").select("row", "path", "v")
        below = deep.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("__value")))
        at = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        d = below.select("row", F.concat("path", at).alias("path"), F.col("__value").alias("v"))
    return out


def rename(df: DataFrame, json: str, names: dict[str, str]) -> Column:
    """The text with its keys at any depth renamed; all else stays character for character. ``names`` is the corpus' key table, which a schema bounds."""
    text = F.coalesce(F.col(json), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(STRING), F.lit(0))
    between = F.split(F.regexp_replace(text, STRING, "\u0000"), "\u0000", -1)
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,string>")

    def new(x: Column) -> Column:
        name = F.regexp_extract(x, STRING, 1)
        return F.when(F.endswith(x, F.lit(":")) & F.map_contains_key(table, name), F.concat(F.lit('"'), F.try_element_at(table, name), F.lit('"'), F.substring(x, F.char_length(name) + 3, F.char_length(x)))).otherwise(x)

    parts = F.zip_with(between, F.transform(found, new), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.col(json).isNotNull(), F.array_join(parts, ""))


def short_names(df: DataFrame, json: str) -> dict[str, str]:
    """The corpus' keys in sorted order as K00, K01, ... (from the 250th on with four digits). A key table is a schema: it fits the driver."""
    found = sorted(r["key"] for r in key_counts(df, json).select("key").collect())
    return {k: f"K{i:02d}" if i < 250 else f"K{i:04d}" for i, k in enumerate(found)}
