"""Classification of contents, types of columns and keys, presence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import numbered

INT, FLOAT, DATE = r"^[+-]?[0-9]+(_[0-9]+)*$", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"^\d{4}-\d{2}-\d{2}"
#: Words that hint at program code.
CODE = ["def ", "class ", "import ", "function ", "var ", "const "]
LOG_LINE, ACCESS_LINE, JSON_KEY = r"\d{4}-\d{2}-\d{2}.*\[(?:INFO|WARN|ERROR|DEBUG)\]", r"\d+\.\d+\.\d+\.\d+.*HTTP/\d\.\d", r'"[A-Za-z0-9_]+"\s*:'


def printable_share(sample: Column) -> Column:
    """Share of bytes that are printable ASCII, tab or line ends."""
    return F.regexp_count(sample, F.lit(r"[ -~\t\n\r]")) / F.greatest(F.lit(1), F.octet_length(sample))


def content_type(text: Column, sample: int = 8192) -> Column:
    """json, log, csv, code, text, binary or empty, by ordered rules over the first ``sample`` characters (the feature is a look at the head)."""
    s = F.substring(text, 1, sample)
    head = F.slice(F.split(s, "\n"), 1, 10)
    commas = F.transform(F.filter(head, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    is_csv = (F.size(F.split(s, "\n")) >= 3) & (F.size(F.array_distinct(commas)) == 1) & (F.get(commas, F.lit(0)) >= 3)
    opens = F.regexp_like(s, F.lit(r"^\s*[{\[]"))
    is_json = opens & ((F.regexp_count(s, F.lit(JSON_KEY)) >= 3) | F.try_parse_json(s).isNotNull())
    code = reduce(lambda a, b: a + b, [F.contains(s, F.lit(w)).cast("int") for w in CODE])
    return F.when(text.isNull() | (text == ""), "empty").when(is_json, "json").when((F.regexp_count(s, F.lit(LOG_LINE)) >= 3) | (F.regexp_count(s, F.lit(ACCESS_LINE)) >= 3), "log").when(is_csv, "csv").when(code >= 2, "code").when(printable_share(s) > 0.85, "text").otherwise("binary")


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of string forms."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").where("value is not null")


def column_types(df: DataFrame, columns: list[str], enum_least: int = 50, enum_share: int = 3, dates: bool = True) -> DataFrame:
    """int, float, date, enum or string for each column. All values count (enum: at most max(enum_least, n / enum_share) distinct ones).

    Values are counted per (column, value) first, so that a frequent value is combined before it is shuffled."""
    v = unpivot(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    test = lambda p: F.min(F.regexp_like("value", F.lit(p)))
    g = v.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("uniq"), test(INT).alias("ints"), test(FLOAT).alias("floats"), test(DATE).alias("dates"))
    few = F.col("uniq") <= F.greatest(F.lit(enum_least), F.floor(F.col("n") / enum_share))
    kind = F.when(F.col("ints"), "int").when(F.col("floats") | F.col("ints"), "float")
    if dates:
        kind = kind.when(F.col("dates") & (F.col("uniq") <= F.floor(F.col("n") / 2)), "date")
    return g.select("column", kind.when(few, "enum").otherwise("string").alias("kind"), "n", "uniq")


def is_numeric(s: Column) -> Column:
    """A number, or nothing."""
    t = F.trim(F.coalesce(s, F.lit("")))
    return (t == "") | F.regexp_like(t, F.lit(FLOAT))


def header_row(fields: Column) -> Column:
    """All fields are letters and ``_``."""
    return F.forall(fields, lambda x: F.regexp_like(F.trim(x), F.lit(r"^[\p{L}_]+$")))


def json_pairs(df: DataFrame, key: str, json: str) -> DataFrame:
    """(row, position, key, raw value) of all top-level members."""
    keys = F.json_object_keys(json)
    return df.select(F.col(key).alias("row"), F.col(json).alias("__j"), F.posexplode(keys).alias("pos", "key")).withColumn("value", F.expr("get_json_object(__j, concat('$[\\'', key, '\\']'))")).drop("__j")


def json_kind(value: Column) -> Column:
    return F.when(value.isNull(), "null").when(value.isin("true", "false"), "bool").when(F.regexp_like(value, F.lit(r"^-?[0-9]+$")), "int").when(F.regexp_like(value, F.lit(r"^-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$")), "float").otherwise("str")


def json_key_types(df: DataFrame, key: str, json: str) -> DataFrame:
    """The dominant type of each key and how often the key occurs; ties go to the first type in the alphabet."""
    c = json_pairs(df, key, json).groupBy("key", json_kind(F.col("value")).alias("type")).agg(F.count("*").alias("n"))
    return c.groupBy("key").agg(F.min(F.struct(-F.col("n"), F.col("type"))).alias("best"), F.sum("n").alias("cnt")).select("key", F.col("best.type").alias("type"), "cnt")


def json_key_order(df: DataFrame, key: str, json: str) -> DataFrame:
    """The union of all keys in the order in which they are first seen."""
    first = json_pairs(df, key, json).groupBy("key").agg(F.min(F.struct("row", "pos")).alias("at"))
    return numbered(first.select("at.row", "at.pos", "key"), ["row", "pos", "key"], "position").select("key", F.col("position").cast("int").alias("position"))


def json_presence(df: DataFrame, json: str) -> DataFrame:
    """How many rows have each key, and how many don't. A null value counts as missing."""
    total = df.agg(F.count("*").alias("rows"))
    keys = df.withColumn("__row", F.lit(0)).transform(lambda d: json_pairs(d, "__row", json)).where("value is not null").groupBy("key").agg(F.count("*").alias("present"))
    return keys.withColumn("missing", total.scalar() - F.col("present"))


def consistent_records(df: DataFrame, json: str, share: float = 0.8) -> DataFrame:
    """Whether more than ``share`` of the rows have the commonest number of keys."""
    n = df.select(F.coalesce(F.size(F.json_object_keys(json)), F.lit(0)).alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    return n.agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("n_keys"), (F.max("c") / F.sum("c") > share).alias("consistent"))


def dictionary_bits(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column and the bits of an index among them."""
    from millrace.functions.numbers import enum_bits

    v = unpivot(df, columns).distinct().groupBy("column").agg(F.count("*").alias("n_unique"))
    return v.withColumn("bits", enum_bits(F.col("n_unique")))


def sorted_dictionary(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value of an enumeration with its index in sorted order."""
    return numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], "idx").withColumn("idx", F.col("idx").cast("int"))


def front_matter_problems(name: Column, description: Column, keys: Column) -> Column:
    """What is wrong with a front matter block."""
    allowed = F.array(*map(F.lit, ["name", "description", "license", "allowed-tools", "metadata", "compatibility"]))
    return F.array_compact(F.array(
        F.when(F.size(F.array_except(keys, allowed)) > 0, "unexpected key"),
        F.when(name.isNull(), "no name"),
        F.when(~F.regexp_like(name, F.lit("^[a-z0-9-]+$")), "not kebab-case"),
        F.when(F.regexp_like(name, F.lit("^-|-$|--")), "hyphens"),
        F.when(F.length(name) > 64, "name too long"),
        F.when(description.isNull(), "no description"),
        F.when(F.regexp_like(description, F.lit("[<>]")), "angle brackets"),
        F.when(F.length(description) > 1024, "description too long"),
    ))


def drop_blank_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in which at least one of the columns has a value; white space and zero-width characters alone are none."""
    from millrace.functions.text import blank_to_null

    kinds = dict(df.dtypes)
    cols = columns or df.columns
    return df.where(reduce(lambda a, b: a | b, [(blank_to_null(F.col(c)) if kinds[c] == "string" else F.col(c)).isNotNull() for c in cols]))


def json_flatten(df: DataFrame, json: str, keys: dict[str, str]) -> DataFrame:
    """One typed column for each key; a missing key, a null and a value of another type are null."""
    get = lambda k: F.get_json_object(json, f"$['{k}']")
    return df.select("*", *(get(k).try_cast(t).alias(k) for k, t in keys.items()))


def json_short_keys(df: DataFrame, key: str, json: str) -> DataFrame:
    """The corpus' keys in the order in which they are first seen, as K00, K01, ..."""
    return json_key_order(df, key, json).select("key", F.concat(F.lit("K"), F.lpad(F.col("position").cast("string"), 2, "0")).alias("short"))


def json_rename(df: DataFrame, key: str, json: str, names: DataFrame) -> DataFrame:
    """(row, object with short keys): values stay as they are, as strings."""
    p = json_pairs(df, key, json).join(names, "key")
    g = p.groupBy("row").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("pos", "short", "value"))), lambda x: F.struct(x["short"], x["value"]))).alias("m"))
    return g.select(F.col("row").alias(key), F.to_json("m").alias("renamed"))
