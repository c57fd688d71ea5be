"""Synthetic inputs of any size: each row follows from its number and a seed alone, so that tasks can run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(seed: int, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(f"{seed}:{salt}")), F.lit(n))


def one_of(values: list[str], seed: int, salt: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), pick(seed, salt, len(values)).cast("int"))


def _at(seed: int) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7 + pick(seed, "t", 7))


def server_log(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    d = spark.range(rows)
    service = F.concat(F.lit("service-"), pick(seed, "s", 20).cast("string"))
    line = F.format_string("%s [%s] %s - %s /api/%s req=%d status=%d bytes=%d latency=%.2fms user=%d", F.date_format(_at(seed), "yyyy-MM-dd HH:mm:ss"), one_of(["INFO", "WARN", "ERROR", "DEBUG"], seed, "l"), service, one_of(["GET", "POST", "PUT", "DELETE"], seed, "m"), pick(seed, "e", 10).cast("string"), pick(seed, "r", 1000000), one_of(["200", "201", "404", "500"], seed, "c").cast("int"), pick(seed, "b", 65536), (pick(seed, "y", 100000) / 100).cast("double"), pick(seed, "u", 5000))
    return d.select("id", line.alias("line"))


def access_log(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    ip = F.concat_ws(".", *(pick(seed, f"ip{k}", 256).cast("string") for k in range(4)))
    line = F.format_string('%s - - [%s] "%s /page/%d HTTP/1.1" %s %d "agent/%d"', ip, F.date_format(_at(seed), "dd/MMM/yyyy:HH:mm:ss"), one_of(["GET", "POST"], seed, "m"), pick(seed, "p", 500), one_of(["200", "301", "404"], seed, "c"), pick(seed, "b", 100000), pick(seed, "a", 9))
    return spark.range(rows).select("id", line.alias("line"))


def json_records(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    r = F.struct(F.col("id"), F.concat(F.lit("item-"), "id").alias("name"), (pick(seed, "v", 1000000) / 100).alias("value"), (pick(seed, "a", 2) == 1).alias("active"), one_of(["north", "south", "east", "west", "centre"], seed, "g").alias("region"), F.transform(F.sequence(F.lit(0), pick(seed, "n", 5).cast("int")), lambda i: F.concat(F.lit("tag"), i)).alias("tags"))
    return spark.range(rows).select("id", F.to_json(r).alias("line"))


def csv_dump(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    fields = [F.col("id").cast("string"), F.concat(F.lit("user"), "id"), F.concat(F.lit("user"), "id", F.lit("@example.com")), (pick(seed, "a", 50) + 18).cast("string"), one_of(["sales", "it", "hr"], seed, "d"), pick(seed, "s", 90000).cast("string"), F.date_format(_at(seed), "yyyy-MM-dd")]
    return spark.range(rows).select("id", F.concat_ws(",", *fields).alias("line"))


def code(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    body = F.format_string("class Item%d:\n    def run(self, x):\n        return x + %d\n", F.col("id"), pick(seed, "k", 100))
    return spark.range(rows).select("id", body.alias("line"))


def prose(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    words = ["river", "stone", "light", "paper", "engine", "field", "quiet", "signal", "round", "north"]
    chosen = [one_of(words, seed, f"w{k}") for k in range(9)]
    return spark.range(rows).select("id", F.concat(F.concat_ws(" ", *chosen), F.lit(".")).alias("line"))


def binary_records(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """24 bytes: id (32 bits), time (64), value (32), status (16), type (16), reserved (32), all big-endian."""
    part = lambda c, n: F.lpad(F.hex(c.cast("bigint")), 2 * n, "0")
    h = F.concat(part(F.col("id"), 4), part(F.lit(1704067200) + F.col("id"), 8), part(pick(seed, "v", 1 << 31), 4), part(pick(seed, "s", 5), 2), part(pick(seed, "y", 9), 2), part(F.lit(0), 4))
    return spark.range(rows).select("id", F.unhex(h).alias("record"))
