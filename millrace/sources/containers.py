"""Container files: folders of packed values, read and checked on the JVM, unpacked by Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.codecs import header, pack_best, unpack_all
from millrace.sources.files import binary_files


def write(df: DataFrame, key: str, column: str, path: str, level: int = 6) -> None:
    """Each value's smallest container as a row of a Parquet table: many small containers make a few large files."""
    pack_best(df, key, column, level).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The values again. A container that isn't valid fails the job with what is wrong."""
    return unpack_all(spark.read.parquet(path), key)


def inspect(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``valid``, ``strategy`` and ``original_size`` of stored containers, without unpacking any."""
    return spark.read.parquet(path).select(key, header(F.col("container")).alias("h"), F.octet_length("container").alias("packed_size")).select(key, "h.*", "packed_size")


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path`` and ``content`` of container files below a folder; files that aren't containers are left out (``inspect_files`` lists them)."""
    f = binary_files(spark, folder, glob).withColumn("h", header(F.col("content")))
    return unpack_all(f.where("h.valid"), "path", "content")


def inspect_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return binary_files(spark, folder, glob).select("path", "length", header(F.col("content")).alias("h")).select("path", "length", "h.*")


def compare(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Whether two tables of values agree, key by key (null: only one has the key). Digests are joined, not the values."""
    x = a.select(key, F.md5(F.col(column).cast("binary")).alias("__a"), F.octet_length(F.col(column).cast("binary")).alias("size_a"))
    y = b.select(key, F.md5(F.col(column).cast("binary")).alias("__b"), F.octet_length(F.col(column).cast("binary")).alias("size_b"))
    return x.join(y, key, "full_outer").select(key, (F.col("__a") == F.col("__b")).alias("same"), "size_a", "size_b")
