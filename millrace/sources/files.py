"""Files as tables: whole files, lines, delimited text, JSON, run trees, dated libraries, markdown trees; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import path_fields


def binary_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path``, ``length``, ``content`` of all files below a folder that aren't empty."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return d.where("length > 0")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header, quotes doubled, fields over several lines; strings unless a schema is given (no pass to infer one)."""
    r = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def naive_csv(lines: DataFrame, line: str = "line", quoted: bool = False) -> DataFrame:
    """Fields of each line that isn't blank, split at every comma; ``quoted``: commas between quotes don't count, and quotes go."""
    d = lines.where(F.trim(line) != "")
    fields = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)' if quoted else ",", -1)
    return d.select(F.transform(fields, lambda x: F.replace(x, F.lit('"'), F.lit(""))).alias("fields") if quoted else fields.alias("fields"))


def has_header(fields: Column) -> Column:
    from millrace.operators.profile import header_row

    return header_row(fields)


def json_records(spark: SparkSession, path: str, schema: str, enveloped: str | None = None, lines: bool = True) -> DataFrame:
    """Records of JSON lines, of an array, or of the array that the member ``enveloped`` of an object holds."""
    if enveloped:
        d = spark.read.schema(f"`{enveloped}` array<struct<{schema}>>").option("multiLine", str(not lines).lower()).json(path)
        return d.select(F.explode(enveloped).alias("r")).select("r.*")
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def run_tree(spark: SparkSession, folder: str, schema: str = "pass_rate double, passed int, failed int, total int, time_seconds double, tokens bigint, expectations array<struct<text:string,passed:boolean,evidence:string>>") -> DataFrame:
    """Gradings of eval/configuration/run folders, with the three names from the path."""
    d = spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").option("pathGlobFilter", "grading.json").json(folder)
    p = F.col("_metadata.file_path")
    part = lambda i: F.element_at(F.split(p, "/"), i)
    return d.select("*", part(-4).alias("eval_id"), part(-3).alias("configuration"), F.nullif(F.regexp_extract(part(-2), r"(\d+)$", 1), F.lit("")).cast("int").alias("run_number"))


def dated_library(files: DataFrame, path: str = "path") -> DataFrame:
    """Files whose name begins with a date, oldest first."""
    f = path_fields(F.col(path))
    return files.select(path, f["date"].alias("date"), f["slug"].alias("slug")).where("date is not null").orderBy("date", path)


def prune_oldest(library: DataFrame, keep: int) -> DataFrame:
    """What goes so that ``keep`` files stay: the oldest."""
    n = library.count()
    return library.orderBy("date", "path").limit(max(0, n - keep))


def markdown_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Whole markdown files below a folder; what lies in folders that begin with a dot is left out."""
    d = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.regexp_like("path", F.lit(r"/\.[^/]+/")))


def load_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved list, or an empty one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def save_list(df: DataFrame, path: str) -> None:
    """Replaces a saved list. ``df`` may read from the same path, so it is written beside it first."""
    df.write.mode("overwrite").parquet(f"{path}.next")
    df.sparkSession.read.parquet(f"{path}.next").write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, places: int = 4) -> None:
    """JSON lines with rounded numbers."""
    cols = [F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").json(path)
