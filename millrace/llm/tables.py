"""Shared helpers: reading tables, mapping texts in Arrow slices, bounded samples of labelled rows."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.wordhash import slices

#: Most labelled rows that a model is fitted on; they are chosen by a hash of their id.
TRAINING_ROWS = 12_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, id_col: str, text_col: str, fn: Callable[[np.ndarray, np.ndarray], list], fields: str) -> DataFrame:
    """One row for each row of ``df``: its id, then the columns that ``fn(bytes, offsets)`` gives for a slice of texts.

    Only the id and the text leave the JVM. A null text is given as an empty one; nulls and
    repeats in the id column are kept as they are."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in fields.split(", "))]

    def run(batches):
        for batch in batches:
            for i, raw, offsets in slices(batch.column(1)):
                cols = [batch.column(0).slice(i, len(offsets) - 1), *(pa.array(x) for x in fn(raw, offsets))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {fields}")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, keep=None, rows: int = TRAINING_ROWS) -> DataFrame:
    """Documents with a label, ``rows`` of them at most: those with the smallest hash of their id.

    ``keep`` filters labels first. The sample's ids are bounded, so they are broadcast. Labels that
    are null or not 0 or 1 and rows without an id don't count; a repeated id keeps its largest label, and all its documents are in the sample.
    Who fits a model sorts the rows by hash of the id, label and hash of the text, so that the same rows in other files give the same model."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy(F.col(id_col)).agg(F.max(label_col).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.join(F.broadcast(chosen), id_col)


def add_columns(df: DataFrame, text_col: str, fn: Callable[[np.ndarray, np.ndarray], list], fields: str) -> DataFrame:
    """``df`` with the columns that ``fn(bytes, offsets)`` gives for a slice of texts; all rows and columns stay."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])
    at, names = df.columns.index(text_col), schema.names

    def run(batches):
        for batch in batches:
            for i, raw, offsets in slices(batch.column(at)):
                part = batch.slice(i, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in fn(raw, offsets))], names=names)

    return df.mapInArrow(run, schema)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where the session names none, a local run takes a temporary one; a cluster can't, since its executors don't share it."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if not context.getCheckpointDir():  # named after the session began
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp())
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the file system that its path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, so that its lineage ends."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there; the files go when the session's JVM ends. Smaller than a checkpoint, and its columns can be read apart."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/table-{uuid4()}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)
