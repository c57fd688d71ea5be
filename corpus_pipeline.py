"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.

1. quality classifier: documents that it rejects go.
2. line dedup: recurring lines go but for one copy, except what a document shares with the one that it copies in the main, so
   that stage 3 still sees near copies whole; a document with hardly anything left goes.
3. n-gram Jaccard join: of each group of near copies the document with the smallest id stays.
4. benchmark decontamination: documents that contain a test item go.
5. packing: what is left becomes sequences of tokens.

Nulls, empty texts, repeated ids and empty tables give what the operators' modules define.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_templates, ngram_join, packing, quality_classifier
from millrace.llm.tables import checkpoint_folder, remove, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.keep(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminated),
    ("packing", pack),
]

#: A fitted classifier and a tokeniser have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written to the shared folder and removed when the next stage is written.

    The last stage's input stays, since the result reads it."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
