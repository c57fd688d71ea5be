"""Functions for SQL: ``register`` makes them known to a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.operators.codecs import CODECS

#: Expressions as SQL functions; they run on the JVM.
EXPRESSIONS = {
    "mr_tokens(t STRING)": ("ARRAY<STRING>", r"filter(split(regexp_replace(lower(coalesce(t, '')), r'[^\p{L}\p{M}\p{N}_\s]', ' '), r'\s+'), w -> char_length(w) >= 3)"),
    "mr_clean(t STRING)": ("STRING", r"trim(regexp_replace(coalesce(t, ''), r'\s+', ' '))"),
    "mr_zigzag(v BIGINT)": ("BIGINT", "shiftleft(v, 1) ^ shiftright(v, 63)"),
    "mr_enum_bits(n BIGINT)": ("INT", "CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 16 THEN 4 WHEN n <= 256 THEN 8 ELSE 16 END"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the expressions, ``mr_pack(data, codec)`` and ``mr_unpack(data, codec)`` for the session; gives their names."""
    names = []
    for head, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
        names.append(head.split("(")[0])

    for name, which in (("mr_pack", 0), ("mr_unpack", 1)):

        def run(data: pd.Series, codec: pd.Series, which: int = which) -> pd.Series:
            return pd.Series([None if d is None else CODECS[c][which](bytes(d)) for d, c in zip(data, codec, strict=True)])

        spark.udf.register(name, F.pandas_udf(_two(run), "binary"))
        names.append(name)
    return names


def _two(fn):
    def two(data: pd.Series, codec: pd.Series) -> pd.Series:
        return fn(data, codec)

    return two
