"""Toxicity: logistic regression by FTRL-proximal over hashed n-grams and skip-grams (operator 4).

Features are the distinct words, word pairs and pairs with one word between of a whole text, hashed
to 2**BITS buckets. Training takes a bounded sample of labelled rows; each coordinate has its own
learning rate, and L1 leaves few weights other than zero, which are sent to the tasks that score.

Defined results: a null or empty text has no features and gets the score of the bias; ids may be
null or repeated, each row is scored on its own; rows of a repeated id all train, in the order of their texts' hashes; with no usable label all scores are 0.5; an
empty table gives an empty result; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import TRAINING_ROWS, labelled_sample, map_texts
from millrace.llm.wordhash import SYMBOLS, U, Words, combine, slices

BITS = 20


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all words, pairs and skip pairs, with repeats."""
    w = Words(raw, offsets, SYMBOLS)
    doc, h = np.repeat(np.arange(len(offsets) - 1), w.counts), w.hash
    docs, hashes = [doc], [combine([h], 1)]
    for gap in (1, 2):
        if len(h) > gap:
            inside = np.flatnonzero(doc[gap:] == doc[:-gap])
            docs.append(doc[inside])
            hashes.append(combine([h[inside], h[inside + gap]], 1 + gap))
    return np.concatenate(docs), (np.concatenate(hashes) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    buckets: np.ndarray  # sorted; of the weights other than zero
    weights: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, bucket = features(raw, offsets)
        used = np.zeros(1 << BITS, dtype=bool)
        used[self.buckets] = True
        hit = used[bucket]
        pairs = np.unique((doc[hit] << BITS) | bucket[hit])
        weight = self.weights[np.searchsorted(self.buckets, pairs & ((1 << BITS) - 1))] if len(pairs) else np.empty(0)
        z = self.bias + np.bincount(pairs >> BITS, weights=weight, minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, int]], alpha: float = 3.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 6, least_texts: int = 4) -> Model:
    """FTRL-proximal. rows: the distinct buckets of a text and its label. The bias has no L1. Buckets of fewer than ``least_texts`` texts are left out."""
    size = 1 << BITS
    if rows:
        common = np.bincount(np.concatenate([f for f, _ in rows]), minlength=size) >= least_texts
        rows = [(f[common[f]], y) for f, y in rows]
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(z[i]) <= l1] = 0
        bias = i == size
        w[bias] = -z[size] / ((beta + math.sqrt(n[size])) / alpha + l2)
        return w

    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, y = rows[k]
            i = np.append(buckets, size)
            w = weight(i)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(size + 1))
    buckets = np.flatnonzero(w[:-1])
    return Model(buckets, w[buckets], float(w[-1]))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """Learns from ``rows`` labelled documents at most, none of them held out."""
    sample = labelled_sample(docs.select(id_col, text_col), labels, id_col, label_col, keep=~held_out(id_col), rows=rows)
    sample = sample.select(F.xxhash64(id_col).alias("id"), F.col("__label").alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))

    def fn(batches):
        for b in batches:
            for i, raw, offsets in slices(b.column(2)):
                m = len(offsets) - 1
                doc, bucket = features(raw, offsets)
                pairs = np.unique((doc << BITS) | bucket)
                at = np.searchsorted(pairs, np.arange(m + 1) << BITS)
                ids = (pairs & ((1 << BITS) - 1)).astype("<i4")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, m), b.column(1).slice(i, m), b.column(3).slice(i, m), pa.array([ids[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], type=pa.binary())], names=["id", "label", "hash", "buckets"])

    got = sample.mapInArrow(fn, "id bigint, label int, hash bigint, buckets binary").toArrow().sort_by([(c, "ascending") for c in ("id", "label", "hash")])
    return train([(np.frombuffer(x.as_py(), dtype="<i4"), y) for x, y in zip(got["buckets"], got["label"].to_pylist(), strict=True)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` (1: toxic) of each document."""
    out = map_texts(docs, id_col, text_col, lambda raw, offsets: [model.score(raw, offsets)], "score double")
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
