"""Benchmark decontamination: MinHash containment search, verified exactly (operator 1).

A document contains a test item when at least THRESHOLD % of the item's distinct five-word shingles
are in it. Items are partitioned by the size of their shingle sets (powers of two). Each item keeps
the MinHash sketch of its k smallest shingle hashes, with k = q - ceil(t q) + 1 for q shingles: a
document that has at least ceil(t q) of the q shingles lacks fewer than k, so it has one of the k in
the sketch, and no item is missed at any document length. Only documents that are large enough probe a
partition. Candidates are then verified on the words themselves, not on their hashes.

A banded MinHash signature of whole documents can't do this: an item of 20 shingles in a document
of 4,000 has a Jaccard similarity of 0.005, which no affordable number of bands finds. So the sketch is
taken on the item's side and the document's side is probed in full.

Items are taken in blocks of bounded size; each block is sent to all tasks and searched in one pass
over the documents. No row is shuffled.

Defined results: null or empty texts and items without a word match nothing; an item or document
with fewer than five words has its whole sequence as its one shingle. Rows with null or repeated ids count
each on their own (repeated items give repeated pairs); empty tables give no pairs; extra columns
are ignored by ``search`` and kept by ``clean``. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.wordhash import LOWER, SYMBOLS, U, Words, distinct_sets, shingles, slices

THRESHOLD = 75
SHINGLE = 5
#: Bytes of item text that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 20


def _strings(words: Words, low: np.ndarray, first: int, last: int, at: np.ndarray) -> list[bytes]:
    """The shingles that begin at the words ``at`` of a text with the words first..last."""
    n = min(SHINGLE, last - first)
    return [b" ".join(low[words.start[i + k] : words.end[i + k]].tobytes() for k in range(n)) for i in at]


class Partition:
    """The sketches of items with similar numbers of shingles."""

    def __init__(self, items: list[int], sets: list[np.ndarray]):
        self.least = min(-(-THRESHOLD * len(sets[i]) // 100) for i in items)
        hashes, owner = [], []
        for i in items:
            q = len(sets[i])
            k = q + (-THRESHOLD * q // 100) + 1
            hashes.append(sets[i][:k])
            owner += [i] * k
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner = h[order], np.array(owner)[order]
        self.maybe = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.maybe[(h >> U(64 - _TABLE_BITS)).astype(np.int64)] = True


class Index:
    """A block of items, ready to be searched for in texts."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.sets, self.strings = ids, [], []
        for _, raw, offsets in slices(pa.array(texts, type=pa.string())):
            w, low = Words(raw, offsets, SYMBOLS), LOWER[raw]
            h, at = shingles(w, SHINGLE)
            self.sets += distinct_sets(h, at)
            for i in range(len(offsets) - 1):
                a, b = w.first[i], w.first[i + 1]
                self.strings.append(set(_strings(w, low, a, b, np.arange(a, a + at[i + 1] - at[i]))))
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                by_size.setdefault(len(s).bit_length(), []).append(i)
        self.partitions = [Partition(by_size[k], self.sets) for k in sorted(by_size)]

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all texts that contain an item."""
        w = Words(raw, offsets, SYMBOLS)
        h, at = shingles(w, SHINGLE)
        each, found = np.diff(at), set()
        owner = np.repeat(np.arange(len(each)), each)
        top = (h >> U(64 - _TABLE_BITS)).astype(np.int64)
        for p in self.partitions:
            pos = np.flatnonzero(p.maybe[top] & (each >= p.least)[owner])
            lo, hi = np.searchsorted(p.hashes, h[pos], "left"), np.searchsorted(p.hashes, h[pos], "right")
            for k in np.flatnonzero(hi > lo):
                found.update((int(owner[pos[k]]), int(i)) for i in p.owner[lo[k] : hi[k]])
        out, low = [], LOWER[raw] if found else None
        for d, i in sorted(found):
            mine = h[at[d] : at[d + 1]]
            same = np.flatnonzero(np.isin(mine, self.sets[i]))
            need = THRESHOLD * len(self.strings[i])
            if 100 * len(np.unique(mine[same])) >= need:
                shared = len(self.strings[i].intersection(_strings(w, low, w.first[d], w.first[d + 1], w.first[d] + same)))
                if 100 * shared >= need:
                    out.append((d, i, shared))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Items in blocks of about BLOCK_BYTES; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += 4 * len(r.t)
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it contains: ``n_item`` and ``n_shared`` shingles, ``containment``."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_col)))
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, n_item bigint, n_shared bigint, containment double"
    texts = docs.select(id_col, F.col(text_col).cast("string"))

    def one(block) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            index = Index(*sent.value)
            ids = pa.array(index.ids)
            for batch in batches:
                for first, raw, offsets in slices(batch.column(1)):
                    if hits := index.search(raw, offsets):
                        d, i, shared = (np.array(x) for x in zip(*hits, strict=True))
                        size = np.array([len(index.strings[k]) for k in i])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d + first)), ids.take(pa.array(i)), pa.array(size), pa.array(shared), pa.array(shared / size)], names=[id_col, item_col, "n_item", "n_shared", "containment"])

        return texts.mapInArrow(run, schema)

    parts = [one(b) for b in blocks(items, item_col, item_text)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns."""
    at = docs.columns.index(text_col)
    for block in blocks(items, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            index = Index(*sent.value)
            for batch in batches:
                for first, raw, offsets in slices(batch.column(at)):
                    keep = np.ones(len(offsets) - 1, dtype=bool)
                    keep[[d for d, _, _ in index.search(raw, offsets)]] = False
                    yield batch.slice(first, len(keep)).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
