"""Counting substrings of fixed lengths where only the commonest are wanted: they never go through a shuffle all at once.

A sketch counts all substrings in buckets of a hash. Its size is fixed, and a bucket's count is never below that of any
substring in it, so it says which buckets can't hold a wanted one. Only substrings of the other buckets are then counted as they
are, by their characters; they are combined in each slice of texts and in each task before they are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes; a single longer text is one slice.
SLICE_BYTES = 1 << 20
#: Counters in one row of a sketch's shuffle.
CHUNK = 1 << 12

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20251126)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, kept between calls."""
    if len(_powers.get(base, ())) < n:
        out = np.ones(max(n, SLICE_BYTES + 1), dtype=np.uint64)
        out[1:] = np.uint64(base)
        _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of successive texts; a null is an empty text."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        if offsets[i] < offsets[j]:
            yield np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass(frozen=True)
class Length:
    """Substrings of n characters at every stride; their buckets in a sketch are base and the 2**bits - 1 after it."""

    n: int
    stride: int
    bits: int
    base: int

    @property
    def end(self) -> int:
        return self.base + (1 << self.bits)


def layout(strides: dict[int, int], most_bits: int = 22) -> list[Length]:
    """A longer substring saves more, so that what it shares its bucket with counts more: lengths get buckets in proportion."""
    out, base = [], 0
    for n, stride in strides.items():
        out.append(Length(n, stride, min(most_bits, 14 + (n - 1).bit_length()), base))
        base = out[-1].end
    return out


def spots(raw: np.ndarray, offsets: np.ndarray, lengths: list[Length]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first byte, the byte after the last and bucket of each substring. Strides are counted in code points from a text's first."""
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    first = np.searchsorted(heads, offsets)
    heads = np.append(heads, len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * powers(_BASE, len(raw)), out=sums[1:])
    inverse = powers(_INVERSE, len(raw))
    for x in lengths:
        each = np.maximum(0, (np.diff(first) - x.n) // x.stride + 1)
        at = np.cumsum(each) - each
        char = np.arange(each.sum()) * x.stride + np.repeat(first[:-1] - at * x.stride, each)
        start, end = heads[char], heads[char + x.n]
        h = (sums[end] - sums[start]) * inverse[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield start, end, (h >> np.uint64(64 - x.bits)).astype(np.int64) + x.base


def sketch(docs: DataFrame, text: str, lengths: list[Length]) -> np.ndarray:
    """How many substrings are in each bucket. Tasks send at most one row for each CHUNK buckets; the driver gets 8 bytes a bucket, whatever the input."""
    size = lengths[-1].end

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for raw, offsets in slices(batch.column(0)):
                for _, _, bucket in spots(raw, offsets, lengths):
                    np.add.at(total, bucket, 1)
        yield from rows(enumerate(total.reshape(-1, CHUNK)))

    def rows(chunks):
        """Counters as small as their values allow."""
        used = [(k, c.astype(np.min_scalar_type(c.max())).tobytes()) for k, c in chunks if c.any()]
        for i in range(0, len(used), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*used[i : i + 64], strict=True), (pa.int32(), pa.binary()), strict=True)], names=["chunk", "counts"])

    def add(batches):
        total = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(c, dtype=f"u{len(c) // CHUNK}")
                total[k] = total[k] + c if k in total else c.astype(np.int64)
        yield from rows(total.items())

    kind = "chunk int, counts binary"
    parts = docs.select(F.col(text).cast("string")).mapInArrow(count, kind)
    out = np.zeros((size // CHUNK, CHUNK), dtype=np.int64)
    for k, c in parts.repartition("chunk").mapInArrow(add, kind).collect():
        out[k] = np.frombuffer(c, dtype=f"u{len(c) // CHUNK}")
    return out.reshape(-1)


def counts(docs: DataFrame, text: str, lengths: list[Length], buckets: np.ndarray) -> DataFrame:
    """The substrings in those buckets (a boolean for each of the sketch) and how often each is seen, exactly."""
    packed, size = np.packbits(buckets), len(buckets)

    def pick(batches):
        wanted = np.unpackbits(packed, count=size).view(bool)
        for batch in batches:
            for raw, offsets in slices(batch.column(0)):
                for start, end, bucket in spots(raw, offsets, lengths):
                    hit = wanted[bucket]
                    if hit.any():
                        found = pc.value_counts(texts_at(raw, start[hit], end[hit]))
                        yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["gram", "seen"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(pick, "gram string, seen bigint")
    return found.groupBy("gram").agg(F.sum("seen").alias("seen"))


def texts_at(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    at = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=at[1:])
    data = raw[np.arange(at[-1]) + np.repeat(start - at[:-1], end - start)]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data)])


def best(docs: DataFrame, text: str, strides: dict[int, int], worth: Callable, most: int) -> DataFrame:
    """The ``most`` substrings of the highest ``worth``, then smallest by their bytes: gram, n, seen and the worth, which is above 0.

    ``worth(n, seen)`` is given a length and a column or an array, and must not fall with seen; a substring seen once has none. The buckets of the
    highest bounds are counted, and after them all others that may hold one as good as the last of the best so far, so the result is exact.
    Where hardly anything repeats, these are many, and most substrings are shuffled after all. The driver holds at most ``most`` rows."""
    lengths = layout(strides)
    total = sketch(docs, text, lengths)
    bound = np.concatenate([worth(x.n, total[x.base : x.end]) for x in lengths])
    bound[total < 2] = 0
    order = [F.desc("worth"), F.asc("gram")]

    def top(buckets: np.ndarray) -> DataFrame:
        c = counts(docs, text, lengths, buckets).where("seen > 1").select("gram", F.char_length("gram").alias("n"), "seen")
        value = F.coalesce(*(F.when(F.col("n") == n, worth(n, F.col("seen"))) for n in strides))
        return c.withColumn("worth", value.cast("bigint")).where("worth > 0").orderBy(*order).limit(most)

    enough = 4 * most
    chosen = bound > max(0, np.partition(bound, -enough)[-enough] if enough < len(bound) else 0)
    found = top(chosen)
    kept = found.toArrow()
    least = pc.min(kept["worth"]).as_py() if kept.num_rows == most else 1
    out = docs.sparkSession.createDataFrame(kept, found.schema)
    rest = (bound >= least) & ~chosen
    return (out.unionAll(top(rest)) if rest.any() else out).orderBy(*order).limit(most)
