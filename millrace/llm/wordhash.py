"""Vectorised words and word shingles of Arrow string columns.

Everything here works on UTF-8 bytes: all separators and all case folding of the
word definitions in this subpackage are ASCII, so bytes give the same words as
code points do. A batch is handled in slices of about ``SLICE_BYTES``, which
bounds memory; a single longer text makes a slice of its own (texts are never cut).

Hashes are 64-bit. A word's hash is a polynomial over random values of its bytes;
a shingle's hash mixes the hashes of its words. Equal words give equal hashes in
every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _libc = ctypes.CDLL(None)
except (OSError, TypeError):  # no C library by that way
    _libc = None

SLICE_BYTES = 1 << 20
U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.empty(size, dtype=U)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def release_memory() -> None:
    """Gives freed memory back to the system. Workers are used again by later tasks, so what an allocator keeps adds up on an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim:
        trim(0)


class Words:
    """Words of a slice of texts: ``start`` and ``end`` (byte offsets in ``raw``), ``hash``; words of text i are ``first[i]:first[i + 1]``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, lower: bool = True):
        self.raw, self.offsets = raw, offsets
        low = LOWER[raw] if lower else raw
        sep = separators[low]
        inside = ~sep
        opens, closes = inside.copy(), inside.copy()
        if len(raw):
            opens[1:] &= sep[:-1]
            closes[:-1] &= sep[1:]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            opens[heads] = inside[heads]
            tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            closes[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.sums = np.zeros(len(raw) + 1, dtype=U)
        np.cumsum(_VALUES[low] * powers(_BASE, len(raw)), out=self.sums[1:])
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes (after lower-casing, if asked for) have equal hashes anywhere."""
        return mix((self.sums[end] - self.sums[start]) * powers(_INVERSE, len(self.raw) + 1)[start] + (end - start).astype(U))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def combine(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """A hash of aligned hashes, in order."""
    out = parts[0] + U(seed)
    for x in parts[1:]:
        out = out * U(0xD6E8FEB86659FD93) + x
    return mix(out)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and where each text's runs begin (n + 1 values).

    A text with fewer words, but at least one, has its whole sequence as one shingle."""
    counts, h = words.counts, words.hash
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(each, out=at[1:])
    full = combine([h[i : len(h) - size + 1 + i] for i in range(size)], size) if len(h) >= size else np.empty(0, dtype=U)
    begin = words.first[:-1]
    index = np.arange(at[-1]) - np.repeat(at[:-1] - begin, each)
    out = full[np.minimum(index, len(full) - 1)] if len(full) else np.zeros(at[-1], dtype=U)
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            out[at[short]] = combine([h[begin[short] + i] for i in range(k)], k)
    return out, at


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of successive slices; a null is an empty text."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = pc.fill_null(chunk.cast(pa.large_binary()), b"") if chunk.type != pa.large_binary() or chunk.null_count else chunk
        n = len(chunk)
        if not n:
            continue
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(chunk.buffers()[2], dtype=np.uint8) if chunk.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def distinct_sets(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
