"""Packing documents into token sequences with balanced attention cost (operator 8).

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: the linear part of a transformer's
work and the attention within the piece. Each task tokenises its texts, collects the documents of
about ``POOL_TOKENS`` tokens, cuts what exceeds a sequence, opens as many sequences as their tokens
fill, and gives the pieces in descending order to the sequence of the lowest cost with room for
them. What fits nowhere whole is cut into the room that is left, the cheapest open sequence first, so that all sequences of a pool
are full; the rest that fills none goes on to the next pool. What is left at the end of a task, less than a sequence, becomes sequences
whose lengths are powers of two, which need no padding. No row is shuffled: the packing depends on the input's partitions alone and a task
that runs again gives the same sequences.

Defined results: a null or empty text has the single id that ends a document; the literal ``<|endoftext|>``
in a text is the vocabulary's special id 50256, as the ``tokenizers`` library gives it with add_special_tokens=False; null, repeated ids
and equal texts are packed row by row; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END_ID = 1
POOL_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 512

FIELDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, piece_cost double"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


#: Fixed value: the vocabulary's one special token. Its string in a text is that id.
SPECIAL = {"<|endoftext|>": 50256}


def encoder(ranks_path: str | None = None):
    """A function from text to ids of the byte-level BPE of 50,257 ids.

    Its merge ranks run in tiktoken, which is about six times as fast as the ``tokenizers`` library on the same
    vocabulary. tests/llm hold the ids of both equal for every code point, around the special token and on random texts."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return partial(encoding.encode, allowed_special="all")


def cuts(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(document, start, n) of pieces of at most ``length`` tokens."""
    return [(d, s, min(length, n - s)) for d, n in enumerate(sizes) for s in range(0, n, length)]


def assign(pieces: list[tuple[int, int, int]], length: int = LENGTH, last: bool = False) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences of pieces, all full, and the pieces left over (``last``: none, they make sequences of powers of two).

    Descending pieces go to the sequence of least cost that has room: sequences with room for the piece lie
    in one heap by cost, the others wait in one by room until a piece is small enough. Pieces that then fit nowhere whole are
    cut into the open sequence of least cost, one after the other. Ties go to the lower number."""
    total = sum(p[2] for p in pieces)
    count = total // length
    order = sorted(pieces, key=lambda p: (-p[2], p[0], p[1]))
    filled: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    heap = [(0.0, i) for i in range(count)]
    room, spent = [length] * count, [0.0] * count
    later: list[tuple[int, int, int]] = []
    k = 0
    while k < len(order) and order[k][2] == length and k < count:  # a full piece is a sequence
        filled[k].append(order[k])
        room[k] = 0
        k += 1
    heap = heap[k:]
    wait: list[tuple[int, float, int]] = []
    for p in order[k:]:
        while wait and -wait[0][0] >= p[2]:
            heapq.heappush(heap, heapq.heappop(wait)[1:])
        if not heap:
            later.append(p)
            continue
        _, i = heapq.heappop(heap)
        filled[i].append(p)
        room[i] -= p[2]
        spent[i] += cost(p[2])
        if room[i] >= p[2]:
            heapq.heappush(heap, (spent[i], i))
        elif room[i]:
            heapq.heappush(wait, (-room[i], spent[i], i))
    open_, rest = [(spent[i], i) for i in range(count) if room[i]], []
    heapq.heapify(open_)
    for d, s, n in later:
        while n and open_:
            _, i = heapq.heappop(open_)
            take = min(n, room[i])
            filled[i].append((d, s, take))
            room[i], s, n = room[i] - take, s + take, n - take
            spent[i] += cost(take)
            if room[i]:
                heapq.heappush(open_, (spent[i], i))
        if n:
            rest.append((d, s, n))
    if last:
        filled += tail(rest)
        rest = []
    return filled, rest


def tail(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences whose lengths are the powers of two in the pieces' total, largest first, so that none needs padding."""
    total, out, left = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        if room:
            out.append([])
        while room:
            d, s, n = left.pop()
            take = min(n, room)
            out[-1].append((d, s, take))
            room -= take
            if take < n:
                left.append((d, s + take, n - take))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, ranks_path: str | None = None) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {FIELDS}"

    def run(batches):
        encode = encoder(ranks_path)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[object, np.ndarray, int]] = []  # id, tokens from the first that isn't packed yet, how many were before
        pool = 0

        def flush(last: bool):
            nonlocal held, pool, number
            pieces = cuts([len(t) for _, t, _ in held], length)
            full, rest = assign(pieces, length, last)
            out: list[list] = [[] for _ in range(9)]
            for seq in full:
                at, whole = 0, sum(p[2] for p in seq)
                for d, s, n in seq:
                    key, tokens, before, doc_tokens = *held[d], sizes[d]
                    row = (key, before + s, n, zlib.crc32(tokens[s : s + n].tobytes()), doc_tokens, number, at, whole, cost(n))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                    at += n
                number += 1
            # what is left, at most one sequence of tokens, is held for the next pool
            keep, keep_sizes = [], []
            for d, s, n in rest:
                key, tokens, before = held[d]
                keep.append((key, tokens[s : s + n], before + s))
                keep_sizes.append(sizes[d])
            held, pool = keep, sum(len(x[1]) for x in keep)
            sizes[:] = keep_sizes
            for i in range(0, len(out[0]), 10_000):
                part = [c[i : i + 10_000] for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(part, types, strict=True)], names=names)

        sizes: list[int] = []
        types, names = None, [id_col, *(x.split()[0] for x in FIELDS.split(", "))]
        for batch in batches:
            types = types or [batch.column(0).type, *[pa.int64()] * 7, pa.float64()]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                held.append((key, np.array(ids, dtype="<u4"), 0))
                sizes.append(len(ids))
                pool += len(ids)
                if pool >= POOL_TOKENS:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
