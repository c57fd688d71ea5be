"""N-gram Jaccard join: near copies by a prefix-tree join over globally ordered shingles (operator 7).

Two documents link when the Jaccard similarity of their sets of distinct five-word shingles is at least
THRESHOLD %. The result is each document's component; all links between different texts are found.

1. Exact copies of a set are one node from the start (a grouped aggregation by a 128-bit digest). A node goes by one half of
   its digest; where two digests agree in it, those nodes go by the other half.
2. Document frequencies: nodes send their shingles, packed, to partitions by shingle. Each task sorts what it gets and
   returns the shingles of two or more nodes, again packed, to partitions by node. The others can't be
   shared, so all overlaps follow from what remains. Hot shingles (at most HOT_KEYS, found while the digests are taken, from what
   repeats within a slice of texts) count as most frequent and go to partitions by shingle and node, so that no
   task holds all nodes of one; which they are changes the order, but no result.
3. Each node orders its shingles by (frequency, hash), the global order. Two sets of at least the
   threshold share a shingle among the first n - ceil(t n) + 1 of both, so only those are posted;
   nodes without a posted shingle have no link and go. Rare shingles come first, so a passage that
   many documents share is posted hardly ever.
4. Candidates, in rounds, so that a large group never emits all its pairs: in each of ROUNDS rounds each
   posted shingle pairs its nodes with one of them only, its hub, and the links found are contracted to
   components. Then all pairs across components are taken that are left; one side of them always lies outside the
   component of one chosen node of the shingle, which by then is nearly all of a large group, and the other is looked up by the shingle and
   by the sizes that the node can link with: its own size and the shingles from this one on bound them on both sides.
5. Verification is the prefix-tree walk: the ordered sets of the partners of one node, sorted, form a
   trie whose nodes are shared prefixes. The walk keeps the partial overlap at each depth, takes it up
   again at the longest common prefix of the next set, and leaves a subtree when the overlap so far and
   the remaining length can't reach what is required.
6. Components by alternating large-star and small-star steps, each written to the checkpoint folder.

Hashes of shingles have 64 bits, of which at least 48 are compared: an overlap is wrong only if two
different shingles of one pair of texts agree in all of them.

Defined results: a null or empty text or one without a word has an empty set and links with nothing; a
text with fewer than five words has its whole sequence as its one shingle; rows are nodes, so a repeated
id is compared row by row; a null id doesn't count as smallest, a component of null ids alone has the
id null; an empty table gives an empty result; extra columns are ignored by ``components`` and kept by
``representatives``. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import add_columns, map_texts, saved
from millrace.llm.wordhash import WHITE, U, Words, mix, release_memory, shingles, slices

THRESHOLD = 75
SHINGLE = 5
#: Shingles in a partition of the exchanges; the number of partitions follows from it.
PARTITION_SHINGLES = 2_000_000
FLUSH_SHINGLES = 1_000_000
#: Hot shingles that are dealt out by node: at most so many, and only of at least so many nodes as slices of texts show.
HOT_KEYS = 50_000
HOT_NODES = 1000
#: Rounds in which a shingle pairs its nodes with one of them only, before all pairs that are left.
ROUNDS = 4
#: Edges that a task of a step of ``connected`` reads at most on average.
TASK_EDGES = 100_000
_LOW = U((1 << 48) - 1)


def _sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    h, at = shingles(Words(raw, offsets, WHITE), SHINGLE)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _digest(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)


_DIGEST = "{0}n_shingles bigint, {0}node bigint, {0}check bigint"


def _digests(raw, offsets, sets=None) -> list:
    sets = _sets(raw, offsets) if sets is None else sets
    size = np.array([len(s) for s in sets], dtype=np.int64)
    both = np.array([_digest(s) for s in sets], dtype=np.int64).reshape(-1, 2)
    return [size, pa.array(both[:, 0], mask=size == 0), pa.array(both[:, 1], mask=size == 0)]


def _repeated(sets: list[np.ndarray]) -> bytes | None:
    """The shingles that several different sets of a slice hold, and how many (8 bytes each)."""
    once = {s.tobytes(): s for s in sets}.values()
    keys, n = np.unique(np.concatenate([np.empty(0, dtype=U), *once]), return_counts=True)
    return np.concatenate([keys[n > 1], n[n > 1].astype(U)]).tobytes() if (n > 1).any() else None


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``n_shingles`` and the digest (two longs, null for an empty set) of each document's set; ``repeated``, on the last row of a slice, what ``_repeated`` gives for it."""

    def fn(raw, offsets):
        sets = _sets(raw, offsets)
        return [*_digests(raw, offsets, sets), pa.array([*[None] * (len(sets) - 1), _repeated(sets)], type=pa.binary())]

    return map_texts(docs, id_col, text_col, fn, _DIGEST.format("") + ", repeated binary")


def hot_keys(rows: DataFrame) -> np.ndarray:
    """The shingles that most nodes hold, sorted: at most HOT_KEYS, of at least HOT_NODES nodes by what slices show."""

    def run(batches):
        for b in batches:
            for x in b.column(0):
                both = np.frombuffer(x.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(both[: len(both) // 2]), pa.array(both[len(both) // 2 :])], names=["key", "n"])

    counts = rows.select("repeated").where("repeated is not null").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_NODES)
    got = counts.orderBy(F.desc("n"), "key").limit(HOT_KEYS).toArrow()
    return np.sort(got["key"].to_numpy().astype("<i8").view("<u8"))


def collisions(sets: DataFrame) -> list[int]:
    """Nodes that several digests share. Of 10**10 sets about three are expected, so the list is short; many would mean that the hash is broken."""
    got = [r.node for r in sets.groupBy("node").count().where("count > 1").select("node").limit(100_001).collect()]
    if len(got) > 100_000:
        raise ValueError("digests collide far beyond chance")
    return got


# A packed block: number of nodes, nodes (8 bytes), set sizes (4), numbers of keys (4), then the keys of all nodes
# and, in the second exchange, their frequencies.


def _pack(nodes, sizes, counts, *arrays) -> bytes:
    return b"".join([np.int64(len(nodes)).tobytes(), nodes.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), *(x.tobytes() for x in arrays)])


def _unpack(block: pa.Buffer, *kinds: str) -> tuple:
    n = int(np.frombuffer(block, "<i8", 1)[0])
    nodes, sizes, counts = np.frombuffer(block, "<i8", n, 8), np.frombuffer(block, "<u4", n, 8 + 8 * n), np.frombuffer(block, "<u4", n, 8 + 12 * n)
    at, total, out = 8 + 16 * n, int(counts.sum()), []
    for k in kinds:
        out.append(np.frombuffer(block, k, total, at))
        at += total * np.dtype(k).itemsize
    return nodes, sizes, counts, *out


def _emit(part: np.ndarray, owner: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, arrays: list[np.ndarray]):
    """(partition, block) for items that are sorted by (partition, owner)."""
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True):
        first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        who = owner[a:b][first]
        yield int(part[a]), _pack(nodes[who], sizes[who], np.diff(np.append(first, b - a)), *(x[a:b] for x in arrays))


def _send(texts: DataFrame, parts: int, hot: np.ndarray, twice: list[int]) -> DataFrame:
    """All shingles of all nodes, packed by partition of the shingle's hash; those of ``hot`` ones by shingle and node, in partitions from ``parts`` on. A task sends equal sets once. Nodes in ``twice`` go by the other half of their digest."""
    other = set(twice)

    def run(batches):
        seen: set[bytes] = set()
        sets: list[np.ndarray] = []
        nodes: list[int] = []

        def flush():
            size = np.array([len(s) for s in sets])
            h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
            part = ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                spread = mix(h[is_hot] ^ np.array(nodes, dtype=np.int64).view(U)[owner[is_hot]])
                part[is_hot] = parts + (spread % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            low = h[order] & _LOW
            blocks = list(_emit(part[order], owner[order], np.array(nodes), size, [(low >> U(32)).astype("<u2"), low.astype("<u4")]))
            for i in range(0, len(blocks), 256):
                p, b = zip(*blocks[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, type=pa.int32()), pa.array(b, type=pa.binary())], names=["part", "block"])
            sets.clear()
            nodes.clear()
            release_memory()

        held = 0
        for batch in batches:
            for _, raw, offsets in slices(batch.column(0)):
                for s in _sets(raw, offsets):
                    if len(s):
                        d = _digest(s)
                        if (key := d.tobytes()) not in seen:
                            seen.add(key)
                            sets.append(s)
                            nodes.append(int(d[0] if int(d[0]) not in other else d[1]))
                            held += len(s)
                if held >= FLUSH_SHINGLES:
                    yield from flush()
                    held = 0
        if sets:
            yield from flush()

    return texts.mapInArrow(run, "part int, block binary")


def _shared(blocks: DataFrame, parts: int) -> DataFrame:
    """The shingles of two or more nodes with their frequencies, packed by partition of the node."""

    def fn(key, table):
        got = [_unpack(b.as_buffer(), "<u2", "<u4") for b in table["block"]]
        nodes, counts = np.concatenate([g[0] for g in got]), np.concatenate([g[2] for g in got])
        unique, first, inverse = np.unique(nodes, return_index=True, return_inverse=True)
        sizes = np.concatenate([g[1] for g in got])[first]
        # several tasks may send one node: its keys count once
        once = np.zeros(len(nodes), dtype=bool)
        once[first] = True
        low = np.concatenate([(g[3].astype(U) << U(32)) | g[4] for g in got])
        del got
        if not once.all():
            low = low[np.repeat(once, counts)]
        order = np.argsort(low)
        low = low[order]
        owner = np.repeat(inverse[once].astype(np.int32), counts[once])[order]
        del order
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        each = np.diff(np.append(start, len(low)))
        many = np.repeat(np.minimum(each, 65534).astype("<u2"), each)
        part = key[0].as_py()
        if part >= parts:  # hot ones, a share of their nodes
            many[:], part = 65535, 65535
        keep = many > 1
        low, owner, many = low[keep], owner[keep], many[keep]
        bucket = (unique.astype(U) % U(parts)).astype(np.int64)
        order = np.lexsort((owner, bucket[owner]))
        owner = owner[order]
        full = (low[order] + (U(part & 65535) << U(48))).astype("<u8")
        p, b = zip(*_emit(bucket[owner], owner, unique, sizes, [full, many[order]]), strict=True) if len(owner) else ((), ())
        del low, owner, many, full, order
        release_memory()
        return pa.table({"part": pa.array(p, type=pa.int32()), "block": pa.array(b, type=pa.binary())})

    return blocks.groupBy("part").applyInArrow(fn, "part int, block binary")


def _ordered(blocks: DataFrame) -> DataFrame:
    """``node``, its set's ``size``, the number of ``posted`` shingles and its shared shingles (``keys``) in the global order, of nodes with a posted one."""

    def fn(key, table):
        got = [_unpack(b.as_buffer(), "<u8", "<u2") for b in table["block"]]
        counts = np.concatenate([g[2] for g in got])
        owner = np.repeat(np.concatenate([g[0] for g in got]), counts)
        size = np.repeat(np.concatenate([g[1] for g in got]), counts).astype(np.int64)
        keys, many = np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got])
        order = np.lexsort((keys, many, owner))
        owner, size, keys = owner[order], size[order], keys[order].astype("<u8")
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        end = np.append(start[1:], len(owner))
        n = size[start]
        posted = n + (-THRESHOLD * n // 100) + 1 - (n - (end - start))
        out = [(int(owner[a]), int(m), int(k), keys[a:b].tobytes()) for a, b, m, k in zip(start, end, n, posted, strict=True) if k > 0]
        node, m, k, data = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"node": pa.array(node, type=pa.int64()), "size": pa.array(m, type=pa.int32()), "posted": pa.array(k, type=pa.int32()), "keys": pa.array(data, type=pa.binary())})

    return blocks.groupBy("part").applyInArrow(fn, "node bigint, size int, posted int, keys binary")


def _postings(ordered: DataFrame) -> DataFrame:
    """A row for each posted shingle: ``key``, ``node``, ``size``, ``own``, how many shingles only the node has, and ``left``, how many stand from it on in the global order."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                posted = part["posted"].to_numpy()
                keys = [np.frombuffer(x.as_py(), "<i8") for x in part["keys"]]
                own = part["size"].to_numpy() - np.array([len(k) for k in keys], dtype=np.int32)
                left = np.concatenate([np.array([], dtype=np.int32), *(len(k) - np.arange(m) for k, m in zip(keys, posted, strict=True))]).astype(np.int32)
                keys = np.concatenate([np.array([], dtype=np.int64), *(k[:m] for k, m in zip(keys, posted, strict=True))])
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(c, posted)) for c in (part["node"].to_numpy(), part["size"].to_numpy(), own)), pa.array(left)], names=["key", "node", "size", "own", "left"])

    return ordered.mapInArrow(run, "key bigint, node bigint, size int, own int, left int")


def _may_link(a: str, b: str):
    """Size filter, and the bound on the overlap if this is the pair's first shared shingle."""
    need = F.ceil(THRESHOLD * (F.col(f"{a}.size").cast("bigint") + F.col(f"{b}.size")) / (100 + THRESHOLD))
    return (100 * F.least(f"{a}.size", f"{b}.size").cast("bigint") >= THRESHOLD * F.greatest(f"{a}.size", f"{b}.size").cast("bigint")) & (F.least(f"{a}.left", f"{b}.left") >= need)


def walk(a: np.ndarray, size: int, partners: list[tuple[np.ndarray, int]]) -> list[bool]:
    """Which of the partners (ordered keys, set size), sorted by their keys, link with the set of the keys ``a``.

    The partners are the paths of a trie. ``overlap[d]`` is the partial overlap of the current path at depth d."""
    mine, out = np.sort(a), []
    last = np.empty(0, dtype=a.dtype)
    overlap = np.zeros(1, dtype=np.int64)  # as far as the last path was walked
    for keys, n in partners:
        need = -(-THRESHOLD * (size + n) // (100 + THRESHOLD))
        common = min(len(last), len(keys), len(overlap) - 1)
        differ = np.flatnonzero(last[:common] != keys[:common])
        depth = int(differ[0]) if len(differ) else common
        overlap = overlap[: depth + 1]
        while depth < len(keys) and overlap[-1] + len(keys) - depth >= need:
            step = keys[depth : depth + 128]
            at = np.minimum(np.searchsorted(mine, step), len(mine) - 1)
            overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(mine[at] == step)])
            depth += len(step)
        out.append(depth == len(keys) and bool(overlap[-1] >= need))
        last = keys
    return out


def _verify(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """The labels, as links (a, b), of those of the pairs (a, b, label_a, label_b) that link."""
    left = ordered.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("keys").alias("keys_a"))
    right = ordered.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("keys").alias("keys_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "size_a", "size_b", "keys_a", "keys_b", "label_a", "label_b").sortWithinPartitions("a", "keys_b")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                a, size_a, size_b = (part.column(k).to_numpy() for k in (0, 2, 3))
                start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                linked = []
                for s, e in zip(start, np.append(start[1:], len(a)), strict=True):
                    partners = [(np.frombuffer(part.column(5)[k].as_py(), "<u8"), int(size_b[k])) for k in range(s, e)]
                    linked += walk(np.frombuffer(part.column(4)[int(s)].as_py(), "<u8"), int(size_a[s]), partners)
                yield pa.RecordBatch.from_arrays([pa.array(part.column(k).to_numpy()[linked]) for k in (6, 7)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _sizes() -> tuple:
    """The smallest and the largest size of a set that can link with a node by the posted shingle."""
    n, left = F.col("size").cast("bigint"), F.col("left").cast("bigint")
    most = F.least(F.floor(100 * n / THRESHOLD), F.floor((100 + THRESHOLD) * left / THRESHOLD) - n)
    return F.ceil(THRESHOLD * n / 100), most


def _step(size):
    """A class of sizes, each a tenth wider than the one before."""
    return F.floor(F.log(size) / np.log(1.1)).cast("int")


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, of all nodes with links (a, b)."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n, before = edges.count(), None
    while n:
        edges = edges.coalesce(1 + n // TASK_EDGES)
        held = saved if n > TASK_EDGES else (lambda df: df)  # then both sides of a join are shuffled, and a hot node can be split
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = held(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = held(large)
        least = held(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        edges = saved(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        n, before = now[0], now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _mixed(postings: DataFrame) -> DataFrame:
    """The postings of shingles whose nodes are in several components. The shingles are saved first, as hubs are below: a join with two shuffled sides is split where a key is hot."""
    several = postings.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return postings.join(saved(several), "key")


def _contracted(found: DataFrame) -> DataFrame:
    """``label`` and ``to``, the smallest label within two links. That contracts a hub and all that link with it; longer paths are left to later rounds and to ``connected``."""
    both = found.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct()
    near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    far = both.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("to"))
    return far.select(F.col("u").alias("label"), "to")


def links(docs: DataFrame, text_col: str, total: int, hot: np.ndarray, twice: list[int]) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes that links connect."""
    parts = max(1, -(-total // PARTITION_SHINGLES))
    sent = _send(docs.select(F.col(text_col).cast("string")), parts, hot, twice)
    ordered = saved(_ordered(_shared(sent, parts)))
    current = saved(_mixed(_postings(ordered).withColumn("label", F.col("node"))))
    edges, k = [], 0
    while not current.isEmpty():
        if k < ROUNDS:
            # the node with the fewest shingles of its own is nearest to the middle of its group; then nodes by chance
            rank = F.col("own").cast("bigint") if k == 0 else F.xxhash64("node", F.lit(k))
            hubs = saved(current.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "size", "left", "label")).alias("hub")).select("key", "hub.*"))
            pairs = current.alias("p").join(hubs.alias("q"), "key").where("p.label <> q.label")
        else:
            main = saved(current.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("rank"), "label")).alias("hub")).select("key", F.col("hub.label").alias("main")))
            named = saved(current.join(main, "key").withColumn("step", _step(F.col("size"))))
            low, high = _sizes()
            p = named.where("label <> main").withColumns({"low": low, "high": high}).where("low <= high")
            p = p.withColumn("step", F.explode(F.sequence(_step(F.col("low")), _step(F.col("high"))))).alias("p")
            pairs = p.join(named.alias("q"), ["key", "step"]).where("p.label <> q.label and (q.label = q.main or p.node < q.node) and q.size between p.low and p.high")
        pairs = pairs.where(_may_link("p", "q")).select(F.struct("q.node", "q.label").alias("x"), F.struct("p.node", "p.label").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("label_a"), F.col("y.label").alias("label_b"))
        found = saved(_verify(pairs, ordered))
        edges.append(found)
        if k == ROUNDS:
            break
        if found.isEmpty():
            k = ROUNDS  # nothing left to contract
            continue
        k += 1
        named = current.join(saved(_contracted(found)), "label", "left")
        current = saved(_mixed(named.withColumn("label", F.coalesce("to", "label")).drop("to")))
    return reduce(DataFrame.unionAll, edges) if edges else docs.sparkSession.createDataFrame([], "a bigint, b bigint")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id``, ``n_shingles``, the digest and ``component_id``, the smallest id of its component, of each document."""
    rows = saved(digests(docs, id_col, text_col).withColumnRenamed(id_col, "__id"))
    total, hot = rows.agg(F.sum("n_shingles")).first()[0] or 0, hot_keys(rows)
    rows = rows.drop("repeated")
    sets = rows.where("node is not null").groupBy("node", "check").agg(F.min("__id").alias("least"))
    if total:
        sets = saved(sets)
        twice = collisions(sets)
        name = F.when(F.col("node").isin(twice), F.col("check")).otherwise(F.col("node")) if twice else F.col("node")
        labels = connected(links(docs, text_col, total, hot, twice)).withColumnRenamed("node", "name")
        labelled = sets.withColumn("name", name).join(labels, "name")
        smallest = saved(labelled.groupBy("label").agg(F.min("least").alias("smallest")))
        named = labelled.join(smallest, "label").select("node", "check", "smallest")
        sets = saved(sets.join(named, ["node", "check"], "left").select("node", "check", F.coalesce("smallest", "least").alias("least")))
    out = rows.join(sets, ["node", "check"], "left")
    return out.select("__id", "n_shingles", "node", "check", F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("least")).alias("component_id"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_shingles`` and ``component_id``, the smallest id of its component, of each document."""
    return _named(docs, id_col, text_col).select(F.col("__id").alias(id_col), "n_shingles", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns. Rows without an id or without a word stay; of repeated ids each row stays or goes by its own component."""
    found = _named(docs, id_col, text_col)
    gone = found.where(F.col("component_id") != F.col("__id")).select(F.col("__id").alias("__gone"), F.col("node").alias("__n"), F.col("check").alias("__c"))
    rows = add_columns(docs, text_col, _digests, _DIGEST.format("__"))
    return rows.join(gone, (rows[id_col] == F.col("__gone")) & (F.col("__node") == F.col("__n")) & (F.col("__check") == F.col("__c")), "left_anti").select(*docs.columns)
