"""The pipeline's stages against brute force, one after the other."""

from collections import Counter

import corpus_pipeline
from millrace.llm import packing
from tests.conftest import SMALL
from tests.llm import helpers as H
from tests.llm.test_operators import check_packing, contained, plain_keep, reference_encoder


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]

    def step(name, df):
        out = stages[name](spark, df, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def pairs(df):
        return [(r.doc_id, r.text) for r in df.collect()]

    judged = step("quality classifier", docs)
    assert judged.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {k for k, _ in pairs(judged)}
    assert sum((k in kept) != bool(q) for k, q in labels.items()) <= 0.05 * len(labels)

    lines = step("line dedup", judged)
    assert lines.columns == docs.columns and Counter(pairs(lines)) == plain_keep(pairs(judged))

    unique = step("n-gram Jaccard join", lines)
    best = {k for k, n, c in H.components(pairs(lines)) if k == c or not n}
    assert unique.columns == docs.columns and Counter(pairs(unique)) == Counter(x for x in pairs(lines) if x[0] in best)

    clean = step("benchmark decontamination", unique)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = {k for k, *_ in contained(pairs(unique), items)}
    assert Counter(pairs(clean)) == Counter(x for x in pairs(unique) if x[0] not in dirty)

    check_packing(step("packing", clean).collect(), pairs(clean), reference_encoder())


def test_run_equals_its_stages_on_small_tables(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.LENGTH}").count() == 0


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_takes_hard_rows_and_empty_labels_or_benchmark(spark, tmp_path):
    prose = " ".join(f"{a}{b}" for a in ("riv", "sto", "lig", "pap", "eng", "fie") for b in ("er", "ne", "ht", "ant", "ine", "ld", "et"))
    every = H.HARD + [(20 + i, f"{prose} of number {i} and so on") for i in range(3)] + [(20, prose), (None, prose)]
    docs = H.frame(spark, every)
    cases = [(H.labels(spark, every), [(1, " ".join(prose.split()[:20]))]), (H.labels(spark, every), []), (H.labels(spark, []), [(1, "one two three four five six seven"), (None, None)])]
    for k, (labels, items) in enumerate(cases):
        out = corpus_pipeline.run(spark, tables(spark, tmp_path / str(k), docs, labels, items)).collect()
        at = {}
        for p in sorted(out, key=lambda p: (p.sequence_id, p.offset)):
            assert p.offset == at.get(p.sequence_id, 0)
            at[p.sequence_id] = p.offset + p.length
        ids = {p.doc_id for p in out}
        assert {2, 3, None} <= ids  # null and empty texts and rows without an id go through
        assert (1 in ids) == (k < 2) and (22 in ids) is False  # near copies leave the smallest id


def test_near_copies_leave_one_member(spark, tmp_path):
    """Near copies in the raw documents are gone after the Jaccard join, line dedup or not."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(41))
    words = [f"{a}{b}" for a in ("riv", "sto", "lig", "pap", "eng", "fie", "qui", "sig") for b in ("er", "ne", "ht", "ant", "ine", "ld", "et", "nal")]
    rows = []
    for g in range(30):
        lines = [list(rng.choice(words, 30)) for _ in range(8)]
        rows.append((g * 10, "\n".join(map(" ".join, lines))))
        for c in range(1, 4):
            copy = [list(x) for x in lines]
            for _ in range(4):
                copy[rng.integers(8)][rng.integers(30)] = f"x{rng.integers(10**6)}"
            rows.append((g * 10 + c, "\n".join(map(" ".join, copy))))
    linked = {k for k, _, c in H.components(rows) if k != c}
    docs = H.frame(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    left = stages["n-gram Jaccard join"](spark, stages["line dedup"](spark, docs, SMALL), SMALL).collect()
    kept = {r.doc_id: r.text for r in left}
    assert len(linked) == 90 and len(linked & set(kept)) <= 0.05 * len(linked)
    assert all(kept[g * 10] == dict(rows)[g * 10] for g in range(30))
