"""Quality rules: a learned decision list over text statistics (operator 10).

Sequential covering learns rules for low quality: each rule is a conjunction of threshold
conditions, grown greedily by information gain on one part of the labelled sample and pruned on
the other, then the rows that it covers go and the next rule is grown. The result is an ordered
list, emitted as a chain of Spark ``when`` expressions.

Defined results: a null or empty text has zeros for all statistics and fails the base rule; rows
with a null or repeated id are judged each on its own; an empty table gives an empty result; with
no labelled row (or labels of one kind) the list is empty and the base rule alone decides. Extra
columns are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import TRAINING_ROWS, labelled_sample, map_texts
from millrace.llm.textstats import FEATURES, FIELDS, ratios, text_stats

STATS_SCHEMA = ", ".join([*(f"{x} bigint" for x in FIELDS), *(f"f_{x} double" for x in FEATURES)])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each whole text and the ratios (``f_…``) that rules test."""

    def fn(raw, offsets):
        s = text_stats(raw, offsets)
        return [*s.values(), *ratios(s).T.copy()]

    return map_texts(docs, id_col, text_col, fn, STATS_SCHEMA)


@dataclass
class Rule:
    """All of ``conditions`` (feature, above, threshold) hold: the text is of low quality."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, above, t in self.conditions:
            v = x[:, FEATURES.index(name)]
            out &= v > t if above else v <= t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.conditions:
            out = out & (F.col(f"f_{name}") > t if above else F.col(f"f_{name}") <= t)
        return out


def _best_condition(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[str, bool, float] | None]:
    """The condition with the largest gain (as in FOIL) over all thresholds."""
    p0, n0 = y.sum(), len(y) - y.sum()
    base = np.log2(max(p0, 1e-9) / max(p0 + n0, 1))
    best, found = 1e-9, None
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, pos = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        below_p, below_n = pos[cut], cut + 1 - pos[cut]
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - base), -1)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best, found


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> Rule:
    rule = Rule()
    while len(rule.conditions) < most:
        hit = rule.covers(x)
        if y[hit].all():
            break
        _, c = _best_condition(x[hit], y[hit])
        if c is None:
            break
        rule.conditions.append(c)
    return rule


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    hit = rule.covers(x)
    p, n = int(y[hit].sum()), int((1 - y[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drops trailing conditions as long as the rule doesn't get worse on the pruning rows."""
    options = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    return max(options, key=lambda r: (_worth(r, x, y), -len(r.conditions)))


def learn(x: np.ndarray, bad: np.ndarray, least_precision: float = 0.9, max_rules: int = 12, max_conditions: int = 4, least_cover: int = 4) -> list[Rule]:
    """The ordered rules. Every third row prunes; a rule stays if at least ``least_precision`` of the rows that it covers (all rows left, smoothed by half a row) are bad."""
    rules: list[Rule] = []
    left = np.arange(len(x))
    while len(rules) < max_rules and bad[left].sum() >= least_cover:
        prune = left % 3 == 0
        grow_rows, prune_rows = left[~prune], left[prune]
        rule = _grow(x[grow_rows], bad[grow_rows], max_conditions)
        if not rule.conditions:
            break
        if bad[prune_rows].sum():
            rule = _prune(rule, x[prune_rows], bad[prune_rows])
        hit = rule.covers(x[left])
        p, n = bad[left][hit].sum(), (1 - bad[left][hit]).sum()
        if p < least_cover or p / (p + n + 0.5) < least_precision:
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: false for the first rule that holds, else true."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> list[Rule]:
    """Learns rules from ``rows`` labelled documents at most (0: low quality)."""
    sample = labelled_sample(docs.select(id_col, text_col), labels, id_col, label_col, rows=rows)
    sample = sample.select(F.xxhash64(id_col).alias("id"), F.col("__label").alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))

    def fn(batches):
        import pyarrow as pa

        from millrace.llm.wordhash import slices

        for b in batches:
            for i, raw, offsets in slices(b.column(2)):
                m = ratios(text_stats(raw, offsets))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(m)), b.column(1).slice(i, len(m)), b.column(3).slice(i, len(m)), *(pa.array(c.copy()) for c in m.T)], names=["id", "label", "hash", *FEATURES])

    got = sample.mapInArrow(fn, "id bigint, label int, hash bigint, " + ", ".join(f"{x} double" for x in FEATURES)).toArrow().sort_by([(c, "ascending") for c in ("id", "label", "hash")])
    x = np.column_stack([got[c].to_numpy() for c in FEATURES]) if got.num_rows else np.zeros((0, len(FEATURES)))
    return learn(x, (got["label"].to_numpy() == 0).astype(int))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All statistics of each document, ``base_failed`` and ``kept``."""
    s = statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
