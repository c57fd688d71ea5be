"""Quality classifier: document evidence with hierarchical empirical Bayes (operator 5).

1. A logistic regression over quantile bins of text statistics gives each document's log odds of
   being good. It is fitted on a bounded sample of labelled rows (``rows``).
2. Grouped aggregation of all labels counts good and labelled documents by host and by path. The
   posterior mean of a path is shrunk towards its host's, a host's towards the global rate; how strongly is
   estimated from the spread of the rates between groups beyond what chance explains (method of moments).
   Ids are dealt to FOLDS folds by hash, and a document's posteriors leave out the labels of its own fold, so its own label never
   counts for it, without a join of documents and labels. A group without labels in that fold leaves nothing out. The
   global rate and the strengths are over all labels.
3. Log odds of the document plus those of its path's posterior over the global prior give the
   final posterior; a document is kept from 0.5 on.

Defined results: null or empty texts have zero statistics and are classified by them; a null host
or path is a group of its own; a path without labels has its host's posterior, a host without labels the
global rate; without labels all posteriors are 0.5 and all is kept; null or repeated ids are
judged row by row (a repeated id's label counts once for each row, and for none of these rows); an empty table gives an empty
result. ``judge`` ignores extra columns, ``keep`` returns all columns. Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import TRAINING_ROWS, add_columns, labelled_sample, saved
from millrace.llm.textstats import FEATURES, ratios, text_stats
from millrace.llm.wordhash import slices

BINS = 10
#: Site tables of at most so many rows are broadcast; larger ones are joined by shuffle.
SITE_ROWS = 50_000
#: A site's posteriors leave out one of so many folds of its labels at a time.
FOLDS = 10
CLIP = 6.0


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray  # bias last

    def design(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.weights)))
        out[:, -1] = 1
        at = 0
        for j, e in enumerate(self.edges):
            out[np.arange(len(x)), at + np.searchsorted(e, x[:, j], side="left")] = 1
            at += len(e) + 1
        return out

    def evidence(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of being good, of each text."""
        return np.clip(self.design(ratios(text_stats(raw, offsets))) @ self.weights, -CLIP, CLIP)


def train(x: np.ndarray, good: np.ndarray, l2: float = 0.5, steps: int = 12) -> Model:
    """Newton's method on one-hot quantile bins."""
    edges = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0)
        top = np.unique(np.quantile(x[:, j], [0.96, 0.98, 0.99])) if len(x) else np.empty(0)
        edges.append(np.unique(np.concatenate([q, top])))
    m = Model(edges, np.zeros(sum(len(e) + 1 for e in edges) + 1))
    if 0 < good.sum() < len(good):
        d = m.design(x)
        penalty = np.full(d.shape[1], l2)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(d @ m.weights, -30, 30)))
            h = (d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty)
            m.weights = m.weights + np.linalg.solve(h, d.T @ (good - p) - penalty * m.weights)
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    sample = labelled_sample(docs.select(id_col, text_col), labels, id_col, label_col, rows=rows)
    sample = sample.select(F.xxhash64(id_col).alias("id"), F.col("__label").alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))

    def fn(batches):
        for b in batches:
            for i, raw, offsets in slices(b.column(2)):
                m = ratios(text_stats(raw, offsets))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(m)), b.column(1).slice(i, len(m)), b.column(3).slice(i, len(m)), *(pa.array(c.copy()) for c in m.T)], names=["id", "label", "hash", *FEATURES])

    got = sample.mapInArrow(fn, "id bigint, label int, hash bigint, " + ", ".join(f"{x} double" for x in FEATURES)).toArrow().sort_by([(c, "ascending") for c in ("id", "label", "hash")])
    return train(np.column_stack([got[c].to_numpy() for c in FEATURES]), got["label"].to_numpy())


def _logit(c: Column) -> Column:
    c = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), c))
    return F.log(c / (1 - c))


def _strength(groups: DataFrame, mean: Column) -> Column:
    """One aggregate: how many labels the prior is worth, from the spread between groups. Without a spread, as with a single group, the prior is worth 1e6 labels."""
    n, rate = F.col("__n"), F.col("__good") / F.col("__n")
    total = F.sum(n)
    between = F.sum(n * (rate - mean) * (rate - mean)) - (F.count("*") - 1) * F.avg(mean * (1 - mean))
    spread = F.try_divide(between, total - F.try_divide(F.sum(n * n), total))  # null with a single group
    return F.coalesce(F.when(spread > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.avg(mean * (1 - mean)) / spread - 1))), F.lit(1e6))


def _fold(id_col: str | Column) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int")


def sites(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``__host``, ``__path`` and the posterior means ``__host_post`` and ``__path_post`` of all labelled paths over all folds; ``__folds`` maps
    a fold in which the path has labels to both posteriors (``h``, ``p``) without it; ``__mean`` is the global rate.

    A row with a null path stands for the whole host. A map has FOLDS entries at most."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    keyed = docs.select(F.col(id_col), F.coalesce(host.cast("string"), F.lit("")).alias("__host"), F.coalesce(path.cast("string"), F.lit("")).alias("__path"))
    parts = saved(keyed.join(usable, id_col).groupBy("__host", "__path", _fold(id_col).alias("__fold")).agg(F.sum("__label").cast("double").alias("__good"), F.count("*").cast("double").alias("__n")))

    def over_folds(d: DataFrame, *keys: str) -> DataFrame:
        folds = F.map_from_entries(F.collect_list(F.struct("__fold", F.struct(F.col("__good").alias("good"), F.col("__n").alias("n")))))
        return d.groupBy(*keys).agg(F.sum("__good").alias("__good"), F.sum("__n").alias("__n"), folds.alias("__folds"))

    paths = over_folds(parts, "__host", "__path")
    hosts = over_folds(parts.groupBy("__host", "__fold").agg(F.sum("__good").alias("__good"), F.sum("__n").alias("__n")), "__host")
    overall = hosts.agg(F.sum("__good"), F.sum("__n")).first()
    mean = (overall[0] + 1) / (overall[1] + 2) if overall[1] else 0.5
    s_host = hosts.agg(_strength(hosts, F.lit(mean))).first()[0]
    post = lambda good, n, s, prior: (good + s * prior) / (n + s)
    hosts = hosts.select(
        "__host",
        post(F.col("__good"), F.col("__n"), s_host, F.lit(mean)).alias("__host_post"),
        F.transform_values("__folds", lambda _, x: post(F.col("__good") - x["good"], F.col("__n") - x["n"], s_host, F.lit(mean))).alias("__host_folds"),
    )
    joined = paths.join(hosts, "__host")
    s_path = joined.agg(_strength(joined, F.col("__host_post"))).first()[0]

    def left_out(k: Column, x: Column) -> Column:
        h = F.try_element_at("__host_folds", k)
        return F.struct(h.alias("h"), post(F.col("__good") - x["good"], F.col("__n") - x["n"], s_path, h).alias("p"))

    out = joined.select("__host", "__path", "__host_post", post(F.col("__good"), F.col("__n"), s_path, F.col("__host_post")).alias("__path_post"), F.transform_values("__folds", left_out).alias("__folds"))
    whole = hosts.select("__host", F.lit(None).cast("string").alias("__path"), "__host_post", F.col("__host_post").alias("__path_post"), F.transform_values("__host_folds", lambda _, x: F.struct(x.alias("h"), x.alias("p"))).alias("__folds"))
    return out.unionByName(whole).withColumn("__mean", F.lit(float(mean)))


def _combine(scored: DataFrame, table: DataFrame, host: Column, path: Column, fold: Column) -> DataFrame:
    """Adds ``__host_post``, ``__path_post`` and ``__posterior`` to rows that have ``__evidence``; labels of the row's fold are left out."""
    table = saved(table)
    small = table.limit(SITE_ROWS + 1).count() <= SITE_ROWS
    size = F.broadcast if small else (lambda d: d)
    first = table.select("__mean").first()
    mean = first[0] if first else 0.5
    exact = table.where("__path is not null").select(F.col("__host").alias("__h"), F.col("__path").alias("__p"), F.col("__path_post").alias("__pp"), F.col("__folds").alias("__pf"))
    whole = table.where("__path is null").select(F.col("__host").alias("__h2"), F.col("__host_post").alias("__hp"), F.col("__folds").alias("__hf"))
    h, p = F.coalesce(host.cast("string"), F.lit("")), F.coalesce(path.cast("string"), F.lit(""))
    out = scored.withColumns({"__hk": h, "__pk": p, "__fold": fold}).join(size(exact), (F.col("__hk") == F.col("__h")) & (F.col("__pk") == F.col("__p")), "left").join(size(whole), F.col("__hk") == F.col("__h2"), "left")
    host_post = F.coalesce(F.try_element_at("__hf", F.col("__fold"))["h"], F.col("__hp"), F.lit(mean))
    path_post = F.coalesce(F.try_element_at("__pf", F.col("__fold"))["p"], F.col("__pp"), host_post)
    # labels already moved the classifier's bias to the global rate, so the path counts by how it differs from it
    odds = F.col("__evidence") + _logit(path_post) - _logit(F.lit(mean))
    return out.withColumns({"__host_post": host_post, "__path_post": path_post, "__posterior": 1 / (1 + F.exp(-odds))}).drop("__hk", "__pk", "__fold", "__h", "__p", "__pp", "__pf", "__h2", "__hp", "__hf")


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: Model | None = None) -> DataFrame:
    """``doc_score``, ``host_posterior``, ``path_posterior``, ``posterior`` and ``kept`` of each document."""
    model = model or fit(docs, labels, id_col, text_col, label_col)
    table = sites(docs, labels, host, path, id_col, label_col)
    keyed = docs.select(F.col(id_col).alias("__id"), host.cast("string").alias("__hc"), path.cast("string").alias("__pc"), F.col(text_col).cast("string").alias("__text"))
    scored = add_columns(keyed, "__text", lambda raw, offsets: [model.evidence(raw, offsets)], "__evidence double").drop("__text")
    out = _combine(scored, table, F.col("__hc"), F.col("__pc"), _fold("__id"))
    return out.select(F.col("__id").alias(id_col), F.col("__hc").alias("host"), F.col("__pc").alias("path"), (1 / (1 + F.exp(-F.col("__evidence")))).alias("doc_score"), F.col("__host_post").alias("host_posterior"), F.col("__path_post").alias("path_posterior"), F.col("__posterior").alias("posterior"), (F.col("__posterior") >= 0.5).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: Model | None = None) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. Texts aren't shuffled while the site table is small."""
    model = model or fit(docs, labels, id_col, text_col, label_col)
    table = sites(docs, labels, host, path, id_col, label_col)
    scored = add_columns(docs, text_col, lambda raw, offsets: [model.evidence(raw, offsets)], "__evidence double")
    return _combine(scored, table, host, path, _fold(id_col)).where("__posterior >= 0.5").select(*docs.columns)
