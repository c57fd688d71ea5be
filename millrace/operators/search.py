"""Ranked search and rule matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import tokens

K1, B = 1.5, 0.75


def search_text(df: DataFrame, columns: list[str]) -> Column:
    """The search columns that exist, joined by spaces; nulls are empty."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns))


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query: str = "query", k: int = 3) -> DataFrame:
    """The k best documents of each query with a score above 0. A query's repeated words add again; ties go to the smaller key.

    Only postings of query words leave the scan: their number is bounded by the queries, not by the vocabulary. Queries come
    as a small table; it is broadcast by the optimiser if its size allows."""
    toks = tokens(F.col(text))
    base = docs.select(key, toks.alias("__t")).withColumn("__len", F.size("__t"))
    stats = base.agg(F.count("*").alias("n"), F.avg("__len").alias("avg")).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    words = queries.select(F.col(query), F.explode(tokens(F.col(query))).alias("word")).groupBy(query, "word").agg(F.count("*").alias("times"))
    post = base.select(key, "__len", F.explode("__t").alias("word")).join(words.select("word").distinct(), "word", "left_semi").groupBy(key, "__len", "word").agg(F.count("*").alias("tf"))
    df = post.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("__len") / avg))
    scores = post.join(df, "word").join(words, "word").groupBy(query, key).agg(F.round(F.sum(part), 6).alias("score"))
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), key))).where((F.col("rank") <= k) & (F.col("score") > 0))


def multi_domain(domains: dict[str, DataFrame], queries: DataFrame, key: str, text: str, query: str = "query", k: int = 3) -> DataFrame:
    """The k best of each query in each domain's own corpus, with the domain's name. A query may name its domains in ``domains`` (null: all)."""
    parts = []
    for name, docs in domains.items():
        wanted = queries.where(F.col("domains").isNull() | F.array_contains("domains", F.lit(name))) if "domains" in queries.columns else queries
        parts.append(bm25(docs, wanted.select(query), key, text, query, k).withColumn("domain", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def keyword_votes(text: Column, keywords: dict[str, list[str]]) -> Column:
    """(name, number of the keywords that the lower-cased text contains), in the order of the names."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda ws: sum((F.contains(low, F.lit(w.lower())).cast("int") for w in ws), F.lit(0))
    return F.array(*(F.struct(count(ws).alias("votes"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(keywords.items())))


def most_votes(text: Column, keywords: dict[str, list[str]], default: str) -> Column:
    """The name with the most votes, the first of several; the default without a vote."""
    best = F.array_max(keyword_votes(text, keywords))
    return F.when(best["votes"] > 0, best["name"]).otherwise(default)


def first_keyword(text: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """The result of the first rule of which the lower-cased text contains a keyword."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for words, result in rules:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(default)


def page_type(context: Column, best_for: Column, rules: list[tuple[list[str], str]], fallback: list[tuple[list[str], str]], default: str = "General") -> Column:
    """The type that the context's first fitting rule gives, else what the best style result is good for, else the default."""
    direct = first_keyword(context, rules, "")
    return F.when(direct != "", direct).otherwise(first_keyword(best_for, fallback, default))


def overrides(results: DataFrame, page: str, layouts: list[tuple[list[str], str, str, str | None]], default: tuple[str, str, str | None], generic: list[str]) -> DataFrame:
    """What a page overrides, from the ranked results of its searches: (``page``, ``domain``, ``rank``, ``fields`` as a map of strings).

    The style result of rank 1 gives maximal width, layout and density by the first rule of ``layouts`` (words, width, layout, density) of which its keywords have a word,
    else ``default``; without a style result only ``generic`` is left. Recommendations come from effects, the do's of guidelines and the placement of the call to action, in the order of domain and rank;
    the don'ts become ``avoid``. Pages are grouped by key; each has a handful of results, by the k of its searches."""
    get = lambda f: F.nullif(F.try_element_at("fields", F.lit(f)), F.lit(""))
    say = lambda head, c: F.concat(head, F.lit(": "), c)
    style, ux, landing = F.col("domain") == "style", F.col("domain") == "ux", F.col("domain") == "landing"
    words = F.lower(F.coalesce(get("keywords"), F.lit("")))
    laid = None
    for keys, *values in layouts:
        hit = F.exists(F.array(*map(F.lit, keys)), lambda w: F.contains(words, w))
        value = F.struct(*(F.lit(v).cast("string").alias(n) for v, n in zip(values, ("width", "layout", "density"), strict=True)))
        laid = F.when(hit, value) if laid is None else laid.when(hit, value)
    plain = F.struct(*(F.lit(v).cast("string").alias(n) for v, n in zip(default, ("width", "layout", "density"), strict=True)))
    laid = plain if laid is None else laid.otherwise(plain)
    order = F.when(style, 0).when(ux, 1).otherwise(2)
    said = F.array_compact(F.array(F.when(style, say(F.lit("Effects"), get("effects"))), F.when(ux, say(get("category"), get("do"))), F.when(landing, say(F.lit("CTA Placement"), get("cta")))))
    avoid = F.when(ux, say(F.lit("Avoid"), get("dont")))
    gathered = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.size(c) > 0, F.struct(order.alias("o"), F.col("rank"), c.alias("x"))))), lambda v: v["x"])
    g = results.groupBy(page).agg(
        F.max(F.when(style & (F.col("rank") == 1), laid)).alias("l"),
        F.max(F.when(landing & (F.col("rank") == 1), get("sections"))).alias("sections"),
        F.max(F.when(landing & (F.col("rank") == 1), get("colors"))).alias("colors"),
        F.flatten(gathered(said)).alias("recommendations"),
        F.flatten(gathered(F.array_compact(F.array(avoid)))).alias("avoid"),
    )
    told = F.when(F.size("recommendations") > 0, F.col("recommendations")).otherwise(F.array(*map(F.lit, generic)))
    bare = F.col("l").isNull() & F.col("sections").isNull()
    return g.select(page, F.when(bare, "1200px").otherwise(F.col("l.width")).alias("width"), F.when(bare, "Responsive grid").otherwise(F.col("l.layout")).alias("layout"), F.col("l.density").alias("density"), "sections", "colors", told.alias("recommendations"), "avoid")


def style_votes(text: Column, explicit: dict[str, list[str]], scenes: dict[str, list[str]], default: str) -> Column:
    """An explicit style word wins over the votes of scene words, these over the default."""
    first, second = F.array_max(keyword_votes(text, explicit)), F.array_max(keyword_votes(text, scenes))
    return F.when(first["votes"] > 0, first["name"]).when(second["votes"] > 0, second["name"]).otherwise(default)


def intent(text: Column, keywords: dict[str, list[str]], neutral: str = "neutral") -> Column:
    """Most votes; at a tie the neutral intent gives way to any other."""
    votes = keyword_votes(text, {k: v for k, v in keywords.items() if k != neutral})
    best, none = F.array_max(votes), keyword_votes(text, {neutral: keywords[neutral]})[0]
    return F.when((best["votes"] > 0) & (best["votes"] >= none["votes"]), best["name"]).otherwise(neutral)


def rule_cascade(keys: DataFrame, key: str, rules: DataFrame, name: str, order: str) -> DataFrame:
    """The rule of each distinct key: equal name, else a name that contains the key or lies in it, else one of whose words the key contains.

    Rules are one row of an array for all keys (a rule base is a small dimension; it is aggregated and read as a scalar
    subquery), so that the match is a fold in the row instead of a product of both tables."""
    table = rules.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.lower(name).alias("n"), F.col(name).alias("rule")))).alias("r")).scalar()
    d = keys.select(key).distinct().withColumn("__r", table).withColumn("__k", F.lower(key))

    def step(x: Column) -> Column:
        words = F.filter(F.split(F.translate(x["n"], "/-", "  "), r"\s+"), lambda w: w != "")
        p = F.when(x["n"] == F.col("__k"), 1).when(F.contains(F.col("__k"), x["n"]) | F.contains(x["n"], F.col("__k")), 2).when(F.exists(words, lambda w: F.contains(F.col("__k"), w)), 3)
        return F.struct(p.alias("priority"), x["o"].alias("o"), x["rule"].alias("rule"))

    best = F.array_min(F.filter(F.transform("__r", step), lambda x: x["priority"].isNotNull()))
    return d.select(key, best["rule"].alias("rule"), F.coalesce(best["priority"], F.lit(4)).alias("priority"))


def best_match(candidates: DataFrame, group: str, rank: str, name: str, words: str, other: str, priorities: list[str]) -> DataFrame:
    """For each group's ranked candidates: the first priority whose name contains it or lies in it; else the best weighted
    score (name 10, keywords 3, any other field 1); else the first candidate."""
    n, kw, rest = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, words, other))
    ps = [p.lower().strip() for p in priorities]
    ordinal = F.coalesce(*(F.when(F.contains(n, F.lit(p)) | F.contains(F.lit(p), n), i) for i, p in enumerate(ps)), F.lit(None).cast("int"))
    score = sum((F.when(F.contains(n, F.lit(p)), 10).when(F.contains(kw, F.lit(p)), 3).when(F.contains(rest, F.lit(p)), 1).otherwise(0) for p in ps), F.lit(0))
    step = F.when(ordinal.isNotNull(), 1).when(score > 0, 2).otherwise(3)
    inner = F.when(step == 1, ordinal).when(step == 2, -score).otherwise(0)
    best = F.min(F.struct(step.alias("step"), inner.alias("inner"), F.col(rank).alias("rank"), F.col(name).alias("match")))
    return candidates.groupBy(group).agg(best.alias("b")).select(group, "b.match", "b.step")


def fuzzy_pairs(left: DataFrame, right: DataFrame, a: str, b: str, share: float = 0.6) -> DataFrame:
    """Pairs of titles of which one contains the other or whose character sets have a Jaccard similarity above ``share``.

    Sets are put in the order of the characters' rarity over all titles. Similar sets share a character among the first
    n - ceil(share n) + 1 of both in that order, so pairs come from an equi-join on these, within the bounds on their sizes. A title in another
    one shares all its characters; it joins on its rarest one. The table of characters has a row for each code point at most, so it is broadcast."""
    def prepared(d: DataFrame, c: str, s: str) -> DataFrame:
        t = F.lower(F.trim(F.col(c)))
        d = d.select(F.col(c).alias(s), t.alias(f"{s}_t")).where(F.col(f"{s}_t") != "").distinct()
        return d.withColumn("c", F.explode(F.array_distinct(F.filter(F.split(f"{s}_t", ""), lambda x: x != ""))))

    x, y = prepared(left, a, "a"), prepared(right, b, "b")
    often = F.broadcast(x.select("c").unionAll(y.select("c")).groupBy("c").agg(F.count("*").alias("n")))

    def ordered(d: DataFrame, s: str) -> DataFrame:
        d = d.join(often, "c").groupBy(s, f"{s}_t").agg(F.sort_array(F.collect_list(F.struct("n", "c"))).alias("r"))
        return d.select(s, f"{s}_t", F.transform("r", lambda v: v["c"]).alias(f"{s}_set"))

    x, y = ordered(x, "a"), ordered(y, "b")
    prefix = lambda s: F.slice(s, F.lit(1), (F.size(s) - F.ceil(F.size(s) * share).cast("int") + 1))
    near = (F.size("a_set") > share * F.size("b_set")) & (F.size("b_set") > share * F.size("a_set"))
    sets = x.withColumn("c", F.explode(prefix("a_set"))).join(y.withColumn("c", F.explode(prefix("b_set"))), "c").where(near).drop("c")
    inside = x.withColumn("c", F.explode("a_set")).join(y.withColumn("c", F.get("b_set", F.lit(0))), "c").drop("c").unionByName(x.withColumn("c", F.get("a_set", F.lit(0))).join(y.withColumn("c", F.explode("b_set")), "c").drop("c"))
    contains = F.contains("a_t", F.col("b_t")) | F.contains("b_t", F.col("a_t"))
    sim = F.size(F.array_intersect("a_set", "b_set")) / F.size(F.array_union("a_set", "b_set"))
    return sets.unionByName(inside.where(contains)).withColumn("sim", F.round(sim, 4)).where(contains | (sim > share)).select("a", "b", "sim").distinct()


def overlaps(rects: DataFrame, group: str, key: str, cell: float, least: float = 0.05) -> DataFrame:
    """Pairs of rectangles of a group that overlap by more than ``least`` in both directions, with the area.

    Rectangles are dealt to the grid cells that they touch; a pair is taken in the one cell that holds the overlap's top left corner."""
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    end = lambda c, d: F.floor((F.col(c) + F.col(d)) / cell).cast("int")
    r = rects.select(group, key, "left", "top", "width", "height")
    r = r.withColumn("cx", F.explode(F.sequence(at("left"), end("left", "width")))).withColumn("cy", F.explode(F.sequence(at("top"), end("top", "height"))))
    a, b = (r.select(group, "cx", "cy", *(F.col(c).alias(f"{c}_{s}") for c in (key, "left", "top", "width", "height"))) for s in "ab")
    p = a.join(b, [group, "cx", "cy"]).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    x, y = F.greatest("left_a", "left_b"), F.greatest("top_a", "top_b")
    w = F.least(F.col("left_a") + F.col("width_a"), F.col("left_b") + F.col("width_b")) - x
    h = F.least(F.col("top_a") + F.col("height_a"), F.col("top_b") + F.col("height_b")) - y
    p = p.where((w > least) & (h > least) & (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy")))
    return p.select(group, F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"), F.round(w * h, 2).alias("area"))
