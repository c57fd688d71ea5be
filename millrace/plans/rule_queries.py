"""Queries over search, rules, pivots, evaluation, scores and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.functions.vocabularies import DOMAINS, INTENTS, PAGE_TYPES
from millrace.operators import aggregates as A
from millrace.operators import audit as U
from millrace.operators import scoring as C
from millrace.operators import search as S
from millrace.plans.registry import Registry
from millrace.sources.tables import table

R = Registry()
query = R.query

_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)"
_QUERIES = ["the with that and", "licensed under the apache license", "token secret key"]
_QUERY_ROWS = ", ".join(f"('{q}')" for q in _QUERIES)


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS av FROM d),
q AS (SELECT query, word, count(*) AS times FROM (SELECT query, unnest({_TOKENS.format("query")}) AS word FROM (VALUES {_QUERY_ROWS}) v(query)) GROUP BY ALL),
p AS (SELECT doc_id, dl, word, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM p GROUP BY word),
s AS (SELECT query, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score FROM p JOIN f USING (word) JOIN q USING (word), n GROUP BY ALL)
SELECT query, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10 AND score > 0""")
def bm25_topk(spark, sf_dir):
    q = spark.createDataFrame([(x,) for x in _QUERIES], "query string")
    return S.bm25(table(spark, sf_dir, "documents"), q, k=10)


def _votes(text: str, keywords: dict[str, list[str]]) -> str:
    return "[" + ", ".join("{'votes': " + " + ".join(f"CAST(contains(lower({text}), '{w.lower()}') AS INTEGER)" for w in ws) + f", 'order': {-i}, 'name': '{k}'}}" for i, (k, ws) in enumerate(keywords.items())) + "]"


@query(f"SELECT conv_id, turn, CASE WHEN b.votes > 0 THEN b.name ELSE 'style' END AS domain FROM (SELECT conv_id, turn, list_max({_votes('text', DOMAINS)}) AS b FROM conversations)")
def query_domain(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.most_votes(F.col("text"), DOMAINS, "style").alias("domain"))


@query("SELECT page_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(url), '{w}')" for w in ws) + f" THEN '{r}'" for ws, r in PAGE_TYPES) + " ELSE 'General' END AS page_type FROM pages")
def page_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.first_keyword(F.col("url"), PAGE_TYPES, "General").alias("page_type"))


_OTHER = {k: v for k, v in INTENTS.items() if k != "neutral"}


@query(f"SELECT doc_id, CASE WHEN b.votes > 0 AND b.votes >= n[1].votes THEN b.name ELSE 'neutral' END AS intent FROM (SELECT doc_id, list_max({_votes('text', _OTHER)}) AS b, {_votes('text', {'neutral': INTENTS['neutral']})} AS n FROM documents)")
def design_intent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.intent(F.col("text"), INTENTS).alias("intent"))


_STYLES, _SCENES = {"promo": ["promo"], "economy": ["economy"], "brass": ["polished brass", "brass"]}, {"metal": ["steel", "tin", "copper"], "plate": ["plated", "anodized"]}


@query(f"SELECT p_partkey, CASE WHEN a.votes > 0 THEN a.name WHEN b.votes > 0 THEN b.name ELSE 'plain' END AS style FROM (SELECT p_partkey, list_max({_votes('p_type', _STYLES)}) AS a, list_max({_votes('p_type', _SCENES)}) AS b FROM part)")
def style_detection(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.style_votes(F.col("p_type"), _STYLES, _SCENES, "plain").alias("style"))


_RULES = [(1, "STANDARD TIN"), (2, "steel"), (3, "economy-brass"), (4, "large/plated nickel"), (5, "copper"), (6, "src1")]
_RULE_ROWS = ", ".join(f"({i}, '{n}')" for i, n in _RULES)


@query(rf"""WITH r(no, rule) AS (VALUES {_RULE_ROWS}), k AS (SELECT DISTINCT p_type AS key FROM part UNION SELECT DISTINCT source FROM documents),
m AS (SELECT key, rule, no, CASE WHEN lower(rule) = lower(key) THEN 1 WHEN contains(lower(key), lower(rule)) OR contains(lower(rule), lower(key)) THEN 2
  WHEN len(list_filter(regexp_split_to_array(translate(lower(rule), '/-', '  '), '\s+'), lambda w: w <> '' AND contains(lower(key), w))) > 0 THEN 3 END AS p FROM k, r),
b AS (SELECT key, min((p, no, rule)) FILTER (p IS NOT NULL) AS b FROM m GROUP BY key)
SELECT key, b[3] AS rule, CAST(coalesce(b[1], 4) AS INTEGER) AS priority FROM b""")
def rule_cascade(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select(F.col("p_type").alias("key")).unionAll(table(spark, sf_dir, "documents").select("source"))
    return S.rule_cascade(keys, "key", spark.createDataFrame(_RULES, "no int, rule string"), "rule", "no")


_PRIORITIES = ["brass", "steel"]


@query(f"""WITH c AS (SELECT p_brand AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, lower(p_type) AS n, lower(p_name) AS w, p_type FROM part),
s AS (SELECT *, CASE WHEN contains(n, 'brass') OR contains('brass', n) THEN 0 WHEN contains(n, 'steel') OR contains('steel', n) THEN 1 END AS o,
  {" + ".join(f"CASE WHEN contains(n, '{p}') THEN 10 WHEN contains(w, '{p}') THEN 3 WHEN contains(lower(key), '{p}') THEN 1 ELSE 0 END" for p in _PRIORITIES)} AS sc FROM c),
b AS (SELECT key, min((CASE WHEN o IS NOT NULL THEN 1 WHEN sc > 0 THEN 2 ELSE 3 END, CASE WHEN o IS NOT NULL THEN o WHEN sc > 0 THEN -sc ELSE 0 END, rank, p_type)) AS b FROM s GROUP BY key)
SELECT key, b[4] AS match, CAST(b[1] AS INTEGER) AS step FROM b""")
def best_style_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("key", F.col("p_brand"))
    p = p.withColumn("rank", U.rank_in(p, ["p_brand"], [F.col("p_partkey")]))
    return S.best_match(p, "key", "rank", "p_type", "p_name", "p_brand", _PRIORITIES)


@query("""WITH a AS (SELECT DISTINCT p_name AS a, lower(trim(p_name)) AS s FROM part WHERE p_partkey <= 300), b AS (SELECT DISTINCT p_type AS b, lower(trim(p_type)) AS t FROM part),
x AS (SELECT a, b, s, t, list_distinct(string_split(s, '')) AS u, list_distinct(string_split(t, '')) AS v FROM a, b)
SELECT a, b, round(len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))), 4) AS sim FROM x WHERE contains(s, t) OR contains(t, s) OR len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) > 0.6""".replace(" WHERE p_partkey <= 300", ""))
def fuzzy_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return S.fuzzy_pairs(p, p, "p_name", "p_type")


_RECTS = "SELECT p_brand, p_partkey, p_size * 0.7 AS left, (p_partkey % 40) * 0.5 AS top, 1.5 AS width, 0.8 AS height FROM part"


@query(f"""WITH r AS ({_RECTS}) SELECT x.p_brand, x.p_partkey AS a, y.p_partkey AS b, round((least(x.left + x.width, y.left + y.width) - greatest(x.left, y.left)) * (least(x.top + x.height, y.top + y.height) - greatest(x.top, y.top)), 2)::DOUBLE AS area
FROM r x JOIN r y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey WHERE least(x.left + x.width, y.left + y.width) - greatest(x.left, y.left) > 0.05 AND least(x.top + x.height, y.top + y.height) - greatest(x.top, y.top) > 0.05""".replace("* 0.7", "* 0.7::DOUBLE").replace("* 0.5", "* 0.5::DOUBLE").replace("1.5 AS", "1.5::DOUBLE AS").replace("0.8 AS", "0.8::DOUBLE AS"))
def rect_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") * 0.7).alias("left"), ((F.col("p_partkey") % 40) * 0.5).alias("top"), F.lit(1.5).alias("width"), F.lit(0.8).alias("height"))
    return S.overlaps(p, "p_brand", "p_partkey", 2.0)


@query("SELECT coalesce(o_orderpriority, 'None') AS o_orderpriority, coalesce(o_orderstatus, 'None') AS o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 2) AS o_totalprice_average, round(count(o_totalprice)::DOUBLE, 2) AS o_totalprice_count FROM orders GROUP BY 1, 2")
def pivot_flat(spark, sf_dir):
    return A.pivot_flat(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], [("o_totalprice", "sum"), ("o_totalprice", "average"), ("o_totalprice", "count")])


@query("SELECT o_orderpriority, " + ", ".join(f"coalesce(round(max(o_totalprice) FILTER (o_orderstatus = '{s}'), 2), 0)::DOUBLE AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_cross(spark, sf_dir):
    return A.pivot_cross(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", "max", ["F", "O", "P"])


_SUMMARY = "SELECT event_type, round(coalesce(avg(value), 0), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stddev, round(coalesce(min(value), 0), 4) AS min, round(coalesce(max(value), 0), 4) AS max FROM events GROUP BY event_type"


@query(_SUMMARY)
def stats_summary(spark, sf_dir):
    return A.summary(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"WITH s AS ({_SUMMARY}), p AS (SELECT coalesce(max(mean) FILTER (event_type = 'click'), 0) AS a, coalesce(max(mean) FILTER (event_type = 'purchase'), 0) AS b FROM s) SELECT a AS \"primary\", b AS baseline, round(a - b, 4) AS delta FROM p")
def stats_delta(spark, sf_dir):
    return A.delta(A.summary(table(spark, sf_dir, "events"), ["event_type"], "value"), "event_type", "click", "purchase")


_RUNS = "SELECT source AS query, quality = 1 AS triggered, CAST(substr(source, 4) AS INTEGER) % 2 = 0 AS expected FROM labels JOIN documents USING (doc_id)"


@query(f"SELECT query, round(r, 4) AS rate, runs, CASE WHEN e THEN r >= 0.85 ELSE r < 0.85 END AS pass FROM (SELECT query, avg(CAST(triggered AS INTEGER)) AS r, bool_or(expected) AS e, count(*) AS runs FROM ({_RUNS}) GROUP BY query)")
def trigger_rates(spark, sf_dir):
    runs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    runs = runs.select(F.col("source").alias("query"), (F.col("quality") == 1).alias("triggered"), (F.substring("source", 4, 9).cast("int") % 2 == 0).alias("expected"))
    return A.trigger_rates(runs, "query", "triggered", "expected", 0.85)


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 1.0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 1.0), 4) AS recall, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0), 4) AS accuracy FROM c""")
def confusion(spark, sf_dir):
    return A.confusion(table(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query("WITH i AS (SELECT CAST(doc_id % 7 AS BIGINT) AS it, sum(quality) AS p FROM labels GROUP BY 1) SELECT first(it ORDER BY p DESC, it) AS best, CAST(max(p) AS BIGINT) AS passes FROM i")
def best_iteration(spark, sf_dir):
    i = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 7).alias("it")).agg(F.sum("quality").alias("train")).withColumn("test", F.lit(None).cast("bigint"))
    return A.best_iteration(i, "it", "test", "train")


_SPLIT = "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY quality) * 0.4)) THEN 'test' ELSE 'train' END AS split FROM labels"


@query(_SPLIT)
def stratified_split(spark, sf_dir):
    return A.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality", 0.4)


@query(f"WITH s AS ({_SPLIT}) SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM s WHERE split = 'test')) AS inside, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE split = 'test')) AS outside")
def membership_split(spark, sf_dir):
    test = A.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality", 0.4).where("split = 'test'")
    inside, outside = A.members(table(spark, sf_dir, "documents"), test, "doc_id")
    n = inside.select(F.lit(1).alias("i")).unionAll(outside.select(F.lit(0)))
    return n.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("inside"), F.sum(1 - F.col("i")).alias("outside"))


_ITEMS = "SELECT s_name AS key, s_acctbal AS price, CAST(s_suppkey % 50 * 100 AS DOUBLE) AS target, CAST(s_suppkey % 7 * 500 AS DOUBLE) AS stop, CASE WHEN s_suppkey % 2 = 0 THEN 'buy' ELSE 'hold' END AS sig, CASE WHEN s_suppkey % 3 = 0 THEN 'buy' ELSE 'hold' END AS last_sig, s_suppkey % 5 <> 0 AS wanted FROM supplier"


def _items(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.col("s_acctbal").alias("price"), (k % 50 * 100).cast("double").alias("target"), (k % 7 * 500).cast("double").alias("stop"), F.when(k % 2 == 0, "buy").otherwise("hold").alias("sig"), F.when(k % 3 == 0, "buy").otherwise("hold").alias("last_sig"), (k % 5 != 0).alias("wanted"))


@query(f"WITH i AS ({_ITEMS}) SELECT key, 'target_hit' AS alert_type FROM i WHERE target <> 0 AND price >= target UNION ALL SELECT key, 'stop_hit' FROM i WHERE stop <> 0 AND price <= stop UNION ALL SELECT key, 'signal_change' FROM i WHERE price IS NOT NULL AND wanted AND sig <> last_sig")
def watch_alerts(spark, sf_dir):
    return C.alerts(_items(spark, sf_dir), "key", F.col("price"), F.col("target"), F.col("stop"), F.col("sig"), F.col("last_sig"), F.col("wanted"))


@query(f"WITH i AS ({_ITEMS}) SELECT key, CASE WHEN price <> 0 AND stop <> 0 THEN round((price - stop) / stop * 100, 2) END AS change_pct, CASE WHEN price <> 0 AND target <> 0 THEN round((target - price) / price * 100, 2) END AS to_target_pct, CASE WHEN price <> 0 AND stop <> 0 THEN round((stop - price) / price * 100, 2) END AS to_stop_pct FROM i")
def watch_list(spark, sf_dir):
    return C.watch_list(_items(spark, sf_dir), F.col("price"), F.col("stop"), F.col("target"), F.col("stop")).select("key", "change_pct", "to_target_pct", "to_stop_pct")


_KIND = "CASE user_id % 6 WHEN 0 THEN 'ma' WHEN 1 THEN 'insider' WHEN 2 THEN 'analyst' WHEN 3 THEN 'regulatory' WHEN 4 THEN 'earnings' ELSE 'other' END"


@query(f"""SELECT kind, score, count(*) AS cnt FROM (SELECT {_KIND} AS kind, CAST(least(10, 1 + CASE {_KIND} WHEN 'ma' THEN 5 WHEN 'insider' THEN 4 WHEN 'analyst' THEN 3 WHEN 'regulatory' THEN 3 WHEN 'earnings' THEN 2 ELSE 1 END
 + CASE WHEN regexp_matches(event_type, '(?i)breaking|just in|alert|urgent') THEN 2 ELSE 0 END + CASE WHEN value > 50 THEN 2 ELSE 0 END) AS INTEGER) AS score FROM events) GROUP BY ALL""")
def impact_score(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["ma", "insider", "analyst", "regulatory", "earnings", "other"]))
    e = table(spark, sf_dir, "events").withColumn("kind", F.get(kinds, (F.col("user_id") % 6).cast("int")))
    return e.select("kind", C.impact(F.col("kind"), F.col("event_type"), F.col("value") > 50).alias("score")).groupBy("kind", "score").agg(F.count("*").alias("cnt"))


@query("SELECT user_id, count(*) AS cnt FROM events WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY cnt DESC, user_id LIMIT 10")
def top_entities(spark, sf_dir):
    return C.top_entities(table(spark, sf_dir, "events"), "user_id")


_FIGURES = "SELECT c_custkey AS key, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 100 END AS payout, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 20 AS DOUBLE) - 4 END AS growth, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 30 END AS years, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 10 AS DOUBLE) END AS yield FROM customer"


@query(f"""WITH f AS ({_FIGURES}), s AS (SELECT key, payout, CAST(greatest(0, least(100, 50 + coalesce(CASE WHEN payout < 40 THEN 20 WHEN payout < 60 THEN 10 WHEN payout < 80 THEN -10 WHEN payout >= 80 THEN -20 END, 0)
 + coalesce(CASE WHEN growth > 10 THEN 15 WHEN growth > 5 THEN 10 WHEN growth > 0 THEN 5 WHEN growth <= 0 THEN -15 END, 0) + coalesce(CASE WHEN years >= 25 THEN 15 WHEN years >= 10 THEN 10 WHEN years >= 5 THEN 5 END, 0) + CASE WHEN yield > 8 THEN -10 ELSE 0 END)) AS INTEGER) AS score FROM f)
SELECT key, CASE WHEN payout IS NULL THEN 'unknown' WHEN payout < 40 THEN 'safe' WHEN payout < 60 THEN 'moderate' WHEN payout < 80 THEN 'high' ELSE 'unsustainable' END AS band, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'moderate' ELSE 'poor' END AS rating FROM s""")
def safety_score(spark, sf_dir):
    k = F.col("c_custkey")
    f = table(spark, sf_dir, "customer").select(k.alias("key"), F.when(k % 11 != 0, F.col("c_acctbal") / 100).alias("payout"), F.when(k % 5 != 0, (k % 20).cast("double") - 4).alias("growth"), F.when(k % 3 != 0, k % 30).alias("years"), F.when(k % 7 != 0, (k % 10).cast("double")).alias("yield"))
    score, _ = C.safety(F.col("payout"), F.col("growth"), F.col("years"), F.col("yield"))
    return f.select("key", C.payout_band(F.col("payout")).alias("band"), score.alias("score")).withColumn("rating", C.income_rating(F.col("score")))


@query("SELECT c_custkey, CASE WHEN regexp_matches(c, '^[0-9]{6}$') THEN 'CN' WHEN regexp_matches(c, '(?i)^[0-9]{4,5}\\.HK$') THEN 'HK' ELSE 'US' END AS market FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') || '.hk' ELSE c_name END AS c FROM customer)")
def ticker_market(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, F.lpad(k.cast("string"), 6, "0")).when(k % 3 == 1, F.concat(F.lpad(k.cast("string"), 4, "0"), F.lit(".hk"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.market(code).alias("market"))


@query(f"WITH f AS ({_FIGURES}) SELECT key, list_filter([CASE WHEN payout IS NULL OR payout = 0 THEN 'no price' END, CASE WHEN (growth IS NULL OR growth = 0) AND (years IS NULL OR years = 0) THEN 'no averages' END, CASE WHEN yield > 8 THEN 'overbought' END, CASE WHEN (yield IS NULL OR yield = 0) AND (years IS NULL OR years = 0) THEN 'no fundamentals' END], lambda x: x IS NOT NULL) AS warnings FROM f")
def quote_warnings(spark, sf_dir):
    k = F.col("c_custkey")
    f = table(spark, sf_dir, "customer").select(k.alias("key"), F.when(k % 11 != 0, F.col("c_acctbal") / 100).alias("p"), F.when(k % 5 != 0, (k % 20).cast("double") - 4).alias("g"), F.when(k % 3 != 0, k % 30).alias("y"), F.when(k % 7 != 0, (k % 10).cast("double")).alias("d"))
    c = F.col
    return f.select("key", C.quote_warnings(c("p"), c("g"), c("y"), c("d") > 8, c("d"), c("y")).alias("warnings"))


@query("SELECT key, CASE key % 4 WHEN 0 THEN '买入' WHEN 1 THEN '强烈买入' WHEN 2 THEN '卖出' ELSE '观望' END AS verdict FROM (SELECT n_nationkey AS key FROM nation)")
def verdicts(spark, sf_dir):
    k = F.col("n_nationkey")
    text = F.when(k % 4 == 0, "一\n结论: 🟢 买入").when(k % 4 == 1, "核心结论：强烈买入").when(k % 4 == 2, "我们 **卖出** 它").otherwise("nothing")
    return table(spark, sf_dir, "nation").select(k.alias("key"), C.verdict(text).alias("verdict"))


@query("""WITH o AS (SELECT upper(s_name) AS key, s_acctbal AS v, 'old' AS note FROM supplier), n AS (SELECT upper('supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS key, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS v, 'new' AS note FROM customer)
SELECT coalesce(o.key, n.key) AS key, coalesce(n.v, o.v) AS v, coalesce(n.note, o.note) AS note, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'kept' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.key = n.key WHERE coalesce(o.key, n.key) NOT IN (SELECT upper(s_name) FROM supplier WHERE s_nationkey = 3)""")
def watch_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    old = s.select(F.col("s_name").alias("key"), F.col("s_acctbal").alias("v"), F.lit("old").alias("note"))
    k = F.col("c_custkey")
    new = table(spark, sf_dir, "customer").select(F.concat(F.lit("supplier#"), F.lpad(k.cast("string"), 9, "0")).alias("key"), F.when(k % 2 == 0, F.col("c_acctbal")).alias("v"), F.lit("new").alias("note"))
    return A.upsert(old, new, "key", ["v", "note"], s.where("s_nationkey = 3").select(F.col("s_name").alias("key")))


@query("SELECT c_custkey, s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def optional_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    return A.lookup_enrich(table(spark, sf_dir, "customer"), s, "c_custkey").select("c_custkey", "s_name")


@query("""WITH t AS (SELECT o_orderpriority AS q, first(o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS c FROM orders GROUP BY 1)
SELECT q, c AS o_custkey, o_orderkey, CAST(p AS INTEGER) AS position FROM (SELECT q, c, o_orderkey, row_number() OVER (PARTITION BY q ORDER BY o_orderdate, o_orderkey) AS p FROM t JOIN orders ON o_custkey = c) WHERE p <= 3""")
def top_fanout(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = A.top_fanout(o.withColumnRenamed("o_orderpriority", "q"), "q", F.struct("o_totalprice", -F.col("o_orderkey")), "o_custkey", o.select("o_custkey", "o_orderkey", "o_orderdate"), 3, ["o_orderdate", "o_orderkey"])
    return d.select("q", "o_custkey", "o_orderkey", "position")


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def undefined_refs(spark, sf_dir):
    """Conversations without a labelled document of the same number."""
    return U.dangling(table(spark, sf_dir, "conversations").select("conv_id").distinct(), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id")), "conv_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return U.duplicate_ids(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


_CELLS = """SELECT 's' || (l_orderkey % 5) AS sheet, CAST(l_orderkey AS INTEGER) AS "row", l_linenumber AS col, CASE l_partkey % 9 WHEN 0 THEN '#REF!' WHEN 1 THEN '0' ELSE CAST(l_suppkey AS VARCHAR) END AS value,
CASE l_partkey % 7 WHEN 0 THEN '=SUM(A1:A' || l_linenumber || ')' WHEN 1 THEN '=AVERAGE(B2:B3)' WHEN 2 THEN '=XLOOKUP(A2,B:B,C:C)' WHEN 3 THEN '=SUM(A2:A' || (l_orderkey * 4 + 100) || ')' WHEN 4 THEN '=MATCH(TRUE,A2:A90,0)' WHEN 5 THEN '=hello' END AS formula FROM lineitem"""


def _cells(spark, sf_dir):
    p = F.col("l_partkey") % 7
    n = F.col("l_linenumber").cast("string")
    value = F.when(F.col("l_partkey") % 9 == 0, "#REF!").when(F.col("l_partkey") % 9 == 1, "0").otherwise(F.col("l_suppkey").cast("string"))
    formula = F.when(p == 0, F.concat(F.lit("=SUM(A1:A"), n, F.lit(")"))).when(p == 1, "=AVERAGE(B2:B3)").when(p == 2, "=XLOOKUP(A2,B:B,C:C)").when(p == 3, F.concat(F.lit("=SUM(A2:A"), (F.col("l_orderkey") * 4 + 100).cast("string"), F.lit(")"))).when(p == 4, "=MATCH(TRUE,A2:A90,0)").when(p == 5, "=hello")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), (F.col("l_orderkey") % 5).cast("string")).alias("sheet"), F.col("l_orderkey").cast("int").alias("row"), F.col("l_linenumber").alias("col"), value.alias("value"), formula.alias("formula"))


@query(f"""WITH c AS ({_CELLS}) SELECT sheet, 'error' AS kind, count(*) AS cnt FROM c WHERE formula IS NOT NULL AND contains(value, '#REF!') GROUP BY ALL UNION ALL SELECT sheet, 'zero', count(*) FROM c WHERE formula IS NOT NULL AND value = '0' GROUP BY ALL
UNION ALL SELECT sheet, 'implicit_array', count(*) FROM c WHERE starts_with(formula, '=MATCH') GROUP BY ALL""")
def formula_audit(spark, sf_dir):
    f = U.formula_audit(_cells(spark, sf_dir))
    return f.groupBy("sheet", F.when(F.startswith("finding", F.lit("#")), "error").otherwise(F.col("finding")).alias("kind")).agg(F.count("*").alias("cnt"))


@query(rf"""WITH c AS ({_CELLS}), m AS (SELECT sheet, max("row") AS last FROM c GROUP BY sheet), d AS (SELECT c.*, last, list_transform(regexp_extract_all(formula, '([A-Z]{{1,3}})(\d+):([A-Z]{{1,3}})(\d+)', 4), lambda x: CAST(x AS INTEGER)) AS e FROM c JOIN m USING (sheet) WHERE formula IS NOT NULL),
p AS (SELECT sheet, col, regexp_replace(formula, '(\$?[A-Z]{{1,3}}\$?)\d+', '\1#', 'g') AS pat FROM c WHERE formula IS NOT NULL), k AS (SELECT sheet, col, pat, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT sheet, col, max((n, pat)) AS top, sum(n) AS tot FROM k GROUP BY ALL),
f AS (SELECT sheet, 'out_of_range' AS finding FROM d WHERE len(list_filter(e, lambda x: x > last * 3 AND x > 100)) > 0 UNION ALL SELECT sheet, 'header_included' FROM d WHERE starts_with(formula, '=SUM(A1:') AND "row" > 1
UNION ALL SELECT sheet, 'small_aggregate' FROM d WHERE formula = '=AVERAGE(B2:B3)' OR formula IN ('=SUM(A1:A1)', '=SUM(A1:A2)') UNION ALL
SELECT p.sheet, 'inconsistent_pattern' FROM p JOIN k USING (sheet, col, pat) JOIN t USING (sheet, col) WHERE tot >= 3 AND p.pat <> top[2] AND n <= 2 AND n < top[1])
SELECT sheet, finding, count(*) AS cnt FROM f GROUP BY ALL""")
def reference_audit(spark, sf_dir):
    return U.reference_audit(_cells(spark, sf_dir)).groupBy("sheet", "finding").agg(F.count("*").alias("cnt"))


@query(f"WITH c AS ({_CELLS}) SELECT sheet, 'forbidden_function' AS finding, count(*) AS cnt FROM c WHERE starts_with(formula, '=XLOOKUP') GROUP BY ALL UNION ALL SELECT sheet, 'text_as_formula', count(*) FROM c WHERE formula = '=hello' GROUP BY ALL")
def structural_issues(spark, sf_dir):
    return U.structural_issues(_cells(spark, sf_dir)).groupBy("sheet", "finding").agg(F.count("*").alias("cnt"))


@query(f"""WITH c AS (SELECT r_name AS sheet, CAST(n_nationkey % 4 + 1 AS INTEGER) AS "row", CAST(n_nationkey // 4 + 1 AS INTEGER) AS col, n_name AS value, CASE WHEN n_nationkey % 3 = 0 THEN '=A1' END AS formula FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT sheet, max("row") AS rows, max(col) AS cols, count(formula) AS formulas, coalesce(string_agg(value, ',' ORDER BY col) FILTER ("row" = 1), '') AS headers, greatest(0, max("row") - 1) AS data_rows FROM c GROUP BY sheet""")
def sheet_structure(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    return U.structure(j.select(F.col("r_name").alias("sheet"), (k % 4 + 1).cast("int").alias("row"), (F.floor(k / 4) + 1).cast("int").alias("col"), F.col("n_name").alias("value"), F.when(k % 3 == 0, "=A1").alias("formula")))


@query("SELECT CAST(n_nationkey AS INTEGER) AS key, 'S' || n_nationkey AS sheet, CAST(n_nationkey + 1 AS INTEGER) AS min_col, CAST(n_nationkey * 2 + 1 AS INTEGER) AS min_row, CAST(n_nationkey + 27 AS INTEGER) AS max_col, CAST(n_nationkey * 3 + 9 AS INTEGER) AS max_row FROM nation")
def range_parser(spark, sf_dir):
    k = F.col("n_nationkey")
    text = F.concat(F.lit("S"), k.cast("string"), F.lit("!"), U.column_letters(k + 1), (k * 2 + 1).cast("string"), F.lit(":"), U.column_letters(k + 27), (k * 3 + 9).cast("string"))
    return table(spark, sf_dir, "nation").select(k.cast("int").alias("key"), U.parse_range(text).alias("r")).select("key", "r.*")


@query("SELECT n_nationkey AS key, CAST(i AS INTEGER) AS idx FROM (SELECT n_nationkey, unnest(list_distinct(list_concat(range(0, 3), [n_nationkey % 9 + 1], range(5, 7)))) AS i FROM nation) WHERE i < 8")
def page_indexes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("1-3, "), (F.col("n_nationkey") % 9 + 2).cast("string"), F.lit(",6-7,x")).alias("spec"))
    return U.page_indexes(n, "key", "spec", F.lit(8))


@query("SELECT c_custkey, o > 0 AND abs(o - f) / o > 0.3 AS drifted FROM (SELECT o_custkey AS c_custkey, count(*) AS o, count(*) FILTER (o_orderstatus <> 'P') AS f FROM orders GROUP BY 1)")
def heading_drift(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o"), F.count_if(F.col("o_orderstatus") != "P").alias("f"))
    return g.select("c_custkey", U.drift(F.col("o"), F.col("f")).alias("drifted"))


@query(r"""WITH v AS (SELECT doc_id, 'The' AS name, unnest(regexp_extract_all(text, '(?i)\bThe\b')) AS variant FROM documents UNION ALL SELECT doc_id, 'License', unnest(regexp_extract_all(text, '(?i)\bLicense\b')) FROM documents)
SELECT name, variant, count(*) AS cnt, count(DISTINCT doc_id) AS docs FROM v WHERE variant <> name GROUP BY ALL""")
def name_variants(spark, sf_dir):
    return U.name_variants(table(spark, sf_dir, "documents"), "doc_id", "text", ["The", "License"])


@query("SELECT l_partkey, 'flag' AS attribute, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
def contradictions(spark, sf_dir):
    return U.contradictions(table(spark, sf_dir, "lineitem").withColumn("attribute", F.lit("flag")), "l_partkey", "attribute", "l_returnflag")


@query(r"""WITH n AS (SELECT DISTINCT lower(w) AS w, w AS name FROM (VALUES ('License'), ('Apache'), ('pathetic'), ('Password')) v(w)), d AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents)
SELECT doc_id, name FROM d JOIN n USING (w)""")
def name_mentions(spark, sf_dir):
    names = spark.createDataFrame([("License",), ("Apache",), ("pathetic",), ("Password",)], "name string")
    return U.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", names, "name", "[A-Za-z]+")


@query(r"""WITH s AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id), x AS (SELECT *, string_split(t, chr(10)) AS l, length(regexp_replace(t, '\s+', '', 'g')) AS n FROM s)
SELECT conv_id, list_filter([CASE WHEN NOT contains(t, 'user: ') THEN 'no host' END, CASE WHEN NOT contains(t, 'assistant: ') THEN 'no guest' END, CASE WHEN len(list_filter(l, lambda y: starts_with(y, 'user: ') OR starts_with(y, 'assistant: '))) < 8 THEN 'few turns' END,
CASE WHEN n < 200 OR n > 5000 THEN 'length' END, CASE WHEN NOT contains(t, 'the') THEN 'no the' END, CASE WHEN len(list_filter(l, lambda y: trim(y) <> '')) < 10 THEN 'few lines' END], lambda y: y IS NOT NULL) AS problems FROM x""")
def dialogue_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("t"))
    return s.select("conv_id", U.dialogue_problems(F.col("t"), "user: ", "assistant: ", 200, 5000, ["the"]).alias("problems"))


_L = "(0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2})"


@query("""WITH c AS (SELECT n_nationkey AS k, (n_nationkey * 15) % 360 / 360.0::DOUBLE AS h, 0.5::DOUBLE AS s, 0.4::DOUBLE AS l FROM nation), m AS (SELECT k, h, l * (1 + s) AS m2, 2 * l - l * (1 + s) AS m1 FROM c),
t AS (SELECT k, m1, m2, list_transform([h + 1.0::DOUBLE / 3, h, h - 1.0::DOUBLE / 3], lambda x: x - floor(x)) AS t FROM m),
v AS (SELECT k, list_transform(t, lambda x: CAST(floor(255 * CASE WHEN x < 1.0::DOUBLE / 6 THEN m1 + (m2 - m1) * x * 6 WHEN x < 0.5 THEN m2 WHEN x < 2.0::DOUBLE / 3 THEN m1 + (m2 - m1) * (2.0::DOUBLE / 3 - x) * 6 ELSE m1 END) AS INTEGER)) AS v FROM t),
w AS (SELECT k, '#' || lower(printf('%02x%02x%02x', v[1], v[2], v[3])) AS colour, list_transform(v, lambda x: CASE WHEN x / 255 <= 0.04045 THEN x / 255 / 12.92 ELSE pow((x / 255 + 0.055) / 1.055, 2.4) END) AS c FROM v)
SELECT k AS key, colour, round(1.05 / (0.2126 * c[1] + 0.7152 * c[2] + 0.0722 * c[3] + 0.05), 4)::DOUBLE AS contrast FROM w""")
def colours(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), N.hsl_to_hex((F.col("n_nationkey") * 15) % 360, F.lit(0.5), F.lit(0.4)).alias("colour"))
    return n.withColumn("contrast", F.round(N.contrast(F.col("colour"), F.lit("#ffffff")), 4))


@query("WITH s AS (SELECT doc_id, length(text) AS o, octet_length(encode(text)) AS p FROM documents) SELECT round(avg(CASE WHEN p > 0 THEN o / p ELSE 0 END), 4) AS mean_ratio, round(100 * (1 - sum(p) / sum(o)), 4) AS saved_pct, count(*) FILTER (p < o + 10) AS wins FROM s")
def compression_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.char_length("text").alias("o"), F.octet_length("text").alias("p"))
    return C.compression_report(d.withColumn("b", F.col("o") + 10), "o", "p", "b")


@query("SELECT event_type AS time, unnest([user_id % 5, user_id % 3]) AS character, count(*) AS cnt, min(event_id) AS first_event FROM events GROUP BY ALL".replace("SELECT event_type AS time, unnest([user_id % 5, user_id % 3]) AS character, count(*)", "SELECT time, character, count(*)").replace("FROM events", "FROM (SELECT event_type AS time, event_id, unnest([user_id % 5, user_id % 3]) AS character FROM events)"))
def events_by_character(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("time"), "event_id", F.explode(F.array(F.col("user_id") % 5, F.col("user_id") % 3)).alias("character"))
    return e.groupBy("time", "character").agg(F.count("*").alias("cnt"), F.min("event_id").alias("first_event"))


@query("SELECT source, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def conditional_counts(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("toxic"))
