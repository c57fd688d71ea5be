"""Queries over sets, blanks, flattened JSON, addresses and several corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import profile as P
from millrace.operators import search as S
from millrace.plans.registry import Registry
from millrace.plans.rule_queries import _TOKENS
from millrace.sources.tables import table

R = Registry()
query = R.query


@query("SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY k")
def union_all_counts(spark, sf_dir):
    u = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    return u.groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS k FROM conversations UNION SELECT doc_id FROM labels")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k")).union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT doc_id AS k FROM labels EXCEPT SELECT conv_id FROM conversations")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")).subtract(table(spark, sf_dir, "conversations").select("conv_id"))


@query("SELECT conv_id, turn FROM conversations WHERE regexp_replace(text, '[\\s ​]+', '', 'g') <> ''")
def blank_rows_dropped(spark, sf_dir):
    return P.drop_blank_rows(table(spark, sf_dir, "conversations"), ["text"]).select("conv_id", "turn")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE) AS missing FROM events")
def json_flatten(spark, sf_dir):
    return P.json_flatten(table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": "bigint", "missing": "double"}).drop("props")


@query("SELECT event_id, '{\"K00\":\"' || json_extract_string(props, '$.k') || '\"}' AS renamed FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_short_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return P.json_rename(e, "event_id", "props", P.json_short_keys(e, "event_id", "props"))


_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"


@query(rf"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS ip FROM documents), p AS (SELECT ip, count(*) AS cnt FROM a GROUP BY ip),
s AS (SELECT ip, cnt, list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)) AS b FROM p)
SELECT ip, cnt, CASE WHEN list_max(b) <= 255 AND NOT regexp_matches(ip, '(^|\.)0[0-9]') THEN b[1] * 16777216 + b[2] * 65536 + b[3] * 256 + b[4] END AS packed FROM s""")
def packed_addresses(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_IP), F.lit(0))).alias("ip")).groupBy("ip").agg(F.count("*").alias("cnt"))
    ok = ~F.regexp_like("ip", F.lit(r"(^|\.)0[0-9]"))
    return a.select("ip", "cnt", F.when(ok, N.ipv4(F.col("ip"))).alias("packed"))


def _bm25(source: str) -> str:
    t = _TOKENS
    return f"""SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM (WITH d AS (SELECT id, {t.format("text")} AS t FROM {source}), n AS (SELECT count(*) AS n, avg(len(t)) AS av FROM d),
q AS (SELECT query, word, count(*) AS times FROM (SELECT query, unnest({t.format("query")}) AS word FROM (VALUES ('the with and'), ('steel brass')) v(query)) GROUP BY ALL),
p AS (SELECT id, dl, word, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM p GROUP BY word),
s AS (SELECT query, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score FROM p JOIN f USING (word) JOIN q USING (word), n GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3 AND score > 0"""


@query(f"SELECT *, 'parts' AS domain FROM ({_bm25('(SELECT p_partkey AS id, p_name || chr(32) || p_type AS text FROM part)')}) UNION ALL SELECT *, 'items' AS domain FROM ({_bm25('(SELECT item_id AS id, text FROM benchmark)')})")
def multi_domain_search(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    domains = {"parts": p.select(F.col("p_partkey").alias("id"), S.search_text(p, ["p_name", "p_type", "absent"]).alias("text")), "items": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")}
    return S.multi_domain(domains, spark.createDataFrame([("the with and",), ("steel brass",)], "query string"), "id", "text")


@query("SELECT doc_id, regexp_replace(text, '[\\s ​]+', '', 'g') = '' AS blank FROM documents")
def blank_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.blank_to_null(F.col("text")).isNull().alias("blank"))
