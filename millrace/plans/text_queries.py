"""Queries over lines, words, n-grams and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import lines as L
from millrace.plans.registry import Registry
from millrace.sources.tables import table

R = Registry()
query = R.query

_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
_BYTES = "octet_length(encode(line))"
_DICTIONARY = f"""SELECT line, cnt, saving, CAST(row_number() OVER (ORDER BY saving DESC, line) - 1 AS INTEGER) AS idx FROM (
  SELECT line, count(*) AS cnt, CAST(count(*) * any_value({_BYTES}) AS BIGINT) AS saving FROM {_LINES}
  WHERE {_BYTES} >= 4 GROUP BY line HAVING count(*) > 1) ORDER BY saving DESC, line LIMIT 255"""


@query(_DICTIONARY)
def line_dictionary(spark, sf_dir):
    return L.line_dictionary(table(spark, sf_dir, "documents"))


@query(f"""SELECT line, cnt, saving FROM (SELECT line, count(*) AS cnt, CAST(count(*) * any_value({_BYTES}) - any_value({_BYTES}) - 4 * count(*) AS BIGINT) AS saving
  FROM {_LINES} WHERE {_BYTES} >= 20 GROUP BY line HAVING count(*) >= 2) WHERE saving > 0""")
def dup_lines(spark, sf_dir):
    return L.duplicate_lines(table(spark, sf_dir, "documents"))


@query(f"""WITH dict AS ({_DICTIONARY}) SELECT doc_id, count(idx) AS ref_lines, count(*) - count(idx) AS literal_lines
  FROM {_LINES} l LEFT JOIN dict USING (line) GROUP BY doc_id""")
def line_encode_refs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    e = L.encode_references(docs, L.line_dictionary(docs))
    return e.groupBy("doc_id").agg(F.count("idx").alias("ref_lines"), F.count("literal").alias("literal_lines"))


@query("SELECT doc_id, true AS ok FROM documents")
def line_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d = L.line_dictionary(docs)
    back = L.decode_references(L.encode_references(docs, d), d)
    return docs.select("doc_id", F.md5("text").alias("was")).join(back.select("doc_id", F.md5("text").alias("now")), "doc_id").select("doc_id", (F.col("was") == F.col("now")).alias("ok"))


@query("""SELECT doc_id, CAST(coalesce(list_position(list_transform(range(1, length(text) + 1), lambda i: substr(text, i, 1) <> substr(lower(text), i, 1)), true), 0) AS INTEGER) AS first_difference FROM documents""")
def first_difference(spark, sf_dir):
    """Where a text first differs from its lower-cased form (0: nowhere), compared character by character on the JVM."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), F.lower("text").alias("b"))
    return d.select("doc_id", L.first_difference(F.col("a"), F.col("b")).alias("first_difference"))


@query("""WITH s AS (SELECT text, unnest([16, 32, 64, 128, 256, 512, 1024]) AS block_size FROM documents),
b AS (SELECT block_size, unnest(list_transform(range(length(text) // block_size), lambda i: substr(text, i * block_size + 1, block_size))) AS block FROM s),
g AS (SELECT block_size, block, count(*) AS n FROM b GROUP BY ALL)
SELECT block_size, count(*) AS uniq, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - count(*) AS BIGINT) AS dup, CAST((sum(n) - count(*)) * (block_size - 4) - count(*) * block_size AS BIGINT) AS saving FROM g GROUP BY block_size""")
def block_dedup(spark, sf_dir):
    return L.block_dedup(table(spark, sf_dir, "documents"))


@query("""SELECT word, cnt, saving FROM (SELECT word, count(*) AS cnt, CAST(count(*) * (length(word) - 2) - 4 AS BIGINT) AS saving
  FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) WHERE length(word) >= 3 GROUP BY word HAVING count(*) > 1) WHERE saving > 0 ORDER BY saving DESC, word LIMIT 8000""")
def word_dictionary(spark, sf_dir):
    return L.word_dictionary(table(spark, sf_dir, "documents"))


@query("""WITH w AS (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)
SELECT bigram, count(*) AS cnt FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w WHERE len(w) > 1) GROUP BY bigram""")
def bigram_counts(spark, sf_dir):
    return L.bigrams(table(spark, sf_dir, "documents"))


def _ngrams(lengths: str, least: int, most: int) -> str:
    return f"""WITH s AS (SELECT text, unnest({lengths}) AS n FROM benchmark),
g AS (SELECT n, unnest(list_transform(range(length(text) - n + 1), lambda i: substr(text, i + 1, n))) AS gram FROM s WHERE length(text) >= n)
SELECT gram, cnt, saving FROM (SELECT gram, count(*) AS cnt, CAST(count(*) * (any_value(n) - 2) - (any_value(n) + 6) AS BIGINT) AS saving FROM g GROUP BY gram HAVING count(*) >= {least})
WHERE saving > 0 ORDER BY saving DESC, gram LIMIT {most}"""


@query(_ngrams("range(3, 17)", 3, 100))
def ngram_savings(spark, sf_dir):
    return L.ngram_savings(table(spark, sf_dir, "benchmark"))


@query(_ngrams("[4, 6, 8, 12, 16, 24, 32, 48, 64]", 3, 500))
def ngram_savings_long(spark, sf_dir):
    return L.ngram_savings(table(spark, sf_dir, "benchmark"), lengths=[4, 6, 8, 12, 16, 24, 32, 48, 64], most=500)


@query("""WITH s AS (SELECT text, unnest([8, 16, 32, 64, 128]) AS n FROM documents),
g AS (SELECT n, unnest(list_transform(range(0, length(text) - n + 1, greatest(1, n // 4)), lambda i: substr(text, i + 1, n))) AS gram FROM s WHERE length(text) >= n),
c AS (SELECT gram, n, CAST(1 + (count(*) - 1) * greatest(1, n // 4) AS BIGINT) AS cnt, count(*) AS seen FROM g GROUP BY gram, n HAVING count(*) > 1)
SELECT gram, n, seen, cnt, CAST(cnt * (n - 3) - (n + 6) AS BIGINT) AS saving FROM c WHERE cnt * (n - 3) - (n + 6) > 0 ORDER BY saving DESC, gram LIMIT 4000""")
def global_substrings(spark, sf_dir):
    return L.sampled_substrings(table(spark, sf_dir, "documents"))


@query("""WITH h AS (SELECT hex(encode(text)) AS h FROM documents)
SELECT CAST('0x' || substr(p, 1, 2) AS INTEGER) AS b0, CAST('0x' || substr(p, 3, 2) AS INTEGER) AS b1, count(*) AS cnt
FROM (SELECT unnest(list_transform(range(length(h) // 2 - 1), lambda i: substr(h, i * 2 + 1, 4))) AS p FROM h WHERE length(h) >= 4) GROUP BY p""")
def byte_pairs(spark, sf_dir):
    return L.byte_pairs(table(spark, sf_dir, "documents"))


@query("""WITH h AS (SELECT hex(encode(text)) AS h FROM documents)
SELECT CAST('0x' || b AS INTEGER) AS byte, count(*) AS cnt FROM (SELECT unnest(list_transform(range(length(h) // 2), lambda i: substr(h, i * 2 + 1, 2))) AS b FROM h) GROUP BY b""")
def byte_counts(spark, sf_dir):
    return L.byte_counts(table(spark, sf_dir, "documents"))


def _templates(source: str) -> str:
    return rf"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM {source})
SELECT regexp_replace(line, '{L.VARIABLES}', '{{}}', 'g') AS template, count(*) AS cnt, CAST(max(len(regexp_extract_all(line, '{L.VARIABLES}'))) AS INTEGER) AS vars FROM l WHERE line <> '' GROUP BY 1"""


@query(_templates("conversations"))
def log_templates(spark, sf_dir):
    return L.templates(table(spark, sf_dir, "conversations"))


@query(_templates("(SELECT html AS text FROM pages)"))
def page_templates(spark, sf_dir):
    return L.templates(table(spark, sf_dir, "pages"), "html")


@query(r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
a AS (SELECT line, regexp_replace(line, '\d{4}-\d{2}-\d{2}', chr(1), 'g') AS r1 FROM l),
b AS (SELECT *, regexp_replace(r1, '\d{2}:\d{2}:\d{2}', chr(1), 'g') AS r2 FROM a),
c AS (SELECT *, regexp_replace(r2, '\d+\.\d+\.\d+\.\d+', chr(1), 'g') AS r3 FROM b),
f AS (SELECT 'date' AS kind, unnest(regexp_extract_all(line, '\d{4}-\d{2}-\d{2}')) AS value FROM c UNION ALL
  SELECT 'time', unnest(regexp_extract_all(r1, '\d{2}:\d{2}:\d{2}')) FROM c UNION ALL
  SELECT 'ip', unnest(regexp_extract_all(r2, '\d+\.\d+\.\d+\.\d+')) FROM c UNION ALL
  SELECT 'num', unnest(regexp_extract_all(r3, '\d+(?:\.\d+)?')) FROM c)
SELECT kind, count(*) AS cnt, count(DISTINCT value) AS uniq FROM f GROUP BY kind""")
def log_field_types(spark, sf_dir):
    f = L.log_fields(table(spark, sf_dir, "documents"), "doc_id")
    return f.groupBy("kind").agg(F.count("*").alias("cnt"), F.countDistinct("value").alias("uniq"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS n_tokens FROM documents""")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query(r"""SELECT conv_id, turn, CASE WHEN length(c) <= 40 THEN c ELSE rtrim(substr(c, 1, 39)) || '…' END AS short FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM conversations)""")
def truncated_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.truncate(F.col("text"), 40).alias("short"))


@query("SELECT lang, CASE WHEN avg(CASE WHEN regexp_matches(text, '[一-鿿]') THEN 1 ELSE 0 END) > 0.5 THEN 'zh' ELSE 'en' END AS language FROM documents GROUP BY lang")
def majority_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(X.majority_language(F.regexp_like("text", F.lit(X.CJK))).alias("language"))


@query("SELECT p_brand, greatest(8.0, least(28.0, round(max(length(p_name) + 0.7 * len(regexp_extract_all(p_name, '" + X.WIDE + "'))) + 2, 1)))::DOUBLE AS width FROM part GROUP BY p_brand")
def column_widths(spark, sf_dir):
    w = F.max(X.display_width(F.col("p_name")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.greatest(F.lit(8.0), F.least(F.lit(28.0), F.round(w + 2, 1))).cast("double").alias("width"))


@query(r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS visible_chars FROM pages")
def visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(X.visible(F.col("html"))).cast("bigint").alias("visible_chars"))
