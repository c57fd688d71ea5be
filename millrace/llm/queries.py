"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, licenses, line_templates, ngram_join, packing, quality_classifier, quality_rules, secret_scan, toxicity, url_filters
from millrace.llm.tables import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source, its path is the language section of that source."""
    return quality_classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dedup(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_secret_scan, op3_url_filters, op4_toxicity, op5_quality_classifier, op6_license_scans, op7_ngram_join, op8_packing, op9_line_dedup, op10_quality_rules)
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SYMBOL_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WHITE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SHINGLES = "unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"


def _op1_sql() -> str:
    words = _SYMBOL_WORDS.format(_LOWER.format("text"))
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT item_id, {words} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, {_SHINGLES} AS s FROM d),
bs AS (SELECT DISTINCT item_id, {_SHINGLES} AS s FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM hits JOIN n USING (item_id) WHERE 100 * n_shared >= {decontaminate.THRESHOLD} * n_item"""


def _spans_sql(pattern: str, kind: str, where: str = "true") -> str:
    """r, start, end and text of all leftmost non-overlapping matches in ``d.t``: positions are lengths of what a split and an extraction give."""
    return f"""SELECT r, '{kind}' AS kind, s, s + length(m) AS e, m FROM (SELECT r, m[i] AS m,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d))) WHERE {where}"""


def _op2_sql() -> str:
    x = secret_scan
    assign = x.ASSIGN.replace("'", "''")
    encoding = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p, _ in x.ENCODINGS)
    null = [" ".join(f"WHEN '{n}' THEN {v[i]}::DOUBLE" for n, v in x.NULL.items()) for i in range(3)]
    alphabet = " ".join(f"WHEN '{n}' THEN '{a}'" for n, _, a in x.ENCODINGS)
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(x.KINDS))
    pairs = "range(1, CAST(n AS BIGINT))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans_sql(assign, "assign", f"length(regexp_extract(m, '{assign}', 2)) >= {x.ASSIGN_LEAST}")}
  UNION ALL {_spans_sql(x.ACCESS, "access")} UNION ALL {_spans_sql(x.HEX, "hex")}),
run AS ({_spans_sql("[A-Za-z0-9+/_-]{20,}={0,2}", "random", "regexp_matches(m, '[A-Za-z]')")}),
enc AS (SELECT *, CASE {encoding} END AS enc FROM (SELECT *, rtrim(m, '=') AS t FROM run)),
chars AS (SELECT *, CASE enc {alphabet} END AS alpha, length(t)::DOUBLE AS n, list_filter(string_split(t, ''), lambda c: c <> '') AS c FROM enc WHERE enc IS NOT NULL),
codes AS (SELECT *, length(alpha)::DOUBLE AS k, list_transform(c, lambda y: instr(alpha, y) - 1) AS x,
  CASE enc {null[0]} END AS equal, CASE enc {null[1]} END AS crossing, CASE enc {null[2]} END AS rho, n * (n - 1) / 2 AS pairs FROM chars),
sums AS (SELECT *, list_sum(list_transform(list_distinct(c), lambda y: pow(len(list_filter(c, lambda w: w = y)), 2))) AS squares,
  coalesce(list_sum(list_transform({pairs}, lambda i: CASE WHEN (x[i] * 2 >= k) <> (x[i + 1] * 2 >= k) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 0) AS above,
  list_sum(list_transform(x, lambda a: (a - (k - 1) / 2) * (a - (k - 1) / 2))) AS spread,
  list_sum(list_transform({pairs}, lambda i: (x[i] - (k - 1) / 2) * (x[i + 1] - (k - 1) / 2))) AS products FROM codes),
tests AS (SELECT *, (squares * k / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS chi, (above - (n - 1) / 2) / sqrt((n - 1) / 4) AS runs, (products / spread + 1 / n) * sqrt(n) AS serial,
  ((equal * pairs - (squares - n) / 2) / sqrt(equal * (1 - equal) * pairs + 2 * pairs * (n - 2) * {x.TRIPLES}::DOUBLE) + (above - (n - 1) * crossing) / sqrt((n - 1) * crossing * (1 - crossing))
    + (rho - products / spread) * sqrt(n)) / {x.COMBINED}::DOUBLE AS z, enc || CASE WHEN n < 32 THEN ':20' WHEN n < 48 THEN ':32' WHEN n < 80 THEN ':48' ELSE ':80' END AS stratum FROM sums),
u AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS q FROM tests),
bins AS (SELECT *, CAST(CASE WHEN z > 0 THEN least({x.BINS}, floor(((z * z / 2 + 0.9189385332046727::DOUBLE) / 2.302585092994046::DOUBLE
  - log10(q * (0.319381530::DOUBLE + q * (-0.356563782::DOUBLE + q * (1.781477937::DOUBLE + q * (-1.821255978::DOUBLE + q * 1.330274429::DOUBLE)))))) * 10)) ELSE 0 END AS INTEGER) AS bin FROM u),
counts AS (SELECT stratum, bin, count(*) AS c FROM bins GROUP BY ALL),
ranked AS (SELECT stratum, bin, sum(c) OVER (PARTITION BY stratum ORDER BY bin DESC) AS rank, sum(c) OVER (PARTITION BY stratum) AS m FROM counts),
least_bin AS (SELECT stratum, min(bin) AS least FROM ranked WHERE pow(10.0::DOUBLE, -bin / 10) <= {x.RATE}::DOUBLE * rank / m GROUP BY stratum),
added AS (SELECT r, kind, s, e FROM bins JOIN least_bin USING (stratum) WHERE bin >= least AND abs(chi) < {x.REJECT} AND abs(runs) < {x.REJECT} AND abs(serial) < {x.REJECT}),
spans AS (SELECT r, kind, s, e, CASE kind {rank} END AS k FROM (SELECT r, kind, s, e FROM base UNION ALL FROM added)),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'random') AS n_random,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind <> 'random') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM d LEFT JOIN g USING (r)"""


def _op3_sql() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '{r[r.index('/'):]}')" for v, r in url_filters.RULES)
    patterns = " OR ".join(f"regexp_matches(host || path, '{p}')" for _, _, p, size, _ in url_filters.compile_rules([], url_filters.PATTERNS) if not size)
    return rf"""
WITH p AS (SELECT page_id, {_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")} AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(v, rule, rh, rp) AS (VALUES {rules}),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host <> '' AND ({patterns}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (page_id)"""


def _op7_sql() -> str:
    t = ngram_join.THRESHOLD
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WHITE_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {_SHINGLES} AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {t} * (na.n + nb.n - i)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT c.doc_id, links.b FROM c JOIN links ON links.a = c.r)
SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id"""


def _op9_sql() -> str:
    w = r"\x20\x09-\x0D"
    x = line_templates
    last = f"(n - {x.DEPTH} + 1) // 2"
    path = "concat_ws(' ', n, {})"
    leaves = [
        ("array_to_string(t, ' ')", "true"),
        ("array_to_string(m, ' ')", f"list_contains(list_transform(m, lambda y: contains(y, '{x.WILDCARD}')), true)"),
        (path.format(f"array_to_string(m[{x.DEPTH} + 1:], ' ')"), f"n - {x.DEPTH} >= {x.LEAST_CONSTANT}"),
        (path.format(f"array_to_string(m[:{x.DEPTH}], ' '), '', array_to_string(m[n - {last} + 1:], ' ')"), f"{x.DEPTH} + {last} >= {x.LEAST_CONSTANT}"),
        (path.format(f"array_to_string(m[:n - {last}], ' ')"), f"n - {last} >= {x.LEAST_CONSTANT}"),
    ]
    every = " UNION ALL ".join(f"SELECT r, doc_id, i, {k} AS kind, {key} AS key FROM long_ WHERE {where}" for k, (key, where) in enumerate(leaves))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
long_ AS (SELECT r, doc_id, i, t, len(t) AS n, list_transform(t, lambda y: CASE WHEN regexp_matches(y, '[0-9@]') THEN '{x.WILDCARD}' ELSE y END) AS m
  FROM (SELECT *, regexp_extract_all(line, '[^{w}]+') AS t FROM l) WHERE len(t) >= {x.LEAST_TOKENS}),
leaf AS ({every}),
c AS (SELECT kind, key, min(doc_id) AS first FROM leaf GROUP BY kind, key HAVING count(DISTINCT doc_id) >= CASE WHEN kind = 0 THEN {x.LEAST_DOCS} ELSE {x.LEAST_DOCS_VARIABLE} END),
gone AS (SELECT DISTINCT r, i FROM leaf JOIN c USING (kind, key) WHERE doc_id IS DISTINCT FROM first),
k AS (SELECT r, count(*) AS n_lines, count(gone.i) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.i IS NULL), '') AS text
  FROM l LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, k.text AS text FROM d LEFT JOIN k USING (r)"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": _op1_sql(),
    "op2_secret_scan": _op2_sql(),
    "op3_url_filters": _op3_sql(),
    "op7_ngram_join": _op7_sql(),
    "op9_line_dedup": _op9_sql(),
}
