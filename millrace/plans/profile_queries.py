"""Queries over types, presence and order-dependent encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.functions.arrays import byte_values

from millrace.operators import profile as P
from millrace.operators import sequences as S
from millrace.plans.registry import Registry
from millrace.sources.tables import table

R = Registry()
query = R.query

_CONTENT = rf"""CASE WHEN t IS NULL OR t = '' THEN 'empty'
 WHEN regexp_matches(s, '^\s*[{{\[]') AND (len(regexp_extract_all(s, '{P.JSON_KEY}')) >= 3 OR json_valid(s)) THEN 'json'
 WHEN len(regexp_extract_all(s, '{P.LOG_LINE}')) >= 3 OR len(regexp_extract_all(s, '{P.ACCESS_LINE}')) >= 3 THEN 'log'
 WHEN len(string_split(s, chr(10))) >= 3 AND len(list_distinct(c)) = 1 AND c[1] >= 3 THEN 'csv'
 WHEN {" + ".join(f"CAST(contains(s, '{w}') AS INTEGER)" for w in P.CODE)} >= 2 THEN 'code'
 WHEN len(regexp_extract_all(s, '[ -~\t\n\r]')) / greatest(1, octet_length(encode(s))) > 0.85 THEN 'text' ELSE 'binary' END"""


def _content(source: str) -> str:
    return f"""WITH x AS ({source}), y AS (SELECT id, t, substr(t, 1, 8192) AS s FROM x),
z AS (SELECT *, list_transform(list_filter(string_split(s, chr(10))[1:10], lambda l: trim(l) <> ''), lambda l: length(l) - length(replace(l, ',', ''))) AS c FROM y)
SELECT id, {_CONTENT} AS kind FROM z"""


@query(_content("SELECT doc_id AS id, text AS t FROM documents"))
def content_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), P.content_type(F.col("text")).alias("kind"))


@query(_content("SELECT page_id AS id, html AS t FROM pages"))
def content_type_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), P.content_type(F.col("html")).alias("kind"))


@query(_content("SELECT event_id AS id, props AS t FROM events"))
def content_type_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), P.content_type(F.col("props")).alias("kind"))


_COLUMNS = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_day", "l_comment_key"]
_UNPIVOT = "SELECT unnest([{'column': 'l_orderkey', 'value': CAST(l_orderkey AS VARCHAR)}, {'column': 'l_linenumber', 'value': CAST(l_linenumber AS VARCHAR)}, {'column': 'l_returnflag', 'value': l_returnflag}, {'column': 'l_linestatus', 'value': l_linestatus}, {'column': 'l_day', 'value': strftime(l_shipdate, '%Y-%m-%d')}, {'column': 'l_comment_key', 'value': 'k' || l_orderkey || '-' || l_linenumber}], recursive := true) FROM lineitem"


def _types(enum_least: int, share: int, dates: bool) -> str:
    date = "WHEN bool_and(regexp_matches(value, '" + P.DATE + "')) AND count(DISTINCT value) <= count(*) // 2 THEN 'date'" if dates else ""
    return f"""WITH u AS ({_UNPIVOT}) SELECT "column", CASE WHEN bool_and(regexp_matches(value, '{P.INT}')) THEN 'int'
 WHEN bool_and(regexp_matches(value, '{P.FLOAT}')) THEN 'float' {date}
 WHEN count(DISTINCT value) <= greatest({enum_least}, count(*) // {share}) THEN 'enum' ELSE 'string' END AS kind, count(*) AS n, count(DISTINCT value) AS uniq FROM u WHERE value IS NOT NULL GROUP BY "column" """


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumns({"l_day": F.date_format("l_shipdate", "yyyy-MM-dd"), "l_comment_key": F.concat_ws("-", F.concat(F.lit("k"), "l_orderkey"), "l_linenumber")})


@query(_types(50, 3, True))
def column_profile_csv(spark, sf_dir):
    return P.column_types(_lineitem(spark, sf_dir), _COLUMNS)


@query(_types(20, 5, False))
def column_profile_all_values(spark, sf_dir):
    return P.column_types(_lineitem(spark, sf_dir), _COLUMNS, enum_least=20, enum_share=5, dates=False)


@query(r"""SELECT doc_id, coalesce(trim(text), '') = '' OR regexp_matches(trim(text), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') AS is_number FROM documents""")
def numeric_test(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.is_numeric(F.col("text")).alias("is_number"))


@query(r"""SELECT doc_id, len(list_filter(string_split(string_split(text, chr(10))[1], ','), lambda f: NOT regexp_matches(trim(f), '^[\p{L}_]+$'))) = 0 AS header FROM documents""")
def header_row(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.header_row(F.split(F.get(F.split("text", "\n"), F.lit(0)), ",")).alias("header"))


_PAIRS = "SELECT event_id, k.key AS key, k.value AS value, k.pos AS pos FROM (SELECT event_id, props, unnest(list_transform(range(1, len(json_keys(props)) + 1), lambda i: {'key': json_keys(props)[i], 'value': json_extract_string(props, '$.\"' || json_keys(props)[i] || '\"'), 'pos': i})) AS k FROM events)"


@query(rf"""WITH p AS ({_PAIRS}), t AS (SELECT key, CASE WHEN value IS NULL THEN 'null' WHEN value IN ('true', 'false') THEN 'bool' WHEN regexp_matches(value, '^-?[0-9]+$') THEN 'int' WHEN regexp_matches(value, '^-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'str' END AS type, count(*) AS n FROM p GROUP BY ALL)
SELECT key, first(type ORDER BY n DESC, type) AS type, CAST(sum(n) AS BIGINT) AS cnt FROM t GROUP BY key""")
def json_key_types(spark, sf_dir):
    return P.json_key_types(table(spark, sf_dir, "events"), "event_id", "props")


@query(f"WITH p AS ({_PAIRS}), f AS (SELECT key, min((event_id, pos)) AS seen FROM p GROUP BY key) SELECT key, CAST(row_number() OVER (ORDER BY seen, key) - 1 AS INTEGER) AS position FROM f")
def json_key_order(spark, sf_dir):
    return P.json_key_order(table(spark, sf_dir, "events"), "event_id", "props")


@query(f"WITH p AS ({_PAIRS}) SELECT key, count(value) AS present, (SELECT count(*) FROM events) - count(value) AS missing FROM p GROUP BY key HAVING count(value) > 0")
def json_presence(spark, sf_dir):
    return P.json_presence(table(spark, sf_dir, "events"), "props")


@query("WITH n AS (SELECT len(json_keys(props)) AS n, count(*) AS c FROM events GROUP BY 1) SELECT CAST(first(n ORDER BY c DESC, n) AS INTEGER) AS n_keys, max(c) / sum(c) > 0.8 AS consistent FROM n")
def consistent_records(spark, sf_dir):
    return P.consistent_records(table(spark, sf_dir, "events"), "props")


_BITS = "CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 16 THEN 4 WHEN n <= 256 THEN 8 ELSE 16 END"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", n AS n_unique, CAST({_BITS} AS INTEGER) AS bits FROM (SELECT count(DISTINCT {c}) AS n FROM {t})" for t, cs in (("orders", ["o_orderstatus", "o_orderpriority"]), ("part", ["p_brand", "p_type", "p_size"])) for c in cs))
def enum_bits(spark, sf_dir):
    return P.dictionary_bits(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]).unionByName(P.dictionary_bits(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"]))


@query("SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def enum_dictionary(spark, sf_dir):
    return P.sorted_dictionary(table(spark, sf_dir, "orders"), "o_orderpriority")


#: Line numbers repeat within an order, so that ties are broken by value.
_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_VARINT = "CASE WHEN z < 0 THEN 10 " + " ".join(f"WHEN z < {1 << (7 * k)} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"


def _delta(value: str, source: str, group: str, order: str, name: str) -> str:
    return f"""WITH d AS (SELECT {value} - coalesce(lag({value}) OVER (PARTITION BY {group} ORDER BY {order}), 0) AS d FROM {source}), z AS (SELECT xor(d << 1, d >> 63) AS z FROM (SELECT CAST(d AS BIGINT) AS d FROM d))
SELECT '{name}' AS "column", CAST(sum({_VARINT}) AS BIGINT) AS total_bytes FROM z"""


@query(_delta("l_partkey", "lineitem", "l_orderkey", _LINE_ORDER, "l_partkey").replace("xor(d << 1, d >> 63)", "CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END"))
def int_delta_varint(spark, sf_dir):
    return S.delta_bytes(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), ["l_orderkey"], _LINE_ORDER.split(", "), "l_partkey")


@query(_delta("date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE))", "orders", "o_custkey", "o_orderkey", "o_orderdate").replace("xor(d << 1, d >> 63)", "CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END"))
def date_delta(spark, sf_dir):
    return S.date_delta_bytes(table(spark, sf_dir, "orders"), "o_orderdate", ["o_custkey"], ["o_orderkey"])


@query("SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS ymd, CAST(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS INTEGER) AS sec, CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def packed_dates(spark, sf_dir):
    t = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.compact_date(t).alias("ymd"), N.second_of_day(t).alias("sec"), N.epoch_days(t.cast("date")).alias("days"))


_RUNS = "SELECT l_orderkey, l_returnflag, count(*) AS run_len FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS g FROM lineitem) GROUP BY l_orderkey, l_returnflag, g"


@query(f"SELECT l_returnflag AS flag, run_len, count(*) AS cnt FROM ({_RUNS}) GROUP BY ALL")
def rle_runs(spark, sf_dir):
    return S.runs(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey"], _LINE_ORDER.split(", ")).groupBy(F.col("l_returnflag").alias("flag"), "run_len").agg(F.count("*").alias("cnt"))


@query(f"SELECT CAST(sum(run_len) AS BIGINT) AS raw_bytes, CAST(sum(CASE WHEN run_len >= 4 THEN 4 * ceil(run_len / 65535) ELSE run_len END) AS BIGINT) AS rle_bytes FROM ({_RUNS})")
def rle_size(spark, sf_dir):
    r = S.runs(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey"], _LINE_ORDER.split(", "))
    return r.agg(F.sum("run_len").alias("raw_bytes"), F.sum(S.rle_bytes(F.col("run_len"))).cast("bigint").alias("rle_bytes"))


@query("SELECT l_orderkey, round(avg(CAST(up AS INTEGER)), 4) AS share FROM (SELECT l_orderkey, l_partkey > lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS up FROM lineitem) GROUP BY l_orderkey")
def increasing_share(spark, sf_dir):
    return S.increasing_share(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey"], _LINE_ORDER.split(", "))


@query("""WITH r AS (SELECT n_name AS name, i, substr(n_name || n_name, i, length(n_name)) AS r FROM (SELECT n_name, unnest(range(1, length(n_name) + 1)) AS i FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)))
SELECT name, string_agg(right(r, 1), '' ORDER BY r, i) AS bwt, CAST(count(*) FILTER (r < name) + 0 AS INTEGER) AS orig FROM r GROUP BY name""")
def bwt_small(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionAll(table(spark, sf_dir, "region").select("r_name"))
    last, origin = S.bwt(F.col("name"))
    return names.select("name", last.alias("bwt"), origin.alias("orig"))


@query("""WITH h AS (SELECT n_name AS name, list_transform(range(length(n_name)), lambda i: ascii(substr(n_name, i + 1, 1))) AS b FROM nation)
SELECT name, list_transform(range(len(b)), lambda i: CAST(CASE WHEN i < 2 THEN b[i + 1] ELSE ((b[i + 1] - b[i - 1]) % 256 + 256) % 256 END AS INTEGER)) AS deltas, true AS ok FROM h""")
def byte_delta(spark, sf_dir):
    v = byte_values(F.encode("n_name", "utf-8"))
    d = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), v.alias("raw"), S.byte_delta(v, 2).alias("deltas"))
    return d.select("name", "deltas", (S.undo_byte_delta(F.col("deltas"), 2) == F.col("raw")).alias("ok"))


@query("""WITH w AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) AS w FROM documents),
u AS (SELECT doc_id, unnest(w[1:len(w) - 1]) AS x FROM w), g AS (SELECT doc_id, x, count(*) AS n FROM u GROUP BY ALL),
b AS (SELECT doc_id, first(x ORDER BY n DESC, x) AS x, max(n) AS n, sum(n) AS total FROM g GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(CASE WHEN n * 2 >= total THEN x END, 0) AS INTEGER) AS width FROM documents LEFT JOIN b USING (doc_id)""")
def row_width(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.row_width(F.col("text")).alias("width"))


@query("""SELECT item_id, list_aggregate(list_transform(range(length(t) // 8 * 8), lambda i: substr(t, (i % (length(t) // 8)) * 8 + i // (length(t) // 8) + 1, 1)), 'string_agg', '') || substr(t, length(t) // 8 * 8 + 1) AS moved FROM (SELECT item_id, text AS t FROM benchmark)""")
def column_transpose(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.transpose(F.col("text"), 8).alias("moved"))


_RECORDS = "SELECT o_custkey, string_agg(printf('%08X%04X', o_orderkey, 7), '' ORDER BY o_orderkey) AS h FROM orders GROUP BY o_custkey"


@query(f"SELECT o_custkey, CAST(CASE WHEN length(h) // 12 >= 10 THEN 6 ELSE 0 END AS INTEGER) AS width FROM ({_RECORDS})")
def record_width(spark, sf_dir):
    """Records of six bytes, an increasing 32-bit key and a constant, gathered for each customer."""
    r = F.concat(F.lpad(F.hex("o_orderkey"), 8, "0"), F.lit("0007"))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", r.alias("r")))), lambda x: x["r"]), "").alias("h"))
    return g.select("o_custkey", S.record_width(F.col("h"), [6, 8, 12, 16]).cast("int").alias("width"))


_MARK = r"\b[Tt]he [a-z]+"


@query(rf"""WITH m AS (SELECT doc_id, text, string_split_regex(text, '{_MARK}') AS g, regexp_extract_all(text, '{_MARK}') AS m FROM documents),
p AS (SELECT doc_id, text, i - 1 AS seg, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m))
SELECT doc_id, CAST(seg AS INTEGER) AS seg, CAST(start AS INTEGER) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY seg), length(text)) AS INTEGER) AS "end" FROM p""")
def timeline_segments(spark, sf_dir):
    return S.segments(table(spark, sf_dir, "documents"), "doc_id", "text", _MARK)


@query("""WITH l AS (SELECT conv_id, turn * 1000 + i AS pos, line FROM (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM (SELECT conv_id, turn, role || ': ' || text AS text FROM conversations))),
t AS (SELECT *, CASE WHEN starts_with(line, 'user: ') THEN 'user' WHEN starts_with(line, 'assistant: ') THEN 'assistant' END AS who FROM l),
s AS (SELECT *, trim(CASE who WHEN 'user' THEN substr(line, 7) WHEN 'assistant' THEN substr(line, 12) ELSE line END) AS cut, count(who) OVER (PARTITION BY conv_id ORDER BY pos) AS turn_no FROM t)
SELECT conv_id, CAST(turn_no AS INTEGER) AS turn_no, max(who) AS speaker, length(trim(string_agg(cut, ' ' ORDER BY pos))) AS text_len FROM s WHERE turn_no > 0 GROUP BY conv_id, turn_no""")
def turn_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("said", F.concat_ws(": ", "role", "text"))
    lines = c.select("conv_id", "turn", F.posexplode(F.split("said", "\n")).alias("i", "line")).withColumn("pos", F.col("turn") * 1000 + F.col("i"))
    t = S.turns(lines, "conv_id", ["pos"], "line", {"user: ": "user", "assistant: ": "assistant"})
    return t.select("conv_id", "turn_no", "speaker", F.char_length("text").cast("bigint").alias("text_len"))


@query()
def reading_order(spark, sf_dir):
    """Parts as rectangles on one sheet for each brand, in reading order; a fold that SQL can't express."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") / 10).alias("top"), (F.col("p_retailprice") / 100).alias("left"))
    return S.rows_by_anchor(p, "p_brand", "top", "left", "p_partkey")


@query(rf"""SELECT name, problems FROM (SELECT p_name AS name, list_filter([CASE WHEN NOT regexp_matches(p_name, '^[a-z0-9-]+$') THEN 'not kebab-case' END, CASE WHEN regexp_matches(p_name, '^-|-$|--') THEN 'hyphens' END, CASE WHEN length(p_name) > 64 THEN 'name too long' END, CASE WHEN regexp_matches(p_type, '[<>]') THEN 'angle brackets' END], lambda x: x IS NOT NULL) AS problems FROM part)""")
def front_matter(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), P.front_matter_problems(F.col("p_name"), F.col("p_type"), F.array(F.lit("name"), F.lit("description"))).alias("problems"))
