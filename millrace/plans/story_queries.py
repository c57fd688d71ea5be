"""Queries over names of several words, timelines, nested JSON, caps of reports, rankings and page overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.vocabularies import GENERIC_ADVICE, LAYOUT_ELSE, LAYOUTS, PAGE_TYPES, PAGE_TYPES_BY_STYLE
from millrace.operators import audit as U
from millrace.operators import lines as L
from millrace.operators import nested as J
from millrace.operators import ranking as K
from millrace.operators import scoring as C
from millrace.operators import search as S
from millrace.operators import story as T
from millrace.plans.registry import Registry
from millrace.plans.rule_queries import _CELLS, _cells
from millrace.sources.tables import table

R = Registry()
query = R.query

_NAMES = ["License", "All Rights Reserved", "general public license", "cc by", "of the"]


@query(f"SELECT DISTINCT doc_id, name FROM documents, (VALUES {', '.join(f'({n!r})' for n in _NAMES)}) v(name) WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || lower(name) || '($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')")
def phrase_mentions(spark, sf_dir):
    """Names of one and of several words in whole texts."""
    return U.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", spark.createDataFrame([(n,) for n in _NAMES], "name string"), "name")


_STORY = """SELECT event_id, '# Chapter ' || user_id % 7 || chr(10) || '**Time:** Day ' || user_id % 5 || chr(10) || '**Characters:** ' || event_type || ', u' || user_id % 3 || ' and me' || chr(10) || (event_id % 9) || ' days later' AS text FROM events"""


def _story(spark, sf_dir):
    n = lambda c, k: (F.col(c) % k).cast("string")
    text = F.concat(F.lit("# Chapter "), n("user_id", 7), F.lit("\n**Time:** Day "), n("user_id", 5), F.lit("\n**Characters:** "), F.col("event_type"), F.lit(", u"), n("user_id", 3), F.lit(" and me\n"), n("event_id", 9), F.lit(" days later"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query("""WITH e AS (SELECT event_id, user_id % 7 AS c, user_id % 5 AS d, event_id % 9 AS l FROM events),
m AS (SELECT 0 AS kind, 'Day ' || d AS marker FROM e UNION ALL SELECT 1, l || ' days later' FROM e UNION ALL SELECT 3, 'Chapter ' || c FROM e UNION ALL SELECT 4, '**Time:** Day ' || d FROM e)
SELECT kind, marker, count(*) AS cnt FROM m GROUP BY ALL""")
def time_markers(spark, sf_dir):
    s = _story(spark, sf_dir).select(F.explode(T.time_markers(F.col("text"))).alias("m"))
    return s.groupBy("m.kind", "m.marker").agg(F.count("*").alias("cnt"))


@query("""WITH e AS (SELECT event_id, 'Chapter ' || user_id % 7 AS chapter, 'Day ' || user_id % 5 AS timepoint, [event_type, 'u' || user_id % 3, 'me'] AS who FROM events), c AS (SELECT *, unnest(who) AS character FROM e)
SELECT 'chapter' AS kind, chapter AS name, count(*) AS cnt, min(event_id) AS first_event, 3 AS most_characters FROM e GROUP BY ALL UNION ALL SELECT 'timepoint', timepoint, count(*), min(event_id), 3 FROM e GROUP BY ALL
UNION ALL SELECT 'character', character, count(*), min(event_id), 3 FROM c GROUP BY ALL""")
def story_groups(spark, sf_dir):
    """Events by chapter, by time and by character, read out of texts."""
    e = T.events(_story(spark, sf_dir), "event_id", "text")
    parts = [T.group_events(e, "event_id", by).select(F.lit(by).alias("kind"), F.col(by).alias("name"), "cnt", "first_event", "most_characters") for by in ("chapter", "timepoint", "character")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_NESTED = """SELECT event_id, '{"id":' || event_id || ',"who":{"user":' || user_id || ',"seen:at":"x\\"k\\": ' || event_type || '"},"tags":[{"k":' || event_id % 3 || '},null,["' || event_type || '",{}]]}' AS j FROM events"""


def _nested(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    j = F.concat(F.lit('{"id":'), s("event_id"), F.lit(',"who":{"user":'), s("user_id"), F.lit(',"seen:at":"x\\"k\\": '), s("event_type"), F.lit('"},"tags":[{"k":'), (F.col("event_id") % 3).cast("string"), F.lit('},null,["'), s("event_type"), F.lit('",{}]]}'))
    return table(spark, sf_dir, "events").select("event_id", j.alias("j"))


@query(f"WITH e AS ({_NESTED}) SELECT key, count(*) AS rows FROM (SELECT unnest(['id', 'who', 'user', 'seen:at', 'tags', 'k']) AS key FROM e WHERE j IS NOT NULL) GROUP BY key")
def nested_keys(spark, sf_dir):
    """Keys at any depth; a string that holds a quote and a colon isn't one."""
    return J.key_counts(_nested(spark, sf_dir), "j")


@query("""SELECT event_id AS row, unnest(['$.id', '$.who.user', '$.who.seen:at', '$.tags[0].k', '$.tags[1]', '$.tags[2][0]']) AS path,
unnest([CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), 'x"k": ' || event_type, CAST(event_id % 3 AS VARCHAR), NULL, event_type]) AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL""")
def nested_leaves(spark, sf_dir):
    return J.leaves(_nested(spark, sf_dir), "event_id", "j")


@query(f"""WITH e AS ({_NESTED}) SELECT event_id, '{{"K00":' || json_extract_string(j, '$.id') || ',"K05":{{"K04":' || json_extract_string(j, '$.who.user') || ',"K02":' || CAST(json_extract(j, '$.who."seen:at"') AS VARCHAR) || '}},"K03":[{{"K01":' || json_extract_string(j, '$.tags[0].k') || '}},null,' || CAST(json_extract(j, '$.tags[2]') AS VARCHAR) || ']}}' AS renamed FROM e""")
def nested_short_keys(spark, sf_dir):
    d = _nested(spark, sf_dir)
    return d.select("event_id", J.rename(d, "j", J.short_names(d, "j")).alias("renamed"))


@query(f"""WITH c AS ({_CELLS}), f AS (SELECT 'error' AS kind, sheet, "row", col FROM c WHERE formula IS NOT NULL AND contains(value, '#REF!') UNION ALL SELECT 'zero', sheet, "row", col FROM c WHERE formula IS NOT NULL AND value = '0'
UNION ALL SELECT 'implicit_array', sheet, "row", col FROM c WHERE starts_with(formula, '=MATCH')), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sheet, "row", col) AS rank, count(*) OVER (PARTITION BY kind) AS total FROM f)
SELECT kind, sheet, "row", col, CAST(rank AS INTEGER) AS rank, total FROM r WHERE rank <= CASE kind WHEN 'error' THEN 50 WHEN 'zero' THEN 30 ELSE 20 END""")
def capped_findings(spark, sf_dir):
    """The report of a formula audit: so many findings of each kind, and how many there are."""
    f = U.formula_audit(_cells(spark, sf_dir)).select(F.when(F.startswith("finding", F.lit("#")), "error").otherwise(F.col("finding")).alias("kind"), "sheet", "row", "col")
    return K.capped(f, "kind", ["sheet", "row", "col"], {"error": 50, "zero": 30, "implicit_array": 20}, 60)


@query("""WITH s AS (SELECT event_id, CAST(least(10, 1 + [5, 4, 3, 3, 2, 1][user_id % 6 + 1] + CASE WHEN value > 50 THEN 2 ELSE 0 END) AS INTEGER) AS score FROM events)
SELECT event_id, score, row_number() OVER (ORDER BY score DESC, event_id) - 1 AS position FROM s""")
def impact_ranking(spark, sf_dir):
    """All rumors by impact, ranked by ranges instead of in one task."""
    kinds = F.array(*map(F.lit, ["ma", "insider", "analyst", "regulatory", "earnings", "other"]))
    e = table(spark, sf_dir, "events").select("event_id", C.impact(F.get(kinds, (F.col("user_id") % 6).cast("int")), F.lit(""), F.coalesce(F.col("value") > 50, F.lit(False))).alias("score"))
    return C.ranked_rumors(e, "event_id", "score")


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS entry FROM documents), w1 AS (SELECT entry, count(*) AS cnt FROM w WHERE length(entry) >= 3 GROUP BY entry ORDER BY cnt DESC, entry LIMIT 2000),
l AS (SELECT regexp_extract_all(text, '[A-Za-z]+') AS l FROM documents), b AS (SELECT unnest(list_zip(l[:-2], l[2:])) AS p FROM l WHERE len(l) > 1), b1 AS (SELECT p[1] || ' ' || p[2] AS entry, count(*) AS cnt FROM b GROUP BY 1 ORDER BY cnt DESC, entry LIMIT 500)
SELECT entry, cnt, cnt * (length(entry) - 2) AS saving FROM (SELECT * FROM w1 UNION ALL SELECT * FROM b1) ORDER BY saving DESC, entry LIMIT 250""")
def mixed_dictionary(spark, sf_dir):
    return L.mixed_dictionary(table(spark, sf_dir, "documents"))


_STYLE_SQL = "CASE WHEN p_type LIKE '%BRASS%' THEN 'Data-dense dashboards' WHEN p_type LIKE '%STEEL%' THEN 'Landing pages' ELSE 'anything' END"


@query("SELECT p_partkey, coalesce(CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(p_name), '{w}')" for w in ws) + f" THEN '{r}'" for ws, r in PAGE_TYPES) + " END, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(style), '{w}')" for w in ws) + f" THEN '{r}'" for ws, r in PAGE_TYPES_BY_STYLE) + f" ELSE 'General' END) AS page_type FROM (SELECT *, {_STYLE_SQL} AS style FROM part)")
def page_type_by_style(spark, sf_dir):
    style = F.when(F.contains("p_type", F.lit("BRASS")), "Data-dense dashboards").when(F.contains("p_type", F.lit("STEEL")), "Landing pages").otherwise("anything")
    return table(spark, sf_dir, "part").select("p_partkey", S.page_type(F.col("p_name"), style, PAGE_TYPES, PAGE_TYPES_BY_STYLE).alias("page_type"))


_ADVICE = ", ".join(f"'{a}'" for a in GENERIC_ADVICE)


def _laid(field: int) -> str:
    values = [layout[1 + field] for layout in LAYOUTS]
    last = "NULL" if LAYOUT_ELSE[field] is None else f"'{LAYOUT_ELSE[field]}'"
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(kw, '{w}')" for w in ws) + f" THEN '{v}'" for (ws, *_), v in zip(LAYOUTS, values, strict=True)) + f" ELSE {last} END"


@query(f"""WITH p AS (SELECT p_partkey AS page, CASE WHEN p_size % 3 = 0 THEN 'dense ' WHEN p_size % 3 = 1 THEN 'clean ' ELSE '' END || lower(p_type) AS kw, p_size % 5 <> 0 AS has_style, p_size % 2 = 0 AS has_landing, p_name, p_brand, p_type FROM part)
SELECT page, CASE WHEN has_style THEN {_laid(0)} WHEN has_landing THEN NULL ELSE '1200px' END AS width, CASE WHEN has_style THEN {_laid(1)} WHEN has_landing THEN NULL ELSE 'Responsive grid' END AS layout, CASE WHEN has_style THEN {_laid(2)} END AS density,
CASE WHEN has_landing THEN p_type END AS sections, CASE WHEN has_landing THEN p_brand END AS colors,
list_concat(CASE WHEN has_style THEN ['Effects: ' || p_brand] ELSE [] END, ['size: ' || p_name], CASE WHEN has_landing THEN ['CTA Placement: ' || p_name] ELSE [] END) AS recommendations, ['Avoid: ' || p_type] AS avoid FROM p""")
def page_overrides(spark, sf_dir):
    """Overrides of pages from three domains' results."""
    p = table(spark, sf_dir, "part").withColumn("page", F.col("p_partkey"))
    kw = F.concat(F.when(F.col("p_size") % 3 == 0, "dense ").when(F.col("p_size") % 3 == 1, "clean ").otherwise(""), F.lower("p_type"))
    row = lambda domain, fields: p.select("page", "p_size", F.lit(domain).alias("domain"), F.lit(1).alias("rank"), F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v))).alias("fields"))
    style = row("style", {"keywords": kw, "effects": F.col("p_brand")}).where("p_size % 5 <> 0")
    ux = row("ux", {"category": F.lit("size"), "do": F.col("p_name"), "dont": F.col("p_type")})
    landing = row("landing", {"sections": F.col("p_type"), "cta": F.col("p_name"), "colors": F.col("p_brand")}).where("p_size % 2 = 0")
    return S.overrides(style.unionAll(ux).unionAll(landing), "page", LAYOUTS, LAYOUT_ELSE, GENERIC_ADVICE)
