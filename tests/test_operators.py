"""Hand-computed results, edge cases, and operators without SQL."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.functions import text as X
from millrace.operators import aggregates as A
from millrace.operators import audit as U
from millrace.operators import grams as G
from millrace.operators import lines as L
from millrace.operators import profile as P
from millrace.operators import scoring as C
from millrace.operators import search as S
from millrace.operators import sequences as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_zigzag_and_varint(spark):
    df = spark.createDataFrame([(v,) for v in (0, -1, 1, -64, 64, 2**31, -(2**63))], "v bigint")
    rows = df.select("v", N.zigzag(F.col("v")).alias("z"), N.varint_bytes(N.zigzag(F.col("v"))).alias("n"), N.unzigzag(N.zigzag(F.col("v"))).alias("b")).collect()
    assert [r.z for r in rows] == [0, 1, 2, 127, 128, 2**32, -1]
    assert [r.n for r in rows] == [1, 1, 1, 1, 2, 5, 10]
    assert all(r.v == r.b for r in rows)


@pytest.mark.parametrize(("n", "bits"), [(1, 1), (2, 1), (3, 2), (5, 4), (17, 8), (257, 16)])
def test_enum_bits(spark, n, bits):
    assert one(spark, N.enum_bits(F.lit(n))) == bits


def test_addresses_and_colours(spark):
    assert one(spark, N.ipv4(F.lit("1.2.3.4"))) == 16909060
    assert one(spark, N.ipv4(F.lit("1.2.3.400"))) is None
    assert one(spark, N.hsl_to_hex(F.lit(0), F.lit(1.0), F.lit(0.5))) == "#ff0000"
    assert one(spark, F.round(N.contrast(F.lit("#000000"), F.lit("#ffffff")), 4)) == 21.0


def test_tokens_are_unicode(spark):
    assert one(spark, X.tokens(F.lit("Große Éléphants, a_b  x-ray!"))) == ["große", "éléphants", "a_b", "ray"]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


def test_text_helpers(spark):
    assert one(spark, X.truncate(F.lit("  a  b c d e "), 5)) == "a b…"
    assert one(spark, X.blank_to_null(F.lit(" \u00a0\u200b"))) is None
    assert one(spark, X.visible(F.lit("<p>a<script>x</script> <b>b</b></p>"))) == "a b"


def test_content_types(spark):
    log = "\n".join(f"2024-01-0{k} 10:00:00 [INFO] ok" for k in range(1, 5))
    texts = {"empty": "", "json": '{"a": 1}', "log": log, "csv": "a,b,c,d\n1,2,3,4\n5,6,7,8", "code": "import os\nclass A:\n  pass", "text": "hello there", "binary": "\x01\x02\x03"}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()] + [("empty", None)], "want string, t string")
    assert all(r.want == r.got for r in df.select("want", P.content_type(F.col("t")).alias("got")).collect())


def test_column_types(spark):
    df = spark.createDataFrame([(str(i), f"{i}.5", "2024-01-01", "ab"[i % 2], None) for i in range(300)], "i string, f string, d string, e string, n string")
    got = {r.column: r.kind for r in P.column_types(df, ["i", "f", "d", "e", "n"]).collect()}
    assert got == {"i": "int", "f": "float", "d": "date", "e": "enum"}


def test_json_presence_counts_null_as_missing(spark):
    df = spark.createDataFrame([('{"a":1,"b":null}',), ('{"a":2}',), (None,)], "j string")
    assert [tuple(r) for r in P.json_presence(df, "j").collect()] == [("a", 2, 1)]


def test_bwt_of_known_words(spark):
    df = spark.createDataFrame([("banana",), ("abracadabra",), ("a",), ("",)], "s string")
    last, row = Q.bwt(F.col("s"))
    assert [(r.l, r.o) for r in df.select(last.alias("l"), row.alias("o")).collect()] == [("nnbaaa", 3), ("rdarcaaaabb", 2), ("a", 0), ("", 0)]


def test_reading_order_compares_with_the_anchor(spark):
    df = spark.createDataFrame([(1, 0.0, 9.0, 1), (1, 0.4, 5.0, 2), (1, 0.8, 1.0, 3), (1, 5.0, 0.0, 4)], "g int, top double, left double, k bigint")
    rows = Q.rows_by_anchor(df, "g", "top", "left", "k").orderBy("position").collect()
    assert [(r.row, r.k) for r in rows] == [(1, 2), (1, 1), (2, 3), (3, 4)]


def test_turns_drop_what_comes_before_the_first(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(["noise", "A: hi", "more", "B: yes"])], "g int, n int, line string")
    rows = Q.turns(df, "g", ["n"], "line", {"A: ": "a", "B: ": "b"}).orderBy("turn_no").collect()
    assert [(r.turn_no, r.speaker, r.text) for r in rows] == [(1, "a", "hi more"), (2, "b", "yes")]


def test_line_dictionary_round_trip_with_nulls(spark):
    df = spark.createDataFrame([(1, "same line\nx\nsame line"), (2, ""), (3, "same line")], "doc_id bigint, text string")
    d = L.line_dictionary(df)
    assert [(r.line, r.cnt, r.idx) for r in d.collect()] == [("same line", 3, 0)]
    back = {r.doc_id: r.text for r in L.decode_references(L.encode_references(df, d), d).collect()}
    assert back == {1: "same line\nx\nsame line", 2: "", 3: "same line"}


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 0), ("abc", "abd", 3), ("abc", "ab", 3), ("", "x", 1), ("x", "y", 1)])
def test_first_difference(spark, a, b, want):
    assert one(spark, L.first_difference(F.lit(a), F.lit(b))) == want


def test_bm25_counts_repeated_query_words_again(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple apple"), (3, None), (4, "cherry tree")], "doc_id bigint, text string")
    q = spark.createDataFrame([("apple",), ("apple apple",), ("missing",)], "query string")
    got = {(r.query, r.doc_id): r.score for r in S.bm25(docs, q).collect()}
    assert set(k for _, k in got) == {1, 2}
    assert got["apple apple", 2] == pytest.approx(2 * got["apple", 2], abs=1e-5)


def test_rule_cascade_precedence(spark):
    rules = spark.createDataFrame([(1, "blue sky"), (2, "sky"), (3, "deep-sea")], "no int, rule string")
    keys = spark.createDataFrame([("Sky",), ("night sky",), ("sea",), ("a sea view",), ("none",), (None,)], "key string")
    got = {r.key: (r.rule, r.priority) for r in S.rule_cascade(keys, "key", rules, "rule", "no").collect()}
    assert got == {"Sky": ("sky", 1), "night sky": ("sky", 2), "sea": ("deep-sea", 2), "a sea view": ("deep-sea", 3), "none": (None, 4), None: (None, 4)}


def test_intent_leaves_neutral_at_a_tie(spark):
    words = {"neutral": ["report"], "calm": ["health"]}
    df = spark.createDataFrame([("health report",), ("report",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(S.intent(F.col("t"), words).alias("x")).collect()] == ["calm", "neutral", "neutral", "neutral"]


def test_safety_score_bounds(spark):
    df = spark.createDataFrame([(30.0, 12.0, 30, 3.0), (90.0, -1.0, 1, 9.0), (None, None, None, None)], "p double, g double, y int, d double")
    score, factors = C.safety(F.col("p"), F.col("g"), F.col("y"), F.col("d"))
    assert [r.s for r in df.select(score.alias("s")).collect()] == [100, 5, 50]
    assert df.select(F.size(factors).alias("n")).collect()[2].n == 0


def test_impact_is_capped(spark):
    assert one(spark, C.impact(F.lit("ma"), F.lit("BREAKING news"), F.lit(True))) == 10
    assert one(spark, C.impact(F.lit("other"), F.lit("calm"), F.lit(False))) == 2


def test_verdict_patterns(spark):
    assert one(spark, C.verdict(F.lit("核心结论：🟢 买入"))) == "买入"
    assert one(spark, C.verdict(F.lit("nothing"))) == "观望"


def test_confusion_defaults(spark):
    empty = spark.createDataFrame([], "a boolean, p boolean")
    r = A.confusion(empty, F.col("a"), F.col("p")).first()
    assert (r.precision, r.recall, r.accuracy, r.tp) == (1.0, 1.0, 0.0, 0)


def test_split_takes_at_least_one_of_each_class(spark):
    df = spark.createDataFrame([(k, "big") for k in range(50)] + [(99, "small")], "k bigint, c string")
    got = A.stratified_split(df, "k", "c", 0.1).where("split = 'test'").groupBy("c").count().collect()
    assert {r.c: r["count"] for r in got} == {"big": 5, "small": 1}


def test_pivot_treats_null_keys_as_a_name(spark):
    df = spark.createDataFrame([(None, "x", 1.0), ("a", "y", 2.0), ("a", None, None)], "r string, c string, v double")
    assert sorted(tuple(r) for r in A.pivot_flat(df, ["r"], [("v", "sum")]).collect()) == [("None", 1.0), ("a", 2.0)]
    assert sorted(tuple(r) for r in A.pivot_cross(df, ["r"], "c", "v", "sum").collect()) == [("None", 1.0, 0.0), ("a", 0.0, 2.0)]


def test_upsert_overwrites_only_what_is_given(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "k string, v int, n string")
    new = spark.createDataFrame([("A", None, "new"), ("d", 4, None)], "k string, v int, n string")
    gone = spark.createDataFrame([("C",)], "k string")
    assert sorted(tuple(r) for r in A.upsert(old, new, "k", ["v", "n"], gone).collect()) == [("A", 1, "new", "updated"), ("B", 2, "y", "kept"), ("D", 4, None, "added")]


def test_ranges(spark):
    df = spark.createDataFrame([("'My Sheet'!B2:AA10",), ("C3",), ("A1:ZZ99",)], "r string")
    rows = df.select(U.parse_range(F.col("r")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in rows] == [("My Sheet", 2, 2, 27, 10), (None, 3, 3, 3, 3), (None, 1, 1, 702, 99)]
    letters = spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 702, 703)], "n int").select(U.column_letters(F.col("n")).alias("x")).collect()
    assert [r.x for r in letters] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]


def test_page_ranges(spark):
    df = spark.createDataFrame([(1, "1-3,5,2"), (2, "9"), (3, "x"), (4, None)], "k int, s string")
    got = sorted(tuple(r) for r in U.page_indexes(df, "k", "s", F.lit(6)).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 4)]


def test_fuzzy_pairs_equal_all_pairs(spark):
    a = ["Introduction", "The End", "abc", "", "Überblick"]
    b = ["intro", "Introductions", "end", "bca", "xyz", "überblick 2"]
    got = {(r.a, r.b) for r in S.fuzzy_pairs(spark.createDataFrame([(x,) for x in a], "x string"), spark.createDataFrame([(y,) for y in b], "y string"), "x", "y").collect()}

    def similar(x, y):
        x, y = x.strip().lower(), y.strip().lower()
        return bool(x and y) and (x in y or y in x or len(set(x) & set(y)) / len(set(x) | set(y)) > 0.6)

    assert got == {(x, y) for x in a for y in b if similar(x, y)}


def test_overlaps_across_cells(spark):
    rows = [(1, k, (k * 7 % 10) / 2, (k * 3 % 10) / 2, 1.3, 0.9) for k in range(20)]
    df = spark.createDataFrame(rows, "g int, k int, left double, top double, width double, height double")
    want = set()
    for a in rows:
        for b in rows:
            w, h = min(a[2], b[2]) + 1.3 - max(a[2], b[2]), min(a[3], b[3]) + 0.9 - max(a[3], b[3])
            if a[1] < b[1] and w > 0.05 and h > 0.05:
                want.add((a[1], b[1]))
    assert {(r.a, r.b) for r in S.overlaps(df, "g", "k", 0.7).collect()} == want


def test_json_source_with_envelope(spark, tmp_path):
    from millrace.sources import files

    (tmp_path / "x.json").write_text(json.dumps({"records": [{"a": 1}, {"a": 2}], "total": 2}))
    assert [r.a for r in files.json_records(spark, str(tmp_path), "a int", "records", lines=False).collect()] == [1, 2]


def test_fuzzy_pairs_are_no_product(spark):
    from millrace.operators import search as S

    names = spark.createDataFrame([(f"{a} {b} no {i}",) for i, (a, b) in enumerate((a, b) for a in ("steel", "copper", "brass", "nickel", "tin") for b in ("plate", "wheel", "box", "jug", "drum", "zip"))], "x string")
    plan = S.fuzzy_pairs(names, names, "x", "x")
    plan.collect()
    joins = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joins and "BroadcastNestedLoopJoin" not in joins


def test_positions_span_ranges_and_hold_ties_nulls_and_empty_tables(spark):
    from millrace.operators.ranking import numbered

    rows = [(i * 7919 % 101, f"k{i}") for i in range(500)] + [(None, "none"), (None, None)]
    d = spark.createDataFrame(rows, "a int, b string")
    for bounds in (1, 5, 200):
        got = {(r.a, r.b): r.p for r in numbered(d, ["a", "b"], "p", bounds).collect()}
        wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        assert got == {r: i for i, r in enumerate(wanted)}
    assert numbered(d.where("false"), ["a", "b"], "p").count() == 0
    same = spark.createDataFrame([(1,)] * 5, "a int")
    assert sorted(r.p for r in numbered(same, ["a"], "p").collect()) == [0, 1, 2, 3, 4]


def test_names_of_several_words_keep_what_lies_between(spark):
    from millrace.operators.audit import mentions

    docs = spark.createDataFrame([(1, "Anna Maria went home."), (2, "anna  maria"), (3, "Annabel met O'Brien"), (4, None), (5, ""), (6, "anna maria, ANNA maria")], "id int, t string")
    names = spark.createDataFrame([("Anna",), ("Anna Maria",), (" O'Brien ",), ("...",), (None,)], "name string")
    got = sorted((r.id, r.name.strip()) for r in mentions(docs, "id", "t", names, "name").collect())
    assert got == [(1, "Anna"), (1, "Anna Maria"), (2, "Anna"), (3, "O'Brien"), (6, "Anna"), (6, "Anna Maria")]
    assert mentions(docs, "id", "t", names.where("false"), "name").count() == 0


def test_nested_json_of_odd_rows(spark):
    from millrace.operators import nested

    d = spark.createDataFrame([(1, "{}"), (2, "[1,[2,{\"a\":[]}]]"), (3, "no json {"), (4, None), (5, "7"), (6, '{"a":{"b":{"c":{"d":"}{"}}}}')], "id int, j string")
    got = sorted((r.row, r.path, r.value) for r in nested.leaves(d, "id", "j").collect())
    assert got == [(2, "$[0]", "1"), (2, "$[1][0]", "2"), (5, "$", "7"), (6, "$.a.b.c.d", "}{")]
    assert nested.short_names(d, "j") == {"a": "K00", "b": "K01", "c": "K02", "d": "K03"}
    renamed = {r.id: r.x for r in d.select("id", nested.rename(d, "j", {"a": "x", "d": "y"}).alias("x")).collect()}
    assert renamed == {1: "{}", 2: '[1,[2,{"x":[]}]]', 3: "no json {", 4: None, 5: "7", 6: '{"x":{"b":{"c":{"y":"}{"}}}}'}


def test_story_of_odd_texts(spark):
    from millrace.operators import story

    d = spark.createDataFrame([(1, None), (2, "plain"), (3, "## Second\n# First one \n**POV:** Ann & Bob and Cy, Ann\n**When:** noon")], "id int, t string")
    got = {r.id: (r.timepoint, r.chapter, r.characters) for r in story.events(d, "id", "t").collect()}
    assert got == {1: ("Unspecified", "Unknown", []), 2: ("Unspecified", "Unknown", []), 3: ("noon", "First one", ["Ann", "Bob", "Cy"])}


def test_overrides_without_results_fall_back(spark):
    from millrace.functions.vocabularies import GENERIC_ADVICE, LAYOUT_ELSE, LAYOUTS
    from millrace.operators.search import overrides

    rows = [("a", "ux", 1, {"category": "Touch", "do": "", "dont": ""}), ("b", "style", 1, {"keywords": "Bold", "effects": "fade"}), ("b", "ux", 2, {"category": "Y", "do": "y", "dont": "n"}), ("b", "ux", 1, {"category": "X", "do": "x"})]
    d = spark.createDataFrame(rows, "page string, domain string, rank int, fields map<string,string>")
    got = {r.page: r for r in overrides(d, "page", LAYOUTS, LAYOUT_ELSE, GENERIC_ADVICE).collect()}
    assert (got["a"].width, got["a"].layout, got["a"].recommendations, got["a"].avoid) == ("1200px", "Responsive grid", GENERIC_ADVICE, [])
    assert (got["b"].width, got["b"].density, got["b"].recommendations, got["b"].avoid) == ("1200px (standard)", None, ["Effects: fade", "X: x", "Y: y"], ["Avoid: n"])


def _substrings(texts, most, lengths=(8, 16, 32, 64, 128)):
    seen = Counter((t[i : i + n], n) for t in texts if t for n in lengths for i in range(0, len(t) - n + 1, n // 4))
    cnt = {(g, n, k): 1 + (k - 1) * (n // 4) for (g, n), k in seen.items() if k > 1}
    rows = [(g, n, k, c, c * (n - 3) - (n + 6)) for (g, n, k), c in cnt.items()]
    return sorted((r for r in rows if r[4] > 0), key=lambda r: (-r[4], r[0].encode()))[:most]


@pytest.mark.parametrize("most", [1, 7, 60, 100_000])
@pytest.mark.parametrize("buckets", [12, 22])
def test_sampled_substrings_are_exact_with_any_sketch(spark, monkeypatch, most, buckets):
    """With 4,096 buckets most substrings share theirs, and a second round is needed."""
    monkeypatch.setattr(G, "layout", lambda strides, layout=G.layout: layout(strides, buckets))
    rounds, counts = [], G.counts
    monkeypatch.setattr(G, "counts", lambda docs, text, lengths, chosen: rounds.append(int(chosen.sum())) or counts(docs, text, lengths, chosen))
    rng = random.Random(5)
    made = ["".join(rng.choices("abcdeé–テ😀\n ", k=rng.randrange(900))) for _ in range(60)]
    texts = [None, "", "seven c", "8 chars!", "8 chars!", "é" * 200, "é" * 200, "😀テ" * 80, *made, *made[:20], *[m[k:] for k, m in enumerate(made[:9])], "a\x00b\n" * 70]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert [tuple(r) for r in L.sampled_substrings(docs, most=most).collect()] == _substrings(texts, most)
    assert len(rounds) == 2 if (buckets, most) == (12, 60) else rounds


def test_sampled_substrings_of_nothing(spark):
    for rows in ([], [(None,)], [("no repeats at all",)]):
        assert L.sampled_substrings(spark.createDataFrame(rows, "text string")).collect() == []


def test_sampled_substrings_shuffle_few_of_the_substrings(spark):
    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    rng = random.Random(6)
    common = ["".join(rng.choices("abcdefghijklmnop", k=200)) for _ in range(20)]
    texts = ["".join(rng.choices("abcdefghijklmnop", k=4000)) + "".join(common) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    before = shuffled()
    got = [tuple(r) for r in L.sampled_substrings(docs, most=50).collect()]
    written = shuffled() - before
    assert got == _substrings(texts, 50)
    assert 0 < written < 2 * sum(map(len, texts)), written
