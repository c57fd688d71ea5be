"""Files in and out, generators, streams."""

import json
import os

from pyspark.sql import functions as F

from millrace.sources import files, generators
from millrace.streaming import streams


def test_binary_files_skip_empty_ones(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"abc")
    (tmp_path / "empty.bin").write_bytes(b"")
    assert [(r.length, bytes(r.content)) for r in files.binary_files(spark, str(tmp_path)).collect()] == [(3, b"abc")]


def test_csv_with_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, ""y"""\n2,\n')
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'x, "y"'), ("2", None)]
    lines = spark.createDataFrame([("a,b",), ("",), ('1,"x,y"',)], "line string")
    assert [r.fields for r in files.naive_csv(lines).collect()] == [["a", "b"], ["1", '"x', 'y"']]
    assert [r.fields for r in files.naive_csv(lines, quoted=True).collect()] == [["a", "b"], ["1", "x,y"]]


def test_run_tree(spark, tmp_path):
    d = tmp_path / "eval-1" / "with" / "run-3"
    d.mkdir(parents=True)
    (d / "grading.json").write_text(json.dumps({"pass_rate": 0.5, "passed": 1, "failed": 1, "total": 2, "expectations": [{"text": "t", "passed": True, "evidence": "e"}]}))
    r = files.run_tree(spark, str(tmp_path)).first()
    assert (r.eval_id, r.configuration, r.run_number, r.pass_rate, r.expectations[0].passed) == ("eval-1", "with", 3, 0.5, True)


def test_dated_library_and_pruning(spark):
    df = spark.createDataFrame([("/x/2024-02-01-b.md",), ("/x/2023-01-01-a.md",), ("/x/notes.md",)], "path string")
    lib = files.dated_library(df)
    assert [(str(r.date), r.slug) for r in lib.collect()] == [("2023-01-01", "a"), ("2024-02-01", "b")]
    assert [r.slug for r in files.prune_oldest(lib, 1).collect()] == ["a"]


def test_markdown_tree_skips_hidden_folders(spark, tmp_path):
    for p in ("a.md", "sub/b.md", ".git/c.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(p)
    assert sorted(r.text for r in files.markdown_tree(spark, str(tmp_path)).collect()) == ["a.md", "sub/b.md"]


def test_lists_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/list"
    assert files.load_list(spark, path, "k string").count() == 0
    files.save_list(spark.createDataFrame([("a",)], "k string"), path)
    files.save_list(files.load_list(spark, path, "k string").unionAll(spark.createDataFrame([("b",)], "k string")), path)
    assert sorted(r.k for r in files.load_list(spark, path, "k string").collect()) == ["a", "b"]


def test_report_is_rounded(spark, tmp_path):
    files.write_report(spark.createDataFrame([(1.234567,)], "x double"), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first().x == 1.2346


def test_generators_repeat_themselves(spark):
    for g in (generators.server_log, generators.access_log, generators.json_records, generators.csv_dump, generators.code, generators.prose):
        assert g(spark, 20).collect() == g(spark, 20).collect()
    assert {len(r.record) for r in generators.binary_records(spark, 5).collect()} == {24}


FIELDS = ("session", "seq", "type", "tool", "delta")
EVENTS = [("s", 1, "tool_start", "read", None), ("s", 2, "delta", None, "a"), ("s", 3, "delta", None, "b"), ("s", 4, "tool_stop", None, None), ("s", 5, "tool_stop", None, None), ("t", 1, "delta", None, "x"), ("t", 2, "tool_start", "run", None), ("t", 3, "tool_stop", None, None)]


def test_tool_calls_of_a_table(spark):
    got = streams.tool_calls(spark.createDataFrame(EVENTS, "session string, seq bigint, type string, tool string, delta string")).collect()
    assert sorted(tuple(r) for r in got) == [("s", "read", "ab"), ("t", "run", "")]


def test_tool_calls_of_a_stream_keep_state_between_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, part in enumerate((EVENTS[:2], EVENTS[2:])):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(FIELDS, e, strict=True)) | {"ts": f"2024-01-01 10:00:0{e[1]}"}) for e in part))
        os.utime(src / f"{k}.json", (k, k))  # files come in the order of their times
    stream = spark.readStream.schema(streams.EVENT).option("maxFilesPerTrigger", 1).json(str(src))
    q = streams.tool_calls_stream(stream).writeStream.format("memory").queryName("calls").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("calls").collect()) == [("s", "read", "ab"), ("t", "run", "")]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:55:00", "a", 2.0), ("2024-01-01 12:00:00", "b", 3.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.parquet(src)
    table = spark.read.parquet(src)
    want = sorted(tuple(r) for r in streams.windowed_counts(table).select("event_type", "cnt", "total").collect())
    stream = spark.readStream.schema(table.schema).parquet(src)
    q = streams.windowed_counts(stream).writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("win").select("event_type", "cnt", "total").collect()) == want == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_alert_batches_remember_signals(spark, tmp_path):
    path, seen = f"{tmp_path}/watch", []
    files.save_list(spark.createDataFrame([("x", 10.0, 1.0, "hold", True), ("y", None, 5.0, None, True)], streams.ITEM), path)
    run = streams.alert_batches(path, lambda df, batch: seen.extend((batch, r.key, r.alert_type) for r in df.collect()))
    quotes = spark.createDataFrame([("x", 11.0, "buy", 1), ("y", 4.0, "buy", 1)], "key string, price double, signal string, ts int")
    run(quotes, 0)
    run(quotes, 1)
    assert sorted(seen) == [(0, "x", "signal_change"), (0, "x", "target_hit"), (0, "y", "stop_hit"), (1, "x", "target_hit"), (1, "y", "stop_hit")]
