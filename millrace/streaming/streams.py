"""Streams: tool calls out of an event stream, alerts with remembered signals, windowed counts.

All of them take a DataFrame that may be streaming or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.scoring import alerts
from millrace.sources.files import load_list, save_list

EVENT = "session string, seq bigint, type string, tool string, delta string, ts timestamp"


def _step(state: tuple[str, str], kind: str, tool: str | None, delta: str | None) -> tuple[tuple[str, str], tuple[str, str] | None]:
    """A small machine: a start names a tool, deltas gather its input, a stop emits both."""
    name, text = state
    if kind == "tool_start":
        return (tool or "", ""), None
    if kind == "delta" and name:
        return (name, text + (delta or "")), None
    if kind == "tool_stop" and name:
        return ("", ""), (name, text)
    return state, None


def tool_calls_stream(events: DataFrame) -> DataFrame:
    """``session, tool, input`` of each finished tool call. State is kept by session: the name and the input so far; a session that is
    silent for an hour of event time (``ts``) is forgotten."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else ("", "")
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            now, done = _step(now, r.type, r.tool, r.delta)
            if done:
                out.append((key[0], *done))
        state.update(now)
        seen = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(out, columns=["session", "tool", "input"])

    return events.withWatermark("ts", "10 minutes").groupBy("session").applyInPandasWithState(run, "session string, tool string, input string", "name string, text string", "append", GroupStateTimeout.EventTimeTimeout)


def tool_calls(events: DataFrame) -> DataFrame:
    """The same over a table, on the JVM: a fold over each session's events in order."""
    e = events.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("seq", "type", "tool", "delta"))).alias("e"))
    start = F.struct(F.lit("").alias("name"), F.lit("").alias("text"), F.array().cast("array<struct<tool:string,input:string>>").alias("out"))

    def step(s, x):
        opens, more, stops = x["type"] == "tool_start", (x["type"] == "delta") & (s["name"] != ""), (x["type"] == "tool_stop") & (s["name"] != "")
        name = F.when(opens, F.coalesce(x["tool"], F.lit(""))).when(stops, "").otherwise(s["name"])
        text = F.when(opens | stops, "").when(more, F.concat(s["text"], F.coalesce(x["delta"], F.lit("")))).otherwise(s["text"])
        out = F.when(stops, F.concat(s["out"], F.array(F.struct(s["name"].alias("tool"), s["text"].alias("input"))))).otherwise(s["out"])
        return F.struct(name.alias("name"), text.alias("text"), out.alias("out"))

    return e.select("session", F.explode(F.aggregate("e", start, step, lambda s: s["out"])).alias("c")).select("session", "c.tool", "c.input")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window; on a stream, what is later than ``late`` is left out."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.window(time, length).alias("w"), kind).agg(F.count("*").alias("cnt"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), kind, "cnt", "total")


ITEM = "key string, target double, stop double, last_signal string, wanted boolean"


def alert_batches(path: str, sink):
    """A function for ``foreachBatch``: quotes (key, price, signal) are held against the saved watch list, alerts go to ``sink(df, batch id)``, and the
    list is saved with the new signals. A batch that runs again finds its own signals saved and gives no signal twice."""

    def run(quotes: DataFrame, batch: int) -> None:
        items = load_list(quotes.sparkSession, path, ITEM)
        latest = quotes.groupBy("key").agg(F.max_by("price", "ts").alias("price"), F.max_by("signal", "ts").alias("signal"))
        j = items.join(latest, "key", "left")
        sink(alerts(j, "key", F.col("price"), F.col("target"), F.col("stop"), F.col("signal"), F.col("last_signal"), F.col("wanted")), batch)
        save_list(j.withColumn("last_signal", F.when(F.col("wanted"), F.coalesce("signal", "last_signal")).otherwise(F.col("last_signal"))).select("key", "target", "stop", "last_signal", "wanted"), path)

    return run
