"""Streams over events end where batches do."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import events as ev

DATA = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    df = spark.read.parquet(DATA).withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)
    for i, part in enumerate(sorted(Path(path).glob("*.parquet"))):  # files are streamed in the order of their times
        os.utime(part, (1_700_000_000 + i * 10,) * 2)
    return path


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_progress_equals_batch(spark, folder, tmp_path):
    got = run(ev.progress(stream(spark, folder), ["event_type"]), "progress_t", "complete", tmp_path)
    want = ev.progress(spark.read.parquet(folder), ["event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_closed_windows_equal_batch(spark, folder, tmp_path):
    got = run(ev.windowed(stream(spark, folder), "1 day", "1 day", ["event_type"]), "windows_t", "append", tmp_path)
    want = ev.windowed(spark.read.parquet(folder), "1 day", "1 day", ["event_type"])
    last = spark.read.parquet(folder).agg(F.max("ts")).first()[0] - dt.timedelta(days=2)
    rows = set(map(tuple, got.collect()))
    assert rows <= set(map(tuple, want.collect()))
    assert {tuple(r) for r in want.collect() if r.window_start < last - dt.timedelta(days=1)} <= rows


def test_replay_drops_duplicates(spark, folder, tmp_path):
    live = stream(spark, folder)
    got = run(ev.replayed(live, stream(spark, folder), "event_id", "60 days").select("event_id"), "replay_t", "append", tmp_path)
    assert got.count() == spark.read.parquet(folder).count() == got.distinct().count()


def test_watchdog_counts_failures_in_a_row(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    ok = [False, False, True, False, False, False, False, False, False, True, False, False, False]
    rows = [("a", t0 + dt.timedelta(minutes=i), x) for i, x in enumerate(ok)] + [("b", t0, False)]
    path = str(tmp_path / "health")
    spark.createDataFrame(rows, "service string, ts timestamp, ok boolean").coalesce(1).write.parquet(path)
    df = spark.readStream.schema("service string, ts timestamp, ok boolean").parquet(path)
    got = run(ev.restarts(df, "service", failures=3), "watchdog_t", "append", tmp_path).orderBy("ts").collect()
    assert [((r.ts - t0).seconds // 60, r.restart) for r in got] == [(5, 1), (8, 2), (12, 1)] and {r.service for r in got} == {"a"}
    each = run(ev.restarts(spark.readStream.schema("service string, ts timestamp, ok boolean").parquet(path), "service"), "watchdog_e", "append", tmp_path)
    each = each.where("service = 'a'").orderBy("ts").collect()  # at each failure, five at most, anew after a success
    assert [((r.ts - t0).seconds // 60, r.restart) for r in each] == [(0, 1), (1, 2), (3, 1), (4, 2), (5, 3), (6, 4), (7, 5), (10, 1), (11, 2), (12, 3)]


def test_logs_and_messages(spark):
    logs = spark.createDataFrame([("t | INFO | engine | a | b",), ("t | ERROR | engine | x",), ("t | DEBUG | engine | x",), ("t | INFO | uvicorn.access | x",), ("t | INFO | uvicorn.error | x",), ("t | WARNING | httpx | x",), ("junk",)], "raw string")
    assert [(r.level, r.message) for r in ev.classified_logs(logs).collect()] == [("info", "a | b"), ("error", "x"), ("warn", "x")]
    shown = {"t | ERROR | x | INFO | y": "error", "a |WARNING| b": "warn", "|\tDEBUG |": "debug", "t | CRITICAL | e | x": "other", "[PIPELINE ENDED]": "sentinel", "x [PIPELINE ENDED]": "other", "": "other", "| INFO | [PIPELINE ENDED]": "info"}
    lines = spark.createDataFrame([(k,) for k in shown], "raw string")
    assert {r.raw: r.c for r in lines.select("raw", ev.line_class("raw").alias("c")).collect()} == shown
    texts = spark.createDataFrame([('{"type": "progress", "progress": 3}',), ('{"type": "other"}',), ("broken",)], "value string")
    assert [r.progress for r in ev.messages(texts).collect()] == [3]


def test_sink_gets_all_batches_then_the_end(spark, folder, tmp_path):
    seen = []
    end = spark.createDataFrame([(ev.ENDED,)], "message string")
    n = ev.run_to_end(stream(spark, folder), lambda batch, k: seen.append((k, batch.count(), batch.columns)), str(tmp_path / "sink"), end)
    assert [k for k, _, _ in seen] == list(range(n)) and sum(c for _, c, _ in seen[:-1]) == spark.read.parquet(folder).count()
    assert seen[-1] == (n - 1, 1, ["message"])


def test_lines_go_to_the_subscribers_of_their_project(spark):
    logs = spark.createDataFrame([("p", "a"), ("q", "b"), ("r", "c")], "project_id string, message string")
    subscribers = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "project_id string, subscriber int")
    assert sorted((r.subscriber, r.message) for r in ev.fan_out(logs, subscribers).collect()) == [(1, "a"), (1, "b"), (2, "a")]
