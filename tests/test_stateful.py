"""Stateful streams equal their batches however they are cut; sinks take each batch once."""

import datetime as dt
import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import sinks
from quillspark.streaming import stateful as st


@pytest.fixture(autouse=True)
def rocksdb(spark):
    with st.use_rocksdb(spark):
        yield


def files(spark, path, parts, schema):
    """A folder with a file for each part, read one a batch in that order."""
    for i, rows in enumerate(parts):
        out = f"{path}/tmp{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(out)
        part = next(Path(out).glob("*.parquet"))
        (Path(path) / "in").mkdir(exist_ok=True)
        target = Path(path) / "in" / f"f{i}.parquet"
        part.rename(target)
        os.utime(target, (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(df, name, mode, path, expected=None):
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/cp-{name}")
    if expected:  # timers of processing time keep a query going that takes what is available
        q = writer.trigger(processingTime="100 milliseconds").start()
        until, seen = time.time() + 100, 0
        while seen < expected and time.time() < until:
            time.sleep(0.3)
            seen = sum({p["batchId"]: p["numInputRows"] for p in q.recentProgress}.values())
        q.stop()
        assert seen == expected
    else:
        assert writer.trigger(availableNow=True).start().awaitTermination(200)
    return df.sparkSession.table(name)


LOGS = "project_id string, seq long, line string"


def cut(rows, seed):
    rnd, out = random.Random(seed), []
    rows = list(rows)
    while rows:
        n = rnd.randint(1, len(rows))
        out.append(rows[:n])
        rows = rows[n:]
    return out


@pytest.mark.parametrize("seed", [2])
def test_ring_equals_batch_after_any_cut(spark, tmp_path, seed):
    rows = [("hot" if i % 3 else f"p{i % 5}", i, f"line {i}") for i in range(400)] + [("p1", None, "x"), (None, 7, "no project")]
    parts = [random.Random(i).sample(p, len(p)) for i, p in enumerate(cut(rows, seed))]
    got = run(st.log_ring(files(spark, str(tmp_path), parts, LOGS), size=50), f"ring{seed}", "update", tmp_path, expected=len(rows))
    rings = {}
    for r in got.where("kind = 'lines'").orderBy("last_seq").collect():
        rings[r.project_id] = [(x.seq, x.line) for x in r.lines]
    want = {}
    for r in st.last_lines(spark.createDataFrame([x for x in rows if x[1] is not None], LOGS), 50).orderBy("seq").collect():
        want.setdefault(r.project_id, []).append((r.seq, r.line))
    assert rings == want and len(want["hot"]) == 50


def test_silence_makes_a_heartbeat(spark, tmp_path):
    ring = st.log_ring(files(spark, str(tmp_path), [[("p", 1, "a"), ("p", 2, "b")]], LOGS), heartbeat_ms=500)
    q = ring.writeStream.format("memory").queryName("beats").outputMode("update").trigger(processingTime="300 milliseconds").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(240):
            beats = spark.table("beats").where("kind = 'heartbeat'").collect()
            if len(beats) >= 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert len(beats) >= 2 and all(b.project_id == "p" and b.last_seq == 2 and b.lines == [] for b in beats)
    assert spark.table("beats").where("kind = 'lines'").count() == 1


@pytest.mark.parametrize("upto, since", [(120, 60), (100, 100), (0, 0)])
def test_no_line_is_lost_or_given_twice(spark, tmp_path, upto, since):
    rows = [("hot" if i % 4 else "cold", i, f"line {i}") for i in range(200)]
    history = [r for r in rows if r[1] < upto]
    live = [[r for r in rows if a <= r[1] < a + 35] for a in range(since, 200, 35)]
    live = [random.Random(3).sample(p, len(p)) for p in live]
    live.append(live[-1][:5])  # sent again
    snapshot, rest = st.handed_over(spark.createDataFrame(history + history[:3], LOGS), files(spark, str(tmp_path), live, LOGS), parts=4)
    got = run(rest, f"rest{upto}_{since}", "append", tmp_path).collect() + snapshot.collect()
    assert sorted(map(tuple, got)) == sorted(rows)


CHUNKS = "conv long, seq long, text string, ts timestamp, done boolean"


def test_tokens_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(c, i, f"w{i} " if i % 7 else None, t0 + dt.timedelta(seconds=i * (c % 3)), i == n - 1) for c, n in ((1, 45), (2, 20), (3, 7), (6, 20)) for i in range(n)]
    rows.sort(key=lambda r: (r[1], r[0]))
    got = run(st.token_stream(files(spark, str(tmp_path), cut(rows, 5), CHUNKS), ["conv"], every=10), "tokens_s", "append", tmp_path).collect()
    want = st.token_reports(spark.createDataFrame(rows, CHUNKS), "conv", every=10).collect()
    assert sorted(map(tuple, (r[:6] for r in got))) == sorted(map(tuple, want))
    texts = {r.conv: r.text for r in got if r.kind == "complete"}
    assert texts == {c: "".join(r[2] or "" for r in rows if r[0] == c) for c in (1, 2, 3, 6)}
    assert {(r.n_chunks, round(r.rate, 6)) for r in got if r.conv == 1 and r.kind == "report"} == {(10, round(10 / 9, 6)), (20, round(20 / 19, 6)), (30, round(30 / 29, 6)), (40, round(40 / 39, 6))}


def answers(rows, every):
    """Reports and whole answers by plain Python, for ``rows`` in order of their numbers."""
    out, held = [], {}
    for conv, _, text, ts, done in rows:
        n, texts, began = held.get(conv, (0, "", ts))
        n, texts = n + 1, texts + (text or "")
        spent = None if ts is None or began is None else (ts - began) // dt.timedelta(microseconds=1) / 1e6
        if done or n % every == 0:
            out.append((conv, "complete" if done else "report", n, len(texts), spent, n / spent if spent and spent > 0 else 0.0, texts if done else None))
        held[conv] = (n, texts, began)
        if done:
            del held[conv]
    return sorted(out, key=str)


@pytest.mark.parametrize("span, ends", [(1, 7), (8, 3), (8, 29), (65_536, 29)])
def test_tokens_by_spans_equal_plain_python(spark, tmp_path, span, ends):
    """Answers that end within a span and that cross some, batches that cut spans, null keys, texts and times, any order."""
    rnd, t0, big = random.Random(ends), dt.datetime(2024, 1, 1), 2**53 + 1
    rows = [(rnd.choice([None, 1, 2, big]), i - 40, rnd.choice(["", None, "é", "ab ", "x\ny"]), None if rnd.random() < 0.02 else t0 + dt.timedelta(microseconds=rnd.randrange(10**9) + i), rnd.random() < 1 / ends) for i in range(240)]
    parts = [random.Random(i).sample(p, len(p)) for i, p in enumerate([rows[:90], rows[90:101], rows[101:]])]
    stream = st.token_stream(files(spark, str(tmp_path), parts, CHUNKS), ["conv"], every=5, span=span)
    got = run(stream, f"spans{span}_{ends}", "append", tmp_path).collect()
    assert sorted((tuple(r) for r in got), key=str) == answers(rows, 5)


def test_a_busy_key_is_few_rows_to_its_state(spark, tmp_path, monkeypatch):
    """Two rows a span at most reach the task that holds a key, however many chunks a batch has of it."""
    seen = tmp_path / "seen"

    class Counted(st._Tokens):
        def handleInputRows(self, key, rows, timerValues):
            parts = list(rows)
            with open(seen, "a") as f:
                f.write(f"{sum(map(len, parts))}\n")
            yield from super().handleInputRows(key, iter(parts), timerValues)

    monkeypatch.setattr(st, "_Tokens", Counted)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, "w", t0 + dt.timedelta(seconds=i), i % 2 == 1 and i < 2000) for i in range(3000)]
    got = run(st.token_stream(files(spark, str(tmp_path), [rows], CHUNKS), ["conv"]), "busy", "append", tmp_path).collect()
    assert sorted((tuple(r) for r in got), key=str) == answers(rows, st.REPORT)
    assert sum(map(int, seen.read_text().split())) == 2


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = sinks.OnceTable(spark, str(tmp_path / "once"), "id long, v string")
    assert table.rows().collect() == []
    a, b = spark.createDataFrame([(1, "a", 9)], "id long, v string, more int"), spark.createDataFrame([(2, "b"), (3, None)], "id long, v string")
    assert table.append(a, "q", 0) and table.append(b, "q", 1) and table.append(b, "other", 0)
    before = sorted(map(str, table.rows().collect()))
    assert not table.append(b, "q", 1) and not table.append(a, "q", 1)
    assert sorted(map(str, table.rows().collect())) == before and table.rows().count() == 5
    a.select("id", "v").write.parquet(f"{table.data}/query=q/batch=2")  # a batch that failed before its entry
    assert sorted(map(str, table.rows().collect())) == before
    assert table.append(b, "q", 2) and table.rows().where("query = 'q' and batch = 2").count() == 2


def test_stream_started_anew_writes_each_batch_once(spark, tmp_path):
    table = sinks.OnceTable(spark, str(tmp_path / "once"), LOGS)
    rows = [("p", i, str(i)) for i in range(30)]
    stream = files(spark, str(tmp_path), cut(rows, 2), LOGS)
    for cp in ("a", "b"):  # the second run has lost its checkpoint, so all batches come again under the same numbers
        q = stream.writeStream.foreachBatch(table.sink("logs")).option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(tuple(r)[:3] for r in table.rows().select("project_id", "seq", "line").collect()) == sorted(rows)


def test_progress_reaches_its_table_without_a_pass(spark, tmp_path):
    rows = [("p", i, str(i)) for i in range(40)]
    parts = cut(rows, 7)
    calls = []

    def call(query, batch, metrics):
        calls.append((batch, metrics["rows"], metrics["top"]))
        raise ValueError("calls may fail")

    table = sinks.OnceTable(spark, str(tmp_path / "progress"), sinks.ProgressTable.SCHEMA)
    listener = sinks.ProgressTable(table, call)
    spark.streams.addListener(listener)
    try:
        seen = sinks.observed(files(spark, str(tmp_path), parts, LOGS), "lines", top=F.max("seq"))
        q = seen.writeStream.format("noop").queryName("observed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        for _ in range(60):
            if table.rows().count() >= len(parts):
                break
            time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
    tops = [max(r[1] for r in p) for p in parts]
    assert sorted(calls) == [(i, len(p), top) for i, (p, top) in enumerate(zip(parts, tops))]
    got = table.rows().orderBy("number").collect()
    assert [(r.number, r.name, r.rows, r.metrics["top"]) for r in got] == [(i, "lines", len(p), str(top)) for i, (p, top) in enumerate(zip(parts, tops))]
