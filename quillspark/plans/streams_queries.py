"""Queries over events, as a table and as streams that end with it."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from ..runtime import shared_dir
from ..streaming import events as ev
from ..streaming.sinks import OnceTable, ProgressTable, observed
from ..streaming.stateful import handed_over, token_stream, use_rocksdb
from .registry import query
from .views import view


def events(spark, d):
    return view(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("l4_progress", "SELECT event_type, user_id % 5 AS project, count(*) AS n_events, max(ts) AS last_ts, round(sum(value), 6) AS total FROM {events} GROUP BY 1, 2")
def l4_progress(spark, d):
    rows = view(spark, d, "events").withColumn("project", F.col("user_id") % 5)
    return ev.progress(rows, ["event_type", "project"])


@query("l4_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events, round(avg(value), 9) AS mean_value FROM {events} GROUP BY 1, 2")
def l4_windows(spark, d):
    out = ev.windowed(events(spark, d), "1 day", "1 day", ["event_type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "l10_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts FROM {events}), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k""",
)
def l10_sessions(spark, d):
    out = ev.sessions(events(spark, d), "2 hours", "1 day", ["user_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def _read(spark, d):
    """The table of events as a stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern may be a file, a path may not
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark, stream, mode="append"):
    """All that a stream gives from what is there, written batch by batch, each once."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = OnceTable(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema))
    with use_rocksdb(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(table.sink("out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return table.rows().drop("query", "batch")


@query("l2_handed_over", "SELECT CAST(user_id % 5 AS VARCHAR) AS project_id, event_id AS seq, event_type AS line FROM {events}")
def l2_handed_over(spark, d):
    """History up to a number that differs by project, then a stream that holds a part of it again: each line once."""
    line = [(F.col("user_id") % 5).cast("string").alias("project_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("line")]
    history = view(spark, d, "events").where("event_id < 700 - 100 * (user_id % 5)").select(*line)
    snapshot, rest = handed_over(history, _read(spark, d).where("event_id >= 200").select(*line))
    return snapshot.union(_finished(spark, rest))


@query(
    "l7_token_reports",
    """WITH c AS (SELECT user_id % 5 AS project, ts, length(event_type) AS chars, row_number() OVER w AS n, first_value(ts) OVER w AS began FROM {events} WINDOW w AS (PARTITION BY user_id % 5 ORDER BY event_id)),
s AS (SELECT project, n, sum(chars) OVER (PARTITION BY project ORDER BY n) AS chars, (epoch_us(ts) - epoch_us(began)) / 1000000.0 AS seconds FROM c)
SELECT project, n AS n_chunks, CAST(chars AS BIGINT) AS n_chars, round(seconds, 3) AS seconds, round(CASE WHEN seconds > 0 THEN n / seconds ELSE 0 END, 9) AS rate FROM s WHERE n % 200 = 0""",
)
def l7_token_reports(spark, d):
    """A report at each 200 chunks of a stream."""
    chunks = _read(spark, d).select((F.col("user_id") % 5).alias("project"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), "ts", F.lit(False).alias("done"))
    out = _finished(spark, token_stream(chunks, ["project"]))
    rounded = lambda c, to: (F.round(F.col(c) * to) / to).alias(c)  # noqa: E731  # as the SQL rounds halves
    return out.select("project", "n_chunks", "n_chars", rounded("seconds", 1e3), rounded("rate", 1e9))


@query("m7_progress", "SELECT count(*) AS rows, max(event_id) AS top, round(sum(value), 4) AS total FROM {events}")
def m7_progress(spark, d):
    """Counts of a stream's batches as a listener gets them, from the pass that the stream makes anyway."""
    path = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    table = OnceTable(spark, path, ProgressTable.SCHEMA)
    listener = ProgressTable(table)
    spark.streams.addListener(listener)
    try:
        seen = observed(_read(spark, d), "lines", top=F.max("event_id"), total=F.sum("value"))
        query = seen.writeStream.format("noop").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        batches = sum(bool(p["numInputRows"]) for p in query.recentProgress)
        until = time.time() + 60
        while table.rows().where("rows > 0").count() < batches and time.time() < until:  # listeners are told some time later
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    number = lambda k, t: F.col("metrics")[k].cast(t)
    return table.rows().where("rows > 0").agg(F.sum("rows").alias("rows"), F.max(number("top", "long")).alias("top"), F.round(F.sum(number("total", "double")), 4).alias("total"))


@query("l6_messages", "SELECT event_type AS type, user_id, count(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY 1, 2")
def l6_messages(spark, d):
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("chapter")))
    out = ev.messages(view(spark, d, "events").select(body.alias("value")))
    return out.groupBy("type", F.col("chapter").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query("l7_tokens", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {conversations} GROUP BY 1")
def l7_tokens(spark, d):
    out = ev.tokens(view(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), "text"), ["conv_id"])
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("n_chunks").cast("long").alias("n_chunks"), F.col("n_chars").cast("long").alias("n_chars"))
