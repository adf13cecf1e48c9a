"""Progress, logs and watchdogs as Structured Streaming; each function takes a batch or a streaming frame alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Loggers that are left out, besides the dashboard's own.
NOISY = ["brain.dashboard.api.main", "uvicorn.access", "uvicorn.error"]
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
#: What tells that a run has ended, as a log line and as a message.
ENDED = "[PIPELINE ENDED]"
MESSAGE = "type string, project_id string, chapter int, line_id string, progress int, total int, percent double, message string, ts timestamp"


def classified_logs(logs: DataFrame, raw: str = "raw", least: str = "INFO") -> DataFrame:
    """Log lines ``time | LEVEL | logger | message`` without noisy loggers and levels below ``least``."""
    part = lambda i: F.trim(F.try_element_at(F.split(raw, r"\|", 4), F.lit(i)))
    rows = logs.withColumns({"severity": part(2), "logger": part(3), "message": part(4)})
    rows = rows.where(F.col("severity").isin(LEVELS[LEVELS.index(least) :]) & ~F.col("logger").isin(NOISY))
    return rows.withColumn("level", line_class(raw))


def line_class(raw: Column | str) -> Column:
    """How a console shows a line: error, warn, info or debug by the first of these levels that stands between bars, sentinel, other."""
    line = F.col(raw) if isinstance(raw, str) else raw
    out = F.when(F.startswith(line, F.lit(ENDED)), "sentinel").otherwise("other")
    for level, shown in (("DEBUG", "debug"), ("INFO", "info"), ("WARNING", "warn"), ("ERROR", "error")):
        out = F.when(F.regexp_like(line, F.lit(rf"(?U)\|\s*{level}\s*\|")), shown).otherwise(out)
    return out


def messages(texts: DataFrame, body: str = "value") -> DataFrame:
    """JSON messages of all declared types under one schema; what isn't one of them goes."""
    rows = texts.select(F.from_json(body, MESSAGE).alias("m")).select("m.*")
    return rows.where(F.col("type").isin("progress", "quality", "chapter_complete", "pipeline_complete", "error"))


def progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals by key: events, the latest time, and the sum of values."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 6).alias("total"))


def windowed(events: DataFrame, length: str, late: str, keys: list[str]) -> DataFrame:
    """Counts per tumbling window; events later than ``late`` behind the newest are dropped by a stream."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg("value"), 9).alias("mean_value"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n_events", "mean_value")


def sessions(events: DataFrame, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Stretches of events of a key that follow each other within ``gap``: idle time ends them."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events"))
    return rows.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def replayed(history: DataFrame, live: DataFrame, ident: str, late: str = "1 hour") -> DataFrame:
    """History and what follows, each message once though both may hold it, as far as the watermark remembers.

    Where messages are numbered ``stateful.handed_over`` remembers all of them by one number.
    """
    rows = history.unionByName(live)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([ident]) if rows.isStreaming else rows.dropDuplicates([ident])


def fan_out(logs: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Each line of ``logs(project_id, ...)`` for every one of ``subscribers(project_id, subscriber)`` of its project."""
    return logs.join(subscribers, "project_id")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, end: DataFrame | None = None) -> int:
    """Give all that a stream holds to ``sink(batch, number)``, then ``end`` as one last batch; the number of batches.

    A batch may come again after a failure, with the same number, by which a sink can tell.
    """
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    number = (last["batchId"] if last else -1) + 1
    if end is not None:
        sink(end, number)
        number += 1
    return number


def restarts(health: DataFrame, key: str, failures: int = 1, most: int = 5) -> DataFrame:
    """Watchdog over ``(key, ts, ok)``: when to restart, counting failures since the last success per key.

    Every ``failures`` failures in a row call for a restart, at most ``most`` without a success in between.
    Emits ``(key, ts, restart)``; state is two numbers a key.
    """
    kind = health.schema[key].dataType.simpleString()

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bad, done = state.get if state.exists else (0, 0)
        out = []
        rows = pd.concat(list(parts)).sort_values("ts")
        for ts, ok in zip(rows["ts"], rows["ok"]):
            bad, done = (0, 0) if ok else (bad + 1, done)
            if bad >= failures and done < most:
                bad, done = 0, done + 1
                out.append((k[0], ts, done))
        state.update((bad, done))
        yield pd.DataFrame(out, columns=[key, "ts", "restart"])

    return health.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, restart int", "bad int, done int", "append", GroupStateTimeout.NoTimeout)


def tokens(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Streamed chunks of ``(keys, seq, text)`` put together: text, count and characters."""
    rows = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["text"]), "")
    return rows.select(*keys, text.alias("text"), F.size("c").alias("n_chunks"), F.length(text).alias("n_chars"))
