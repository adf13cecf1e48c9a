"""Streams with state of their own: the ring of last lines with its heartbeat, hand-over from history, token rates.

Each is a ``StatefulProcessor`` for ``transformWithStateInPandas``, which keeps its state in RocksDB (``use_rocksdb``). State
is bounded for each key, apart from the pieces of an answer that is still being streamed, and timers make rows
without input. Busy keys are cut down before the shuffle, or dealt over several groups.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..runtime import staged, totals_before

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Lines kept for each project, silence until a heartbeat, chunks between two reports.
RING, HEARTBEAT_MS, REPORT = 500, 15_000, 200

#: Parts over which the lines of a project are dealt when a stream follows its history.
PARTS = 32

#: Numbers of chunks that are put in order together.
SPAN = 65_536

#: Keys as JSON and back without loss.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@contextmanager
def use_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it streams start with the state store that these processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class _Ring(StatefulProcessor):
    def __init__(self, size: int, heartbeat_ms: int) -> None:
        self.size, self.heartbeat_ms = size, heartbeat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "seq long, line string")

    def _rearm(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.heartbeat_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(self.ring.get()) if self.ring.exists() else {}
        for part in rows:
            held.update((s, x) for s, x in zip(part["seq"].tolist(), part["line"].tolist()))
            if len(held) > 4 * self.size:
                held = dict(sorted(held.items())[-self.size :])
        last = sorted(held.items())[-self.size :]
        self.ring.put(last)
        self._rearm(timerValues.getCurrentProcessingTimeInMs())
        lines = [{"seq": s, "line": x} for s, x in last]
        yield pd.DataFrame({"project_id": [key[0]], "kind": ["lines"], "last_seq": [last[-1][0]], "lines": [lines]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat_ms)
        last = [s for s, _ in self.ring.get()] if self.ring.exists() else [None]
        yield pd.DataFrame({"project_id": [key[0]], "kind": ["heartbeat"], "last_seq": [last[-1]], "lines": [[]]})

    def close(self) -> None:
        pass


def last_lines(logs: DataFrame, size: int = RING) -> DataFrame:
    """The last ``size`` of each project's ``logs(project_id, seq, line)``; the batch form of ``log_ring``."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("seq")))  # tasks drop what is beyond before the shuffle
    return logs.select("project_id", "seq", "line").withColumn("_n", place).where(F.col("_n") <= size).drop("_n")


def log_ring(logs: DataFrame, size: int = RING, heartbeat_ms: int = HEARTBEAT_MS) -> DataFrame:
    """The ring of the last ``size`` lines of each project of a stream ``logs(project_id, seq, line)``.

    Emits ``(project_id, kind, last_seq, lines array<struct<seq,line>>)``: a row of kind ``lines`` with the ring as it is
    after each batch that has lines of the project, and one of kind ``heartbeat`` without lines when none came for
    ``heartbeat_ms``. Lines are ordered by ``seq``, of which equal ones are one line, so the ring depends neither on
    how the stream is cut into batches nor on the order within. Rows with a null ``seq`` go. At most ``size`` lines of a
    project leave an Arrow batch, so that a busy project is a small group.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.sort_values("seq").drop_duplicates(["project_id", "seq"], keep="last").groupby("project_id", dropna=False).tail(size)

    rows = logs.where("seq is not null").select("project_id", F.col("seq").cast("long").alias("seq"), "line")
    kind = rows.schema["project_id"].dataType.simpleString()
    rows = rows.mapInPandas(cut, f"project_id {kind}, seq long, line string")
    out = f"project_id {kind}, kind string, last_seq long, lines array<struct<seq:bigint,line:string>>"
    return rows.groupBy("project_id").transformWithStateInPandas(_Ring(size, heartbeat_ms), out, "Update", "processingTime")


class _After(StatefulProcessor):
    """Lets each number pass once, in rising order, from the number that the state starts with."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((int(initialState["_upto"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        table = pd.concat(list(rows)).sort_values("seq").drop_duplicates("seq")
        if last is not None:
            table = table[table["seq"] > last]
        if len(table):
            self.last.update((int(table["seq"].iloc[-1]),))
            yield table[self.names]

    def close(self) -> None:
        pass


def handed_over(history: DataFrame, live: DataFrame, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """Replay, then follow: ``(snapshot, rest)`` hold each line of ``(project_id, seq, ...)`` once between them.

    ``snapshot`` is ``history``, each number once; ``rest`` is the stream of what follows the last number of
    the snapshot in its project. The stream may hold all of the history again, a part of it or none, and may repeat
    lines, as long as numbers of a project rise from batch to batch; the lines of a batch may come in any order. The
    state is one number for each project and part: a project's lines are dealt over ``parts`` by their number, so that
    a busy one is many groups. Rows with a null ``seq`` go.
    """
    history = history.where("seq is not null").dropDuplicates(["project_id", "seq"])
    snapshot = staged(history, "snapshot")  # so that hand-over and replay see the same rows
    part = F.pmod(F.col("seq"), F.lit(parts)).cast("int").alias("_part")
    upto = snapshot.groupBy("project_id").agg(F.max("seq").cast("long").alias("_upto"))
    upto = upto.select("project_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), "_upto")
    rows = live.where("seq is not null").select("*", part)
    processor = _After(live.columns)
    rest = rows.groupBy("project_id", "_part").transformWithStateInPandas(processor, live.schema, "Append", "None", initialState=upto.groupBy("project_id", "_part"))
    return snapshot, rest


class _Tokens(StatefulProcessor):
    """What answers held before each span, and the answers that end in a later span than they began in.

    A span gives its chunks as two rows at most, so that a key is few rows however many chunks it has. Texts go
    into the state as they come, and are read where their answer ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, chars long, began double, turn long")
        self.pieces = handle.getMapState("pieces", "turn long, span double, part int", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, chars, began, turn = self.sums.get() if self.sums.exists() else (0, 0, None, 0)
        held = []
        for p in rows:
            for span, part, text in zip(p["span"].tolist(), p["part"].tolist(), p["text"]):
                if text:
                    self.pieces.updateValue((turn, span, part), (text,))
            held.append(p.drop(columns=["text"]))
        table = pd.concat(held).sort_values(["span", "part"])
        places = deque(sorted(tuple(k) for k in self.pieces.keys()) if table["done"].any() else [])
        out = []
        for span, part, more, length, first, last, done in zip(*(table[c].tolist() for c in ("span", "part", "n", "chars", "first", "last", "done"))):
            began = began if n else first
            if part == 0:
                out.append((key[0], span, "before", began, n, chars, 0.0, 0.0, None))
            n, chars = n + more, chars + length
            if done:
                whole = []
                while places and places[0] <= (turn, span, part):
                    place = places.popleft()
                    whole.append(self.pieces.getValue(place)[0])
                    self.pieces.removeKey(place)
                spent = (last - began) / 1e6
                out.append((key[0], span, "complete", began, n, chars, spent, n / spent if spent > 0 else 0.0, "".join(whole)))
                n, chars, began = 0, 0, None
        if n:
            self.sums.update((n, chars, began, turn + 1))
        else:
            self.sums.clear()
        yield pd.DataFrame(out, columns=["id", "span", "kind", "at", "n_chunks", "n_chars", "seconds", "rate", "text"])

    def close(self) -> None:
        pass


def _in_order(p: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Chunks of a span by number, and how many answers ended before each; equal numbers come in one order too."""
    p = p.assign(text=p["text"].fillna("")).sort_values(["seq", "done", "at", "chars", "text"])
    done = p["done"].to_numpy(bool)
    return p, done.cumsum() - done


def _ends(p: pd.DataFrame) -> pd.DataFrame:
    """A span as the rows that other spans need: its chunks up to the first end of an answer, and those after the last."""
    p, part = _in_order(p)
    out = []
    for i in sorted({0, part[-1]}):
        q = p[part == i]
        done = bool(q["done"].iloc[-1])
        if i == 0 or not done:
            out.append((*q[["id", "span"]].iloc[0], min(i, 1), len(q), q["chars"].sum(), q["at"].iloc[0], q["at"].iloc[-1], done, "".join(q["text"])))
    return pd.DataFrame(out, columns=["id", "span", "part", "n", "chars", "first", "last", "done", "text"])


def _reports(every: int):
    """Reports of a span's chunks and answers that began and ended within, by what was before; other answers pass."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "kind", "n_chunks", "n_chars", "seconds", "rate", "text"]
        before, whole = p[p["kind"] == "before"].iloc[0], p.loc[p["kind"] == "complete", names]
        p, part = _in_order(p[p["kind"] == "chunk"])
        at, done, length = p["at"].to_numpy(float), p["done"].to_numpy(bool), p["chars"].to_numpy()
        starts = np.searchsorted(part, np.arange(part[-1] + 1))
        began, n, total = at[starts], np.arange(1, len(p) + 1) - starts[part], length.cumsum()
        chars, own = total - (total - length)[starts][part], part > 0
        began[0] = before["at"]
        n, chars = n + np.where(own, 0, before["n_chunks"]), chars + np.where(own, 0, before["n_chars"])
        spent = (at - began[part]) / 1e6
        rate = np.divide(n, spent, out=np.zeros(len(p)), where=spent > 0)
        texts = {i: "".join(p["text"].iloc[starts[i] : j + 1]) for i, j in zip(part[done & own], np.flatnonzero(done & own))}
        p = p.assign(kind=np.where(done, "complete", "report"), n_chunks=n, n_chars=chars, seconds=spent, rate=rate, text=[texts.get(i) if d else None for i, d in zip(part, done)])
        return pd.concat([x for x in (p.loc[np.where(done, own, n % every == 0), names], whole) if len(x)] or [whole])

    return run


def _timed(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with times in microseconds, which a double holds exactly, and the characters of each."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return chunks.select(*keys, "seq", "text", at.alias("at"), F.coalesce("done", F.lit(False)).alias("done"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))


def token_stream(chunks: DataFrame, keys: list[str], every: int = REPORT, span: int = SPAN) -> DataFrame:
    """Follow streamed answers: ``chunks(keys, seq, text, ts, done)`` -> reports and whole answers.

    Emits ``(keys, kind, n_chunks, n_chars, seconds, rate, text)``: a row of kind ``report`` at each ``every`` chunks, with
    the time since the first chunk and chunks a second (0 where no time has passed), and one of kind ``complete`` with
    the text at the chunk that is ``done``, after which the key starts anew. Chunks of a key rise by ``seq``, a number, from
    batch to batch and come in any order within; null texts are empty chunks.

    No task holds a batch's chunks of a key: those whose numbers are in the same ``span`` are a group of their own,
    which gives two rows at most to the state of the key and gets back what was before it. So ``chunks`` is read twice
    a batch. Where numbers leave large gaps, a wider ``span`` makes fewer groups.
    """
    rows = _timed(chunks, keys)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    sums = "n_chunks long, n_chars long, seconds double, rate double, text string"
    # Keys as text: a null among numbers would make them floating-point numbers in Python, and equals nothing there.
    ident, place = F.to_json(F.struct(*keys), EXACT).alias("id"), F.coalesce(F.floor(F.col("seq") / F.lit(span)).cast("double"), F.lit(float("inf"))).alias("span")
    rows = rows.select(ident, place, "seq", "text", "at", "done", "chars")
    ends = rows.groupBy("id", "span").applyInPandas(_ends, "id string, span double, part int, n long, chars long, first double, last double, done boolean, text string")
    before = ends.groupBy("id").transformWithStateInPandas(_Tokens(), f"id string, span double, kind string, at double, {sums}", "Append", "None")
    before = before.withColumns({"seq": F.lit(0).cast(rows.schema["seq"].dataType), "done": F.lit(False), "chars": F.lit(0).cast("long")})
    none = {"kind": F.lit("chunk"), "n_chunks": F.lit(0).cast("long"), "n_chars": F.lit(0).cast("long"), "seconds": F.lit(0.0), "rate": F.lit(0.0)}
    out = rows.withColumns(none).unionByName(before).groupBy("id", "span").applyInPandas(_reports(every), f"id string, kind string, {sums}")
    return out.withColumn("id", F.from_json("id", kinds, EXACT)).select("id.*", "kind", "n_chunks", "n_chars", "seconds", "rate", "text")


def token_reports(chunks: DataFrame, key: str, every: int = REPORT) -> DataFrame:
    """The reports of ``token_stream`` for a batch, without text and with one answer a key, however long.

    The chunks before each are counted over ranges, so that no task holds an answer.
    """
    rows = _timed(chunks, [key]).select(key, "seq", "at", "done", F.lit(1).alias("_one"), F.col("chars").alias("_chars"))
    rows = totals_before(rows, key, ["seq"], {"n": "_one", "chars": "_chars"})
    some = rows.where(((F.col("n") + 1) % every == 0) | F.col("done"))
    began = rows.where("n = 0").select(F.col(key).alias("_key"), F.col("at").alias("began"))
    some = some.join(began, some[key].eqNullSafe(began["_key"]))
    spent = (F.col("at") - F.col("began")) / 1e6
    return some.select(key, F.when(F.col("done"), "complete").otherwise("report").alias("kind"), (F.col("n") + 1).alias("n_chunks"), (F.col("chars") + F.col("_chars")).alias("n_chars"), spent.alias("seconds"), F.when(spent > 0, (F.col("n") + 1) / spent).otherwise(0.0).alias("rate"))
