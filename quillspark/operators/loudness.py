"""Integrated loudness after ITU-R BS.1770: weighting filter, blocks of 400 ms, two gates.

Sound is a table ``pieces(audio, piece, sample_rate, pcm)``, so that a recording may be longer than a row should be. The
weighting filter is a linear recurrence with four state numbers. Every piece is filtered as if it came first,
which gives the state that it adds; the states that pieces begin with follow by composing those maps over ranges
of the order; and the power of a piece's samples under a carried state follows without a second look at its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Tables, totals_before

#: Samples that are filtered by one product of matrices.
RUN = 64
# Gates and block of the measure, and what stands for silence.
BLOCK_S, OVERLAP, ABSOLUTE, RELATIVE, SILENCE = 0.4, 0.75, -70.0, -10.0, -70.0


def _biquads(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """High shelf of 4 dB at 1500 Hz and high pass at 38 Hz, as (numerator, denominator), the latter starting with 1."""
    w, a = 2 * math.pi * 1500 / rate, 10 ** (4 / 40)
    c, r = math.cos(w), 2 * math.sqrt(a) * math.sin(w) / math.sqrt(2)
    shelf = np.array([a * ((a + 1) + (a - 1) * c + r), -2 * a * ((a - 1) + (a + 1) * c), a * ((a + 1) + (a - 1) * c - r)]), np.array([(a + 1) - (a - 1) * c + r, 2 * ((a - 1) - (a + 1) * c), (a + 1) - (a - 1) * c - r])
    w = 2 * math.pi * 38 / rate
    c, s = math.cos(w), math.sin(w)  # a quality of one half
    low = np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]), np.array([1 + s, -2 * c, 1 - s])
    return [(b / d[0], d / d[0]) for b, d in (shelf, low)]


@lru_cache(maxsize=64)
def system(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The two filters in a row as ``s' = A s + B x, y = C s + D x``."""
    parts = []
    for b, d in _biquads(rate):
        parts.append((np.array([[-d[1], 1.0], [-d[2], 0.0]]), np.array([b[1] - d[1] * b[0], b[2] - d[2] * b[0]]), np.array([1.0, 0.0]), b[0]))
    (a1, b1, c1, d1), (a2, b2, c2, d2) = parts
    a = np.block([[a1, np.zeros((2, 2))], [np.outer(b2, c1), a2]])
    return a, np.concatenate((b1, b2 * d1)), np.concatenate((d2 * c1, c2)), d1 * d2


@lru_cache(maxsize=64)
def _runs(rate: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ``n`` samples at once: state to state, samples to state, state to output, samples to output."""
    a, b, c, d = system(rate)
    powers = [np.eye(4)]
    for _ in range(n):
        powers.append(a @ powers[-1])
    hit = np.array([c @ p @ b for p in powers[:-1]])  # answer to one sample, from the next on
    i, j = np.indices((n, n))
    kernel = np.where(i == j, d, np.where(i > j, hit[np.maximum(i - j - 1, 0)], 0.0))
    return powers[n], np.stack([powers[n - 1 - k] @ b for k in range(n)], 1), np.stack([c @ p for p in powers[:-1]]), kernel


def weighted(x: np.ndarray, rate: int, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered samples of a piece that begins with ``state``, and the state at its end."""
    s = np.zeros(4) if state is None else np.asarray(state, float)
    out = []
    whole = len(x) // RUN * RUN
    if whole:
        step, take, give, kernel = _runs(rate, RUN)
        rows = x[:whole].reshape(-1, RUN)
        pushed, states = rows @ take.T, np.empty((len(rows), 4))
        for k, p in enumerate(pushed):
            states[k] = s
            s = step @ s + p
        out.append((rows @ kernel.T + states @ give.T).ravel())
    if len(x) > whole:
        step, take, give, kernel = _runs(rate, len(x) - whole)
        out.append(kernel @ x[whole:] + give @ s)
        s = step @ s + take @ x[whole:]
    return np.concatenate(out) if out else np.zeros(0), s


def _power(rate: int, n: int) -> np.ndarray:
    return np.linalg.matrix_power(system(rate)[0], n)


def bounds(rate: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First sample and end of each block of a recording of ``n`` samples."""
    step = 1 - OVERLAP
    j = np.arange(int(round((n / rate - BLOCK_S) / (BLOCK_S * step))) + 1 if n >= BLOCK_S * rate else 0)
    return (BLOCK_S * (j * step) * rate).astype(np.int64), np.minimum((BLOCK_S * (j * step + 1) * rate).astype(np.int64), n)


def _pcm(column: pa.Array, i: int) -> np.ndarray:
    x = column[i]
    return np.nan_to_num(np.asarray(x.values.cast(pa.float64()).fill_null(0.0))) if x.is_valid else np.zeros(0)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each piece (audio, piece, rate, pcm) leaves if it comes first: (audio, piece, rate, n, s)."""
    for batch in batches:
        rates = batch.column(2).to_pylist()
        ends = [weighted(_pcm(batch.column(3), i), r)[1].tolist() for i, r in enumerate(rates)]
        sizes = [len(x) if x.is_valid else 0 for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.float64()))], names=["audio", "piece", "rate", "n", "s"])


def _carried(starts: bool):
    """Compose the maps of sorted pieces (audio, rate, n, s, at, s0): a row for each audio, or, from ``s0``, each piece's state at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audio, at, rate, count, state, first = None, None, 0, 0, np.zeros(4), True
        out: list[tuple] = []

        def rows():
            columns = list(zip(*out)) if out else [[]] * 5
            names = ["audio", "piece", "s"] if starts else ["audio", "at", "rate", "n", "s"]
            kinds = [kind, pa.int64(), pa.list_(pa.float64())] if starts else [kind, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        kind = pa.string()
        for batch in batches:
            kind = batch.schema.field("audio").type
            for r in batch.to_pylist():
                if first or r["audio"] != audio:
                    if not first and not starts:
                        out.append((audio, at, rate, count, state.tolist()))
                    audio, at, rate, count, first = r["audio"], r["at"], r["rate"], 0, False
                    state = np.array(r["s0"]) if starts else np.zeros(4)
                if starts:
                    out.append((audio, r["piece"], state.tolist()))
                state, count = _power(rate, r["n"]) @ state + np.array(r["s"]), count + r["n"]
            if starts and out:
                yield rows()
                out = []
        if not starts and not first:
            out.append((audio, at, rate, count, state.tolist()))
        if out:
            yield rows()

    return run


def _energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each piece (audio, rate, total, first, s, pcm) adds to the sums of squares of its recording's blocks: (audio, block, e)."""
    for batch in batches:
        audio, rate, total, first, state, pcm = batch.columns
        take, blocks, sums = [], [], []
        for i in range(batch.num_rows):
            x = _pcm(pcm, i)
            lo, hi = bounds(rate[i].as_py(), total[i].as_py())
            f = first[i].as_py()
            mine = np.flatnonzero((hi > f) & (lo < f + len(x)))
            if not len(mine):
                continue
            y, _ = weighted(x, rate[i].as_py(), np.asarray(state[i].values))
            before = np.concatenate(([0.0], np.cumsum(y * y)))
            e = before[np.minimum(hi[mine] - f, len(x))] - before[np.maximum(lo[mine] - f, 0)]
            take += [i] * len(mine)
            blocks.append(mine)
            sums.append(e)
        if take:
            yield pa.RecordBatch.from_arrays([audio.take(pa.array(take)), pa.array(np.concatenate(blocks)), pa.array(np.concatenate(sums))], names=["audio", "block", "e"])


def integrated_loudness(pieces: DataFrame) -> DataFrame:
    """``(audio, lufs)`` of each recording of ``pieces(audio, piece long, sample_rate int, pcm)``, mono, gated twice.

    Pieces of a recording are ordered by ``piece``, which is distinct, and share a sample rate; they may be of any length, an
    empty or null one adds nothing. Null samples and NaN count as 0. Recordings under 0.4 s, silent ones and those
    wholly below the absolute gate have -70. The filter needs sample rates above 3000. Null audios are one recording. No task holds a recording: what is
    combined across pieces is four numbers for each of them.
    """
    stage = Tables()
    t = pieces.select("audio", F.col("piece").cast("long").alias("piece"), F.col("sample_rate").cast("int").alias("rate"), "pcm")
    kind = t.schema["audio"].dataType.simpleString()
    ends = stage(t.mapInArrow(_ends, f"audio {kind}, piece long, rate int, n long, s array<double>"), "ends")
    cut = stage(ends.repartitionByRange("audio", "piece").sortWithinPartitions("audio", "piece").withColumn("at", F.spark_partition_id()).withColumn("s0", F.array().cast("array<double>")), "cut")
    by_range = cut.repartition("at").sortWithinPartitions("at", "audio", "piece")
    ranges = stage(by_range.groupBy("at").applyInArrow(_of_group(_carried(False)), f"audio {kind}, at int, rate int, n long, s array<double>"), "ranges")
    begin = ranges.groupBy("audio").applyInArrow(_range_starts, f"audio {kind}, at int, s0 array<double>")  # a row for each range
    begin = stage(begin, "begin")
    known = cut.drop("s0").join(begin, cut["audio"].eqNullSafe(begin["audio"]) & (cut["at"] == begin["at"])).select(cut["audio"], "piece", "rate", "n", "s", cut["at"], "s0")
    starts = known.repartition("at").groupBy("at").applyInArrow(_of_group(_carried(True)), f"audio {kind}, piece long, s array<double>")
    first = totals_before(ends.select("audio", "piece", "n"), "audio", ["piece"], {"first": "n"}).select(F.col("audio").alias("_a"), F.col("piece").alias("_p"), "first")
    starts = starts.join(first, starts["audio"].eqNullSafe(first["_a"]) & (starts["piece"] == first["_p"])).drop("_a", "_p")
    total = ends.groupBy(F.col("audio").alias("_a")).agg(F.sum("n").alias("total"))
    starts = stage(starts.join(total, starts["audio"].eqNullSafe(total["_a"])).drop("_a").select(F.col("audio").alias("_a"), F.col("piece").alias("_p"), "total", "first", "s"), "starts")
    rows = t.join(starts, t["audio"].eqNullSafe(starts["_a"]) & (t["piece"] == starts["_p"])).select("audio", "rate", "total", "first", "s", "pcm")
    power = stage(rows.mapInArrow(_energies, f"audio {kind}, block long, e double"), "energies").groupBy("audio", "block").agg(F.sum("e").alias("e"))
    rates = ends.groupBy(F.col("audio").alias("_a")).agg(F.max("rate").alias("rate"))
    power = power.join(rates, power["audio"].eqNullSafe(rates["_a"])).select("audio", (F.col("e") / (BLOCK_S * F.col("rate"))).alias("z"))
    power = stage(power.withColumn("l", -0.691 + 10 * F.log10(F.when(F.col("z") > 0, F.col("z")))), "power")
    loud = power.where(F.col("l") >= ABSOLUTE).groupBy(F.col("audio").alias("_a")).agg((-0.691 + 10 * F.log10(F.avg("z")) + RELATIVE).alias("gate"))
    kept = power.join(loud, power["audio"].eqNullSafe(loud["_a"])).where((F.col("l") > F.col("gate")) & (F.col("l") > ABSOLUTE))
    level = kept.groupBy(F.col("audio").alias("_a")).agg((-0.691 + 10 * F.log10(F.avg("z"))).alias("lufs"))
    every = ends.select("audio").distinct()
    out = stage(every.join(level, every["audio"].eqNullSafe(level["_a"]), "left").select("audio", F.coalesce("lufs", F.lit(SILENCE)).alias("lufs")), "loudness")
    stage.close(out)
    return out


def _of_group(run):
    """A function of batches as one of the table of a range."""

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(table.sort_by([("audio", "ascending"), ("piece", "ascending")]).to_batches())))

    return whole


def _range_starts(table: pa.Table) -> pa.Table:
    """The state with which each range of one recording begins, from the ranges before it."""
    state, out = np.zeros(4), []
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    for r in rows:
        out.append(state.tolist())
        state = _power(r["rate"], r["n"]) @ state + np.array(r["s"])
    return pa.table({"audio": pa.array([r["audio"] for r in rows], table.schema.field("audio").type), "at": pa.array([r["at"] for r in rows], pa.int32()), "s0": pa.array(out, pa.list_(pa.float64()))})
