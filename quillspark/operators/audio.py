"""Analysis, filtering, assembly and mastering of segments ``(keys, sample_rate, pcm)``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import audio as au
from ..runtime import Tables, totals_before


def is_identity(pitch: str, speed: str, tone: Column | None = None) -> Column:
    same = (F.abs(F.col(pitch)) < 1e-3) & (F.abs(F.col(speed) - 1) < 1e-3)
    return same if tone is None else same & (tone == "neutral")


def needs_tool(pitch: str, speed: str) -> Column:
    """Whether pitch or speed is a usable number that changes anything."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return (finite(pitch) | finite(speed)) & ~is_identity(pitch, speed)


def analysed(segments: DataFrame, clip_db: float = -0.5, noise_limit: float = -50.0, max_silence_seconds: float = 3.0) -> DataFrame:
    """Levels, silence and artifact score of every segment."""
    rate = F.col("sample_rate")
    out = segments.withColumns(
        {
            "duration_seconds": F.size("pcm") / rate,
            "peak_dbfs": au.peak_dbfs("pcm"),
            "noise_floor_db": au.noise_floor_db("pcm", rate),
            "has_long_silence": au.longest_silence("pcm") > F.floor(rate * max_silence_seconds),
        }
    ).withColumn("clipping_detected", F.col("peak_dbfs") > clip_db)
    return out.withColumn("artifact_score", au.artifact_score(F.col("clipping_detected"), F.col("noise_floor_db") > noise_limit, F.col("has_long_silence")))


def longest_silence_by_islands(segments: DataFrame, keys: list[str], threshold_db: float = -40.0) -> DataFrame:
    """Longest run below the threshold, from samples as rows."""
    quiet = segments.select(*keys, F.posexplode("pcm").alias("p", "x")).where(F.abs("x") < 10 ** (threshold_db / 20))
    island = F.col("p") - F.row_number().over(Window.partitionBy(*keys).orderBy("p"))
    runs = quiet.withColumn("island", island).groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("n"))
    return segments.select(*keys).join(runs, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("int").alias("longest"))


def filtered(segments: DataFrame, what: str, *args) -> DataFrame:
    """Apply ``gate``, ``resample`` (to a rate) or a tone (``warm``, ``bright``) to every segment."""
    functions = {"gate": au.gate, "resample": au.resample}
    f = functions.get(what) or (lambda x, rate: au.tone(x, what))
    return segments.withColumn("pcm", au.mapped(f, *args)("pcm", "sample_rate"))


def with_effects(segments: DataFrame, pitch: str = "pitch_semitones", speed: str = "speed", tone: str = "tone", stretched: str | None = None, mix: Column | None = None) -> DataFrame:
    """The effect chain over ``segments(sample_rate, pcm)``: tone, a share of the original, and samples within -1 and 1.

    Changing speed and pitch is an external tool's work: ``stretched`` names the column with its samples (null:
    as they were). ``mix`` replaces the share that pitch, speed and tone give. Null effects count as none.
    """
    effect = [F.coalesce(F.col(c).cast("double"), F.lit(x)) for c, x in ((pitch, 0.0), (speed, 1.0))]
    kind = F.coalesce(F.col(tone), F.lit("neutral"))
    made = F.coalesce(F.col(stretched), F.col("pcm")) if stretched else F.col("pcm")
    toned = lambda name: au.mapped(lambda x, _: au.tone(x, name))(made, "sample_rate")
    none = F.col(pitch).isNull() & F.col(speed).isNull() & F.col(tone).isNull()
    shaped = F.when(kind == "warm", toned("warm")).when(kind == "bright", toned("bright")).otherwise(made.cast("array<double>"))
    out = segments.withColumn("_shaped", shaped)
    share = au.blend_share(*effect, kind) if mix is None else mix
    clipped = F.transform(au.blended("pcm", F.col("_shaped"), share), lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    return out.withColumn("pcm", F.when(none, F.col("pcm").cast("array<double>")).otherwise(clipped)).drop("_shaped")


def _fades_of_chain(fade: int):
    """Fades of segments that follow each other without a pause, each depending on what the one before left of its segment."""

    @F.pandas_udf("array<int>")
    def run(chains: pd.Series) -> pd.Series:
        def one(chain) -> list[int]:
            out, room = [], 0
            for link in chain:
                n = au.overlap(fade, room, link["length"]) if link["fade"] is None else link["fade"]
                out.append(n)
                room = link["length"] - n
            return out

        return chains.map(one)

    return run


def _gain(u: Column, curve: str) -> Column:
    return {"cosine": F.sin(u * F.lit(np.pi / 2)), "linear": u, "exponential": F.expm1(u * 3) / F.lit(float(np.expm1(3)))}[curve]


def assembled_parts(segments: DataFrame, keys: list[str], sample_rate: int, fade_ms: float = 30.0, lead_ms: int = 1000, tail_ms: int = 2000, curve: str = "cosine") -> DataFrame:
    """Chapters of any length as ``(keys, part, start_sample, pcm)``: their parts in order are what ``assembled`` puts in one array.

    Part 0 is the silence that opens a chapter, then comes one part a segment with its pauses, then the silence at the
    end. A segment fades into the part before it, so that part ends with the samples that both share. Where segments lie
    follows from their lengths and pauses, which are summed over ranges; samples meet only those of the next segment, by
    row, and no task holds a chapter. Only segments shorter than two fades that follow each other without a pause are
    worked out in a row, by their lengths alone.

    ``segments(keys, line_ord, pcm, pause_before_ms, pause_after_ms)`` may have more columns. Null samples leave
    the pause before them alone (a chapter without samples and pauses has no parts), null pauses are none, null keys are a
    chapter of their own; segments of equal ``line_ord`` come in any order.
    """
    stage, count = Tables(), lambda ms: int(sample_rate * ms / 1000)
    fade, lead, tail = count(fade_ms), count(lead_ms), count(tail_ms)
    silent = F.col("pcm").isNull()
    pause = lambda c: F.when(F.col(c) > 0, F.floor(F.col(c) * sample_rate / 1000).cast("int"))
    before, after = pause("pause_before_ms"), pause("pause_after_ms")
    rows = segments.where(~silent | before.isNotNull()).select(F.struct(*keys).alias("_g"), "line_ord", F.coalesce("pcm", F.array()).cast("array<double>").alias("_x"), F.when(~silent, before).alias("_b"), F.when(silent, before).otherwise(after).alias("_a"))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "segments")
    none = F.lit(0)
    length = F.size("_x").alias("_l")
    at = totals_before(rows.select("_g", "line_ord", "_row", length, "_b", "_a", F.lit(1).alias("_one")), "_g", ["line_ord", "_row"], {"_i": "_one"})
    at = stage(at, "order")
    prior = at.select(F.col("_g").alias("_pg"), (F.col("_i") + 1).alias("_pi"), F.col("_row").alias("_prior"), F.col("_l").alias("_pl"), F.col("_a").alias("_pa"))
    at = at.join(prior, at["_g"].eqNullSafe(prior["_pg"]) & (at["_i"] == prior["_pi"]), "left")
    room = F.coalesce("_b", F.when(F.col("_i") == 0, lead), "_pa", F.when(F.col("_pl") >= 2 * fade, fade))  # null: it depends on the fade before
    n = F.least(F.lit(fade), room, "_l")
    at = at.select("_g", "_i", "_row", "_prior", "_l", "_b", "_a", F.when(room.isNotNull(), F.when(n > 1, n).otherwise(0)).cast("int").alias("_n"))
    at = stage(at.withColumn("_known", F.col("_n").isNotNull().cast("int")), "fades")
    if not at.where("_known = 0").isEmpty():
        links = totals_before(at.select("_g", "_i", "_row", "_l", "_n", "_known"), "_g", ["_i"], {"_chain": "_known"})
        chain = F.array_sort(F.collect_list(F.struct(F.col("_i"), F.col("_row"), F.col("_l").alias("length"), F.col("_n").alias("fade")))).alias("c")
        chains = links.groupBy("_g", (F.col("_chain") + F.col("_known")).alias("_chain")).agg(chain).where(F.size("c") > 1)
        found = chains.select("c", _fades_of_chain(fade)("c").alias("n")).select(F.explode(F.arrays_zip("c", "n")).alias("z")).select(F.col("z.c._row").alias("_r"), F.col("z.n").alias("_found"))
        at = stage(at.join(found, at["_row"] == found["_r"], "left").withColumn("_n", F.coalesce("_found", "_n")).drop("_r", "_found"), "chains")
    own = F.coalesce("_b", none) + F.col("_l") - F.col("_n") + F.coalesce("_a", none)
    starts = stage(totals_before(at.select("_g", "_i", "_row", "_prior", "_b", "_n", own.alias("_own")), "_g", ["_i"], {"_before": "_own"}), "starts")
    plan = starts.select(F.col("_row").alias("_r"), "_i", "_prior", "_n", "_before")

    u = lambda k, n: k / (n - 1)
    placed = rows.join(plan, rows["_row"] == plan["_r"]).drop("_r")
    head = F.transform(F.slice("_x", 1, F.col("_n")), lambda v, k: v * _gain(u(k, F.col("_n")), curve))
    zeros = lambda m: F.array_repeat(F.lit(0.0), m)
    opening = F.when(F.col("_b").isNotNull(), F.concat(zeros(F.col("_b") - F.col("_n")), head)).otherwise(F.array().cast("array<double>"))
    body = F.concat(opening, F.slice("_x", F.col("_n") + 1, F.greatest(F.lit(0), F.size("_x") - F.col("_n"))), zeros(F.coalesce("_a", none)))
    given = placed.where("_b is null and _n > 0").select(F.col("_prior").alias("_r"), "_g", F.col("_i").alias("_gi"), head.alias("_head"))
    bodies = placed.select("_g", "_i", "_before", "_row", body.alias("_body"))
    ended = bodies.join(given.where("_r is not null").select("_r", "_head"), bodies["_row"] == F.col("_r"), "left")
    m = F.coalesce(F.size("_head"), none)
    keep = F.size("_body") - m
    shared = F.transform("_head", lambda h, k: h + F.get("_body", keep + k) * _gain(1 - u(k, m), curve))
    pcm = F.when(m > 0, F.concat(F.slice("_body", 1, keep), shared)).otherwise(F.col("_body"))
    segments_out = ended.select("_g", (F.col("_i") + 1).alias("part"), (F.col("_before") + lead).alias("start_sample"), pcm.alias("pcm"))
    totals = starts.groupBy("_g").agg(F.count(none).alias("_count"), F.sum("_own").alias("_sum"))
    first = given.where("_gi = 0").select(F.col("_g").alias("_fg"), "_head")
    opened = totals.join(first, totals["_g"].eqNullSafe(first["_fg"]), "left").select("_g", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start_sample"), F.concat(zeros(lead - m), F.coalesce("_head", F.array().cast("array<double>"))).alias("pcm"))
    closed = totals.select("_g", (F.col("_count") + 1).alias("part"), (F.col("_sum") + lead).alias("start_sample"), zeros(F.lit(tail)).alias("pcm"))
    stage.close(rows, starts)
    return segments_out.union(opened).union(closed).select("_g.*", "part", "start_sample", "pcm")


def assembled(segments: DataFrame, keys: list[str], fade_ms: float = 30.0) -> DataFrame:
    """One row per chapter: its segments in order with pauses and crossfades. A chapter is one array in one task; longer ones: ``assembled_parts``."""
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_ord")
        rate = int(pdf["sample_rate"].iloc[0])
        parts = [(np.asarray(x, float), b, a) for x, b, a in zip(pdf["pcm"], pdf["pause_before_ms"], pdf["pause_after_ms"])]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "sample_rate": [rate], "pcm": [au.assemble(parts, rate, fade_ms).tolist()]})

    return segments.groupBy(*keys).applyInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["sample_rate int", "pcm array<double>"]))


def mastered(chapters: DataFrame, to_rate: int = 44_100, target: float = -19.0, limit_dbfs: float = -1.0) -> DataFrame:
    """Gate, gain to loudness, limit, resample and measure; adds ``n``, ``lufs`` and ``peak_dbfs``."""
    out = filtered(chapters, "gate").withColumn("pcm", au.to_loudness("pcm", F.col("sample_rate"), target))
    out = filtered(out.withColumn("pcm", au.limited("pcm", limit_dbfs)), "resample", to_rate).withColumn("sample_rate", F.lit(to_rate))
    return out.withColumns({"n": F.size("pcm"), "lufs": au.loudness("pcm", F.col("sample_rate")), "peak_dbfs": au.peak_dbfs("pcm")})
