"""Quality reports over attempts: ``logs(project_id, line_id, chapter_number, attempt, wer, quality_score, status, details)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import totals_before


def latest_attempts(logs: DataFrame) -> DataFrame:
    """The row of the highest attempt of each line, the first written of equal ones."""
    w = Window.partitionBy("project_id", "line_id").orderBy(F.desc("attempt"), "id")
    return logs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def chapter_summary(logs: DataFrame) -> DataFrame:
    """Counts and means over the rows whose attempt is their line's highest."""
    top = logs.groupBy("project_id", "line_id").agg(F.max("attempt").alias("attempt"))
    last = logs.join(top, ["project_id", "line_id", "attempt"])
    mean = lambda c, f=F.avg: F.coalesce(f(c), F.lit(0.0))
    return last.groupBy("project_id", "chapter_number").agg(
        F.count(F.lit(1)).alias("total_segments"),
        _count(F.col("status") == "pass").alias("passed"),
        _count(F.col("status") == "fail").alias("failed"),
        _count(F.col("status") == "flagged").alias("flagged"),
        F.round(mean("wer"), 9).alias("average_wer"),
        mean("wer", F.max).alias("worst_wer"),
        F.round(mean("quality_score"), 9).alias("average_quality_score"),
        F.coalesce(_count(F.col("attempt") > 1), F.lit(0)).alias("total_retries"),
    )


def project_summary(logs: DataFrame) -> DataFrame:
    """Latest attempt of each line; retries count every row past a first attempt, a null WER counts as 0."""
    flag = lambda name: _count(F.coalesce(F.get_json_object("details", f"$.{name}") == "true", F.lit(False)))
    last = latest_attempts(logs).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_segments"),
        _count(F.col("status") == "pass").alias("passed_segments"),
        F.round(F.avg(F.coalesce("wer", F.lit(0.0))), 9).alias("average_wer"),
        flag("silence_issues").alias("failed_silence"),
        flag("clipping_issues").alias("failed_clipping"),
    )
    return last.join(logs.groupBy("project_id").agg(_count(F.col("attempt") > 1).alias("retries_triggered")), "project_id")


def chapter_report(requested: DataFrame, logs: DataFrame) -> DataFrame:
    """Report of a run: totals over the requested lines, flags frozen at the first attempt."""
    last = latest_attempts(logs)
    first = logs.where((F.col("attempt") == 1) & (F.col("status") == "flagged")).select("project_id", "line_id").distinct().withColumn("was_flagged", F.lit(1))
    rows = requested.join(last.drop("chapter_number"), ["project_id", "line_id"], "left").join(first, ["project_id", "line_id"], "left")
    return rows.groupBy("project_id", "chapter_number").agg(
        F.count(F.lit(1)).alias("total_segments"),
        _count(F.col("status") == "pass").alias("passed"),
        _count(F.col("status") == "fail").alias("failed"),
        F.count("was_flagged").alias("flagged"),
        F.round(F.coalesce(F.avg(F.when(F.col("wer") >= 0, F.col("wer"))), F.lit(0.0)), 9).alias("average_wer"),
        F.coalesce(F.max("wer"), F.lit(0.0)).alias("worst_wer"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("was_flagged") == 1, F.col("line_id")))), ",").alias("flagged_lines"),
    )


def traffic_lights(summary: DataFrame) -> DataFrame:
    rate = F.when(F.col("total_segments") > 0, F.round(F.col("passed_segments") / F.col("total_segments") * 100)).otherwise(0).cast("long")
    out = summary.withColumn("pass_rate", rate)
    light = lambda good, fair: F.when(good, "good").when(fair, "warn").otherwise("bad")
    return out.select(
        "project_id", "pass_rate", light(F.col("pass_rate") > 95, F.col("pass_rate") > 85).alias("rate_light"), light(F.col("average_wer") < 0.02, F.col("average_wer") < 0.05).alias("wer_light")
    )


def book_report(logs: DataFrame, worst: int = 3) -> DataFrame:
    """Mean, median and worst WER of each project, with its worst lines (a top-k report)."""
    last = latest_attempts(logs).where("wer is not null")
    w = Window.partitionBy("project_id").orderBy(F.desc("wer"), "line_id")
    top = last.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= worst).groupBy("project_id")
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line_id"))), lambda r: r["line_id"]), ",").alias("worst_lines"))
    all_lines = last.groupBy("project_id").agg(F.round(F.avg("wer"), 9).alias("average_wer"), F.max("wer").alias("worst_wer"))
    mid = medians(last, "project_id", "wer").select("project_id", F.round("median", 9).alias("median_wer"))
    return all_lines.join(mid, "project_id").join(top, "project_id").select("project_id", "average_wer", "median_wer", "worst_wer", "worst_lines")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, median)``: the exact median of each key's values that aren't null, however many a key has.

    Equal values are counted before they are moved; what comes before a value in its key is a sum over ranges, so that no
    task holds a key. The middle lies in the value, or in the two, that half of the values reach.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = totals_before(counts, key, ["_v"], {"_before": "_n"})
    size = placed.groupBy(F.col(key).alias("_k")).agg(F.sum("_n").alias("_all"))
    placed = placed.join(size, placed[key].eqNullSafe(size["_k"]))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
    middle = placed.where(holds(low) | holds(high)).groupBy(key)
    return middle.agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))


def generation_ratio(spent: DataFrame, audio: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, generation_seconds, audio_seconds, ratio)``: time spent on making sound over the sound made.

    ``spent(keys, seconds)`` and ``audio(keys, seconds)`` may have any number of rows a key; null where there is no sound.
    """
    total = lambda t, name: t.groupBy(*keys).agg(F.sum("seconds").alias(name))
    both = total(spent, "generation_seconds").join(total(audio, "audio_seconds"), keys, "full")
    return both.withColumn("ratio", F.when(F.col("audio_seconds") > 0, F.coalesce("generation_seconds", F.lit(0.0)) / F.col("audio_seconds")))


def best_attempts(logs: DataFrame) -> DataFrame:
    """The attempt of each line with the lowest WER, the earlier of equal ones."""
    rank = F.struct("wer", "attempt")
    return logs.where("wer is not null").groupBy("project_id", "line_id").agg(F.min_by("attempt", rank).alias("attempt"), F.min("wer").alias("wer"))


def character_quality(lines: DataFrame, results: DataFrame) -> DataFrame:
    rows = lines.join(results, "line_id")
    return rows.groupBy("book_id", "speaker").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg("wer"), 9).alias("average_wer"), F.max("wer").alias("worst_wer"))


# Noise floors in decibel up to which a segment is excellent, good, acceptable.
NOISE_BANDS = [(-60.0, "excellent"), (-50.0, "good"), (-40.0, "acceptable")]


def bands(value: Column | str, limits: list[tuple[float, str]], above: str) -> Column:
    """The name of the first limit that the value doesn't reach."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(above)
    for limit, name in reversed(limits):
        out = F.when(v < limit, name).otherwise(out)
    return F.when(v.isNotNull(), out)


def retry_rounds(requested: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """The attempts that a run makes: the first of every line, then further ones of what still fails.

    ``attempts(line_id, attempt, status, ...)`` holds what each attempt would give, one row each. Every round
    works on the lines that failed in the one before, and its result is written before the next.
    """
    from ..runtime import staged

    todo, rounds = requested.select("line_id").distinct(), []
    for n in range(1, most + 1):
        done = staged(todo.join(attempts.where(F.col("attempt") == n), "line_id"), "round")
        rounds.append(done)
        todo = done.where("status = 'fail'").select("line_id")
        if not todo.head(1):
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out
