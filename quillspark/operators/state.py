"""Job state: upserts, cascading deletes, JSON merges, selections, schedules, transitions and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Tables, columns_of, totals_before

# Where a run resumes, and the stages that follow each status.
RESUMES = {"paused": "created", "error": "created", "paused_scheduled": "created", "deploy_paused": "created", "extracting": "created"}
STAGES = ["scripting", "bootstrapping", "generating", "mastering", "exporting"]
NEXT = {"created": "scripting", "scripting": "scripting", "bootstrapping": "bootstrapping", "generating": "generating", "mastering": "mastering", "exporting": "exporting"}


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` replace those of ``table`` with their key; keys of ``rows`` are distinct."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key isn't listed; unknown keys are no error."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def merged_json(old: Column | str, new: Column | str) -> Column:
    """Shallow merge of flat JSON objects: keys of ``new`` win. Values keep their JSON text (strings unquoted)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    read = lambda c: F.coalesce(F.from_json(col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = read(old), read(new)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def merged_state(old: Column | str, new: Column | str) -> Column:
    """Shallow merge of JSON objects as JSON text: keys of ``new`` win, values of any kind stay as they are."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    read = lambda c: F.coalesce(F.try_parse_json(col(c)).cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    a, b = read(old), read(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def add_if_absent(items: Column | str, item: Column | str) -> Column:
    item = F.col(item) if isinstance(item, str) else item
    return F.array_union(items, F.array(item))


def selected(chapters: DataFrame, selection: DataFrame | None, key: str = "number") -> DataFrame:
    """All chapters without a selection, else those it lists."""
    return chapters if selection is None else chapters.join(selection.select(key).distinct(), key, "left_semi")


def remaining(chapters: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return chapters.join(done.select(*keys).distinct(), keys, "left_anti")


def in_window(day: Column, time: Column, days: Column, start: Column, end: Column) -> Column:
    """Whether a weekday name and an "HH:mm" lie in a window, both ends included; windows may pass midnight.

    A null or empty list of days means all days; a missing start is 00:00, a missing end 23:59.
    """
    start, end = F.coalesce(start, F.lit("00:00")), F.coalesce(end, F.lit("23:59"))
    of_day = F.coalesce((F.size(days) == 0) | F.array_contains(days, day), days.isNull())
    inside = F.when(start <= end, (time >= start) & (time <= end)).otherwise((time >= start) | (time <= end))
    return F.coalesce(of_day & inside, F.lit(False))


def may_run(times: DataFrame, windows: DataFrame) -> DataFrame:
    """``times(id, day, time)`` that lie in any of ``windows(days, start, end)``; without windows none is barred.

    The windows of a schedule are a short list, read as one scalar.
    """
    listed = windows.agg(F.collect_list(F.struct("days", "start", "end")).alias("w")).scalar()
    ok = F.exists("_w", lambda x: in_window(F.col("day"), F.col("time"), x["days"], x["start"], x["end"]))
    return times.withColumn("_w", listed).withColumn("allowed", (F.size("_w") == 0) | ok).drop("_w")


def stages_to_run(status: Column | str, selective: Column | None = None) -> Column:
    """Stages that a job in this status still runs, in order; a run of selected chapters always ends in an export."""
    s = F.col(status) if isinstance(status, str) else status
    table = {**NEXT, **{k: NEXT[v] for k, v in RESUMES.items()}}
    out = F.array().cast("array<string>")
    for name, first in table.items():
        out = F.when(s == name, F.array(*[F.lit(x) for x in STAGES[STAGES.index(first) :]])).otherwise(out)
    if selective is None:
        return out
    return F.when(selective & ~F.array_contains(out, "exporting"), F.array(F.lit("exporting"))).otherwise(out)


def coarse_status(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.isin("error", "paused", "complete"), s).otherwise("running")


def chapter_grid(jobs: DataFrame) -> DataFrame:
    """One row per chapter of ``jobs`` with its state, the furthest that holds.

    ``jobs`` has project_id, total, the arrays scripted, generated and mastered, and the chapters at work (null:
    none) generating and scripting. A job of no chapters has no rows.
    """
    rows = jobs.where("total > 0").select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "total"))).alias("chapter"))
    has = lambda c: F.array_contains(c, F.col("chapter"))
    at = lambda c: F.col(c) == F.col("chapter")
    state = F.when(has("mastered"), "Done").when(has("generated"), "Master").when(at("generating"), "Gen").when(has("scripted"), "Scripted").when(at("scripting"), "Script").otherwise("Pending")
    return rows.select("project_id", "chapter", state.alias("state"))


def stage_percent(stage: Column, done: Column, total: Column, bootstrapped: Column | None = None) -> Column:
    """Progress of a stage in whole percent, halves up, at most 100.

    A chapter being generated or validated counts half; voices count a quarter until they are all made, an
    export half.
    """
    share = F.when(total > 0, done / total * 100).otherwise(0.0)
    busy = F.when(total > 0, (done + F.when(done < total, 0.5).otherwise(0.0)) / total * 100).otherwise(0.0)
    voices = F.lit(25.0) if bootstrapped is None else F.when(bootstrapped, 100.0).otherwise(25.0)
    pct = F.when(stage == "complete", 100.0).when(stage.isin("generating", "validating"), busy).when(stage == "bootstrapping", voices).when(stage == "exporting", 50.0).otherwise(share)
    return F.least(F.lit(100.0), F.floor(pct + 0.5).cast("double"))


def percent(done: Column, total: Column) -> Column:
    """One decimal, ties to even, 0 of nothing."""
    return F.when(total > 0, F.bround(done / total * 100, 1)).otherwise(0.0)


def chapter_ranges(spec: Column | str) -> Column:
    """Chapters of a selector such as ``1-3,7``, sorted and distinct; parts that are no range go."""
    s = F.col(spec) if isinstance(spec, str) else spec
    parts = F.filter(F.split(F.regexp_replace(s, " ", ""), ","), lambda p: F.regexp_like(p, F.lit(r"^\d+(-\d+)?$")))

    def one(p: Column) -> Column:
        lo, hi = F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))


def overlaid(base: DataFrame, over: DataFrame) -> DataFrame:
    """Dictionary overlay ``(word, replacement)``: entries of ``over`` win."""
    rows = base.select("word", "replacement", F.lit(0).alias("p")).union(over.select("word", "replacement", F.lit(1).alias("p")))
    return rows.groupBy("word").agg(F.max_by("replacement", "p").alias("replacement"))


def all_or_list(chosen: Column, total: Column) -> Column:
    """A selection of everything is no selection."""
    return F.when(F.size(F.array_distinct(chosen)) < total, F.array_sort(F.array_distinct(chosen)))


def free_slugs(rows: DataFrame, taken: DataFrame, key: str, order: str) -> DataFrame:
    """Names for many requests at once: ``rows(key, slug, ...)`` with ``project_id``, all distinct and none of ``taken(slug)``.

    The first request of a slug, by ``order``, gets the slug itself if it isn't taken. The others get ``slug-1``, ``slug-2``
    and so on, the k-th of them the k-th number whose name is neither taken nor a slug that is asked for. Numbers are
    found without trying: the numbers that can't be had are sorted, and one of them lies before the k-th free
    one if fewer than k free ones lie before it; both counts are sums over ranges, so that a slug may be asked for by any
    number of rows. Keys are distinct; a null slug has a null name. ``rows`` should be narrow.
    """
    stage, one = Tables(), F.lit(1).alias("_one")
    held = taken.where("slug is not null").select("slug").distinct().withColumn("_taken", F.lit(1))
    asked = stage(rows.where("slug is not null").select("slug").distinct(), "slugs")
    name, number = F.regexp_extract("slug", r"(?s)^(.*)-[1-9][0-9]{0,17}$", 1), F.regexp_extract("slug", r"-([1-9][0-9]{0,17})$", 1)
    gone = held.select("slug").union(asked).distinct().where(number != "").select(name.alias("slug"), number.cast("long").alias("_k"), one)
    gone = totals_before(gone.join(asked, "slug", "left_semi"), "slug", ["_k"], {"_before": "_one"})
    gone = gone.select("slug", (F.col("_k") - 1 - F.col("_before")).alias("_free"), one, F.lit(None).alias("_row"))  # free numbers before it
    turns = stage(totals_before(rows.select("slug", F.col(order).alias("_o"), F.struct(*columns_of(rows)).alias("_row"), F.col(key).alias("_key"), one), "slug", ["_o", "_key"], {"_turn": "_one"}), "turns")
    turns = stage(turns.join(held, "slug", "left").select("slug", "_row", (F.col("_turn") - F.when(F.col("_taken").isNull(), 1).otherwise(0)).alias("_free")), "turns")
    bare = turns.where("_free < 0").select("_row.*", F.col("slug").alias("project_id"))
    events = turns.where("_free >= 0").select("slug", "_free", F.lit(0).alias("_one"), "_row").unionByName(gone.withColumn("_row", F.col("_row").cast(turns.schema["_row"].dataType)))
    events = events.withColumn("_kind", 1 - F.col("_one"))
    found = totals_before(events, "slug", ["_free", "_kind"], {"_skipped": "_one"}).where("_kind = 1")
    made = F.concat("slug", F.lit("-"), (F.col("_free") + 1 + F.col("_skipped")).cast("string"))
    return bare.union(found.select("_row.*", made.alias("project_id")))


def newest(files: DataFrame, keys: list[str]) -> DataFrame:
    """The latest file of each key of ``files(path, modified)``, by path where times are equal."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
