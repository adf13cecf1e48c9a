"""Timelines and markers from durations and pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def chapter_markers(durations: DataFrame) -> DataFrame:
    """Start and end in ms of each chapter of ``durations(book_id, number, seconds)``; unknown lasts 0."""
    ms = F.floor(F.coalesce("seconds", F.lit(0.0)) * 1000).cast("long")
    w = Window.partitionBy("book_id").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = durations.select("book_id", "number", ms.alias("ms"))
    end = F.sum("ms").over(w)
    return rows.select("book_id", "number", (end - F.col("ms")).alias("start_ms"), end.alias("end_ms"))


def book_length(durations: DataFrame) -> DataFrame:
    total = durations.groupBy("book_id").agg(F.sum("seconds").alias("seconds"))
    return total.select("book_id", F.round("seconds", 6).alias("seconds"), tx.hms("seconds").alias("duration"))


def segment_timeline(lines: DataFrame, keys: list[str], lead_ms: int = 1000, fade_ms: int = 30) -> DataFrame:
    """Start and end in ms of ``lines(keys, line_ord, audio_ms, pause_before_ms, pause_after_ms)``.

    A chapter opens with silence; each segment overlaps by the fade, at most its own or the preceding part's
    length, with what precedes it: its pause, else the pause or audio before.
    """
    w = Window.partitionBy(*keys).orderBy("line_ord")
    before = F.when(F.col("pause_before_ms") > 0, F.col("pause_before_ms"))
    prior = F.coalesce(before, F.when(F.lag("pause_after_ms").over(w) > 0, F.lag("pause_after_ms").over(w)), F.lag("audio_ms").over(w), F.lit(lead_ms))
    rows = lines.withColumn("fade", F.least(F.lit(fade_ms), F.col("audio_ms"), prior))
    step = F.col("pause_before_ms") + F.col("audio_ms") - F.col("fade") + F.col("pause_after_ms")
    end = lead_ms + F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("pause_after_ms")
    return rows.select(*keys, "line_ord", (end - F.col("audio_ms") + F.col("fade")).cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))


def estimates(books: DataFrame, words_per_minute: float = 150.0) -> DataFrame:
    return books.withColumn("estimated_audio_hours", F.round(F.col("total_words") / words_per_minute / 60, 6))


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Time still to go at the pace so far; null before anything is done, 0 when all is."""
    return F.when(done > 0, F.greatest(F.lit(0.0), elapsed / done * (total - done)))


def export_results(durations: DataFrame, files: DataFrame) -> DataFrame:
    """``(book_id, total_chapters, total_duration, file_size_mb)`` of exports: chapters with their lengths, files with their bytes.

    ``durations(book_id, number, seconds)``: unknown lasts 0. ``files(book_id, bytes)``: a book without files has size 0.
    """
    length = durations.groupBy("book_id").agg(F.count(F.lit(1)).alias("total_chapters"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("_s"))
    size = files.groupBy("book_id").agg((F.sum("bytes") / (1024 * 1024)).alias("_mb"))
    return length.join(size, "book_id", "left").select("book_id", "total_chapters", tx.hms("_s").alias("total_duration"), F.coalesce("_mb", F.lit(0.0)).alias("file_size_mb"))


def export_lists(chapters: DataFrame, durations: DataFrame) -> DataFrame:
    """What an encoder is told for each book: the files to join, and the chapter marks.

    ``chapters(book_id, number, title, path)`` without a duration last 0.
    """
    rows = chapters.join(durations, ["book_id", "number"], "left")
    marks = chapter_markers(rows.select("book_id", "number", "seconds"))
    rows = rows.join(marks, ["book_id", "number"])
    mark = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), "start_ms", F.lit("\nEND="), "end_ms", F.lit("\ntitle="), "title", F.lit("\n"))
    listed = F.concat(F.lit("file '"), tx.escape_concat_path("path"), F.lit("'"))
    out = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("number", listed.alias("file"), mark.alias("mark")))).alias("r"))
    joined = lambda k, sep: F.array_join(F.transform("r", lambda x: x[k]), sep)
    return out.select("book_id", joined("file", "\n").alias("files"), F.concat(F.lit(";FFMETADATA1\n\n"), joined("mark", "\n")).alias("metadata"))
