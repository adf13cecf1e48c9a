"""Script lines: fragments, alignment with recorded model output, overlap, numbering, speakers, pauses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import columns_of, staged, totals_before


def fragment_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(tx.fragments(text)).alias("idx", "fragment"))


def lenient_pause(value: Column, default: int) -> Column:
    """Whole milliseconds; null and 0 give the default."""
    return F.coalesce(F.nullif(value.try_cast("double").cast("int"), F.lit(0)), F.lit(default))


def align(lines: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Give each fragment ``(keys, idx, fragment)`` the metadata whose ``id`` is its position.

    ``meta(keys, pos, id, speaker, emotion, speed, pause_before_ms, pause_after_ms)`` holds strings as they
    came; of rows with one id the last wins, ids that are no numbers go, and missing values get defaults.
    """
    known = meta.withColumn("idx", F.col("id").try_cast("int")).where("idx is not null")
    fields = ["speaker", "emotion", "speed", "pause_before_ms", "pause_after_ms"]
    last = known.groupBy(*keys, "idx").agg(F.max_by(F.struct(*fields), "pos").alias("m"))
    out = lines.join(last, [*keys, "idx"], "left")
    return out.select(
        *keys,
        "idx",
        "fragment",
        F.lower(F.coalesce("m.speaker", F.lit("narrator"))).alias("speaker"),
        F.coalesce("m.emotion", F.lit("neutral")).alias("emotion"),
        F.coalesce(F.col("m.speed").try_cast("double"), F.lit(1.0)).alias("speed"),
        lenient_pause(F.col("m.pause_before_ms"), 0).alias("pause_before_ms"),
        lenient_pause(F.col("m.pause_after_ms"), 500).alias("pause_after_ms"),
    )


def _skips(last: int):
    """For chunks in order, as ``first`` heads with places, ``n`` lines and ``final`` heads: how many lines at the start of each go."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", kind="stable")
        kept = next((list(t) for t in pdf["_tail"] if t is not None), [])
        skips = []
        for first, n, final in zip(pdf["_first"], pdf["_n"], pdf["_final"]):
            seen = set(kept[-last:])
            skip = next((h["_pos"] for h in first if h["_head"] not in seen), n)
            kept = kept[-last:] + [h["_head"] for h in final if h["_pos"] >= skip]
            skips.append(skip)
        return pd.DataFrame({"_g": pdf["_g"], "chunk": pdf["chunk"], "_skip": skips})

    return run


def drop_overlap(lines: DataFrame, keys: list[str], last: int = 20, prefix: int = 80) -> DataFrame:
    """Of ``(keys, chunk, idx, text)`` drop the lines at the start of a chunk that repeat kept lines.

    A line repeats if its first ``prefix`` characters, trimmed and lower-cased, are among the last ``last``
    lines kept so far. What is kept depends on what was kept before, but not without end: the ``last + 1`` first different
    heads of a chunk hold one that isn't among ``last`` lines, and a chunk that keeps ``last`` lines from there on ends alike
    whatever came before. Such chunks cut a chapter into stretches, which are worked out side by side from at most
    ``2 * last + 1`` heads a chunk; a stretch is one group, long only where chunk after chunk is shorter than that. Null texts are
    empty, null keys are a chapter, lines of equal ``idx`` come in any order.
    """
    if last < 1:
        return lines
    head = F.substring(F.lower(tx.strip(F.coalesce("text", F.lit("")))), 1, prefix)
    rows = lines.select(*columns_of(lines), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_g"), head.alias("_head"))
    chunk = Window.partitionBy("_g", "chunk")
    rows = rows.withColumns({"_pos": F.row_number().over(chunk.orderBy("idx")) - 1, "_n": F.count(F.lit(1)).over(chunk).cast("int")})
    rows = staged(rows, "lines").withColumn("_new", F.row_number().over(Window.partitionBy("_g", "chunk", "_head").orderBy("_pos")) == 1)
    rank = F.sum(F.col("_new").cast("int")).over(chunk.orderBy("_pos"))
    few = rows.select("_g", "chunk", "_n", "_pos", "_head", (F.col("_new") & (rank <= last + 1)).alias("_first"), (F.col("_pos") >= F.col("_n") - last).alias("_final")).where("_first or _final")
    heads = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.struct("_pos", "_head")))).alias(c)
    chunks = few.groupBy("_g", "chunk").agg(F.max("_n").alias("_n"), heads("_first"), heads("_final"))
    settled = (F.size("_first") > last) & (F.col("_n") - F.get("_first", F.lit(last))["_pos"] >= last)
    chunks = staged(chunks.withColumn("_settled", F.coalesce(settled, F.lit(False)).cast("int")), "chunks")
    at = chunks.select("_g", "chunk", "_settled")
    at = totals_before(at, "_g", ["chunk"], {"_stretch": "_settled"}).drop("_settled").withColumnsRenamed({"_g": "_h", "chunk": "_c"})
    chunks = staged(chunks.join(at, chunks["_g"].eqNullSafe(at["_h"]) & chunks["chunk"].eqNullSafe(at["_c"])).drop("_h", "_c"), "stretches")
    tails = chunks.where("_settled = 1").select(F.col("_g").alias("_h"), "chunk", (F.col("_stretch") + 1).alias("_s"), F.transform("_final", lambda x: x["_head"]).alias("_tail"))
    tails = tails.drop("chunk")
    known = chunks.join(tails, chunks["_g"].eqNullSafe(tails["_h"]) & (chunks["_stretch"] == tails["_s"]), "left").select("_g", "_stretch", "chunk", "_first", "_n", "_final", "_tail")
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    skips = known.groupBy("_g", "_stretch").applyInPandas(_skips(last), f"_g {kinds['_g']}, chunk {kinds['chunk']}, _skip int").withColumnsRenamed({"_g": "_h", "chunk": "_c"})
    rows = rows.join(skips, rows["_g"].eqNullSafe(skips["_h"]) & rows["chunk"].eqNullSafe(skips["_c"]))
    return rows.where("_pos >= _skip").select(*columns_of(lines))


def line_ids(lines: DataFrame, chapter: str, keys: list[str], order: list[str], first: int = 1) -> DataFrame:
    """Number the lines of each group from ``first`` and name them after their chapter."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + first
    return lines.withColumn("line_id", F.format_string("ch%02d_%03d", F.col(chapter), n))


def previous_summary(chapters: DataFrame) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy("number")
    return chapters.withColumn("previous_summary", F.coalesce(F.lag("summary").over(w), F.lit("")))


def unknown_speakers(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Speakers of ``lines(book_id, ord, speaker)`` that ``registry(book_id, id)`` lacks, by first appearance."""
    named = lines.select("book_id", "ord", tx.speaker_id("speaker").alias("id"))
    new = named.join(registry.select("book_id", "id"), ["book_id", "id"], "left_anti").groupBy("book_id", "id").agg(F.min("ord").alias("first_ord"))
    words = F.replace("id", F.lit("_"), F.lit(" "))
    return new.select("book_id", "id", "first_ord", tx.display_name("id").alias("name"), F.lit("other").alias("gender"), F.concat(F.lit("A neutral voice for the character "), words, F.lit(".")).alias("voice_description"))


def with_voice_effects(lines: DataFrame, characters: DataFrame) -> DataFrame:
    """Lines with the effect settings of their speaker, where there are any."""
    return lines.join(characters.select("book_id", F.col("id").alias("speaker"), "voice_fx"), ["book_id", "speaker"], "left")


def with_voice(lines: DataFrame, voices: DataFrame) -> DataFrame:
    """Lines with their speaker's voice file, else the narrator's."""
    own = voices.select("book_id", F.col("character_id").alias("speaker"), F.col("file").alias("_own"))
    narrator = voices.where("character_id = 'narrator'").select("book_id", F.col("file").alias("_narrator"))
    out = lines.join(own, ["book_id", "speaker"], "left").join(narrator, "book_id", "left")
    return out.withColumn("voice_file", F.coalesce("_own", "_narrator")).drop("_own", "_narrator")


def voice_batches(lines: DataFrame, keys: list[str], size: int = 5) -> DataFrame:
    """Batches of ``size`` lines after sorting by speaker, then line."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("speaker", "line_ord")) - 1
    return lines.withColumn("batch", F.floor(n / size).cast("int"))


def instruction(emotion: Column | str, speed: Column | str) -> Column:
    """What the speech model is told: any emotion that is named, and the pace (fixed phrases and bands)."""
    e, s = tx.c(emotion), tx.c(speed)
    pace = F.when(s < 0.9, "at a slow, measured pace").when(s < 1.0, "at a slightly slower pace").when(s > 1.1, "at a quick, energetic pace").when(s > 1.0, "at a slightly faster pace")
    feeling = F.when(e != "", F.concat(F.lit("Speak with "), e))
    out = F.concat_ws(". ", feeling, pace)
    return F.when(out == "", "").otherwise(F.concat(out, F.lit(".")))


def character_tiers(lines: DataFrame) -> DataFrame:
    """Lines per speaker and its tier: major above 10, supporting from 2, else minor."""
    n = lines.groupBy("book_id", "speaker").agg(F.count(F.lit(1)).alias("n_lines"))
    return n.withColumn("tier", F.when(F.col("n_lines") > 10, "major").when(F.col("n_lines") >= 2, "supporting").otherwise("minor"))


def voice_groups(lines: DataFrame, characters: DataFrame, threshold: int = 3) -> DataFrame:
    """``(book_id, speaker, n_lines, voice)``: who has at most ``threshold`` lines shares a generic voice of their gender.

    The narrator keeps a voice; a speaker that ``characters(book_id, id, gender)`` lacks, or whose gender is null, is ``other``.
    """
    n = lines.groupBy("book_id", "speaker").agg(F.count(F.lit(1)).alias("n_lines"))
    known = characters.groupBy("book_id", F.col("id").alias("speaker")).agg(F.min("gender").alias("_gender"))
    generic = F.concat(F.lit("generic_"), F.coalesce("_gender", F.lit("other")))
    few = (F.col("n_lines") <= threshold) & (F.col("speaker") != "narrator")
    return n.join(known, ["book_id", "speaker"], "left").select("book_id", "speaker", "n_lines", F.when(few, generic).otherwise(F.col("speaker")).alias("voice"))


def pauses_by_breaks(lines: DataFrame, scene: str, paragraph: str) -> DataFrame:
    """``positional_pauses`` with breaks: ``scene`` and ``paragraph`` name columns that say whether a line ends one.

    A scene's end outweighs speech and paragraphs, a chapter's end all; paragraphs count in narration only. Null is no break.
    """
    breaks = lines.select("book_id", "chapter_number", "line_ord", F.when(F.col(scene), 1500).when(F.col(paragraph) & (F.col("speaker") == "narrator"), 600).alias("_break"))
    rows = positional_pauses(lines).join(breaks, ["book_id", "chapter_number", "line_ord"])
    return rows.select("book_id", "chapter_number", "line_ord", "pause_before", F.when(F.col("pause_after") == 2000, 2000).otherwise(F.coalesce("_break", "pause_after")).alias("pause_after"))


def positional_pauses(lines: DataFrame) -> DataFrame:
    """Pauses by place: before a chapter's first line, after its last, after dialogue, after narration."""
    w = Window.partitionBy("book_id", "chapter_number").orderBy("line_ord")
    return lines.select(
        "book_id",
        "chapter_number",
        "line_ord",
        F.when(F.lag("line_ord").over(w).isNull(), 1000).otherwise(0).alias("pause_before"),
        F.when(F.lead("line_ord").over(w).isNull(), 2000).when(F.col("speaker") == "narrator", 500).otherwise(300).alias("pause_after"),
    )


def context_window(lines: DataFrame, around: int = 5) -> DataFrame:
    """Each line with the texts of the lines around it."""
    w = Window.partitionBy("book_id", "chapter_number").orderBy("line_ord").rowsBetween(-around, around)
    return lines.select("book_id", "chapter_number", "line_ord", F.array_join(F.collect_list("text").over(w), "\n").alias("context"))


def packed_segments(lines: DataFrame, keys: list[str], most: int = 4, least_words: int = 3) -> DataFrame:
    """Segments of up to ``most`` fragments ``(keys, idx, fragment)``; one of too few words joins the one before."""
    rows = lines.withColumn("segment", F.floor(F.col("idx") / most).cast("int")).withColumn("_w", tx.word_count("fragment"))
    words = F.sum("_w").over(Window.partitionBy(*keys, "segment"))
    rows = rows.withColumn("segment", F.when((words < least_words) & (F.col("segment") > 0), F.col("segment") - 1).otherwise(F.col("segment")))
    out = rows.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct("idx", "fragment"))).alias("r"), F.sum("_w").cast("long").alias("n_words"))
    return out.select(*keys, "segment", F.size("r").cast("long").alias("n_fragments"), "n_words", F.array_join(F.transform("r", lambda x: x["fragment"]), " ").alias("text"))
