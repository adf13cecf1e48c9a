"""The character registry: merging what chapters say, normalising, capping, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

GENDERS = ["male", "female", "other"]

# The narrator of a book that names none, and what new voices say.
NARRATOR = {
    "name": "Narrator",
    "gender": "male",
    "age_range": "40s",
    "personality_traits": ["measured", "warm", "authoritative"],
    "voice_description": "A warm, mature male baritone, early 40s, with a measured storytelling cadence. Rich and clear with natural gravitas. Thoughtful pauses between phrases.",
    "speaking_style": "Flowing descriptive prose, unhurried",
}
SENTENCES = {
    "male": "The ancient tower stood against the darkening sky, its stones weathered by centuries of wind and rain.",
    "female": "She walked through the moonlit garden, her footsteps barely disturbing the fallen leaves.",
    "other": "The library was vast and silent, filled with the scent of old paper and forgotten memories.",
}


def accumulate(raw: DataFrame) -> DataFrame:
    """One record per normalised id of ``raw(book_id, chapter, raw_id, voice_description, ...)``.

    The whole record with the longest description wins, the earlier of equal ones; a null description counts as empty. The
    position, ``first_chapter`` and ``first_place``, is that of the first mention. ``raw`` may have ``place``, the order within
    a chapter, and any further columns of a record, which are kept; without ``place`` ids of one chapter tie.
    """
    place = F.col("place") if "place" in raw.columns else F.lit(0)
    own = [c for c in raw.columns if c not in ("book_id", "chapter", "raw_id", "place", "id")]
    rows = raw.select("book_id", "chapter", place.cast("int").alias("place"), tx.speaker_id("raw_id", hyphens=True).alias("id"), F.struct(*own).alias("record"))
    rank = F.struct(F.length(F.coalesce("record.voice_description", F.lit(""))), -F.col("chapter"), -F.col("place"))
    first = F.min(F.struct("chapter", "place"))
    out = rows.groupBy("book_id", "id").agg(first.alias("f"), F.max_by("record", rank).alias("record"), F.count(F.lit(1)).alias("mentions"))
    return out.select("book_id", "id", F.col("f.chapter").alias("first_chapter"), F.col("f.place").alias("first_place"), "record.*", "mentions")


def first_tone(raw: DataFrame) -> DataFrame:
    """The first tone of each book that isn't empty."""
    return raw.where("tone <> ''").groupBy("book_id").agg(F.min_by("tone", "chapter").alias("tone"))


def parsed(raw: DataFrame) -> DataFrame:
    """Registry rows of ``raw(book_id, chapter, raw_id, gender, voice_description)``; of equal ids the last wins.

    ``raw`` may also have name, age_range, personality_traits (an array) and speaking_style. What is absent or
    null is: the id as a name, ``unknown``, no traits, empty.
    """
    kinds = {"gender": "string", "voice_description": "string", "name": "string", "age_range": "string", "personality_traits": "array<string>", "speaking_style": "string"}
    given = [(F.col(k) if k in raw.columns else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    rows = raw.select("book_id", "chapter", tx.speaker_id("raw_id", hyphens=True).alias("id"), F.struct(*given).alias("m"))
    last = rows.groupBy("book_id", "id").agg(F.min("chapter").alias("ord"), F.max_by("m", "chapter").alias("m"))
    gender = F.lower(F.coalesce("m.gender", F.lit("other")))
    return last.select(
        "book_id",
        "id",
        "ord",
        F.coalesce("m.name", tx.display_name("id")).alias("name"),
        F.when(gender.isin(GENDERS), gender).otherwise("other").alias("gender"),
        F.coalesce("m.voice_description", F.lit("")).alias("voice_description"),
        F.coalesce("m.age_range", F.lit("unknown")).alias("age_range"),
        F.coalesce("m.personality_traits", F.array().cast("array<string>")).alias("personality_traits"),
        F.coalesce("m.speaking_style", F.lit("")).alias("speaking_style"),
    )


def with_narrator(registry: DataFrame) -> DataFrame:
    """A default narrator, a whole record, for the books that lack one, after all others.

    Columns of ``registry`` that a record hasn't are null for it.
    """
    last = registry.groupBy("book_id").agg(F.max("ord").alias("ord"), F.max((F.col("id") == "narrator").cast("int")).alias("has")).where("has = 0")
    given = {"id": F.lit("narrator"), "ord": F.col("ord") + 1, **{k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in NARRATOR.items()}}
    row = last.select(*(F.col(f.name) if f.name == "book_id" else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in registry.schema))
    return registry.unionByName(row)


def test_sentence(gender: Column | str) -> Column:
    """What a new voice says first, by its gender; any other value is ``other``."""
    table = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(tx.c(gender), F.lit("other"))), F.lit(SENTENCES["other"]))


def capped(registry: DataFrame, most: int = 20) -> DataFrame:
    """The narrator and the first ``most - 1`` others of each book."""
    other = F.row_number().over(Window.partitionBy("book_id", F.col("id") == "narrator").orderBy("ord", "id"))
    return registry.withColumn("_n", other).where((F.col("id") == "narrator") | (F.col("_n") <= most - 1)).drop("_n")


def formatted(registry: DataFrame) -> DataFrame:
    """The registry of each book as a list for a prompt."""
    line = F.concat(F.lit("- **"), "name", F.lit("** (id: `"), "id", F.lit("`, "), "gender", F.lit(", "), "age_range", F.lit("): "), "speaking_style")
    rows = registry.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", line.alias("line")))).alias("rows"))
    return rows.select("book_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("listing"))
