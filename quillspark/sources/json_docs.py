"""JSON documents: books, registries, scripts and voice libraries, read and written whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BOOK, CHARACTER, SCRIPT_CHAPTER, VOICE


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of book documents: ``(path, title, author, number, chapter_title, text, word_count)``."""
    docs = spark.read.schema(BOOK).json(path, multiLine=True).withColumn("path", F.input_file_name())
    return docs.select("path", "metadata.title", "metadata.author", F.explode("chapters").alias("c")).select("path", "title", "author", "c.number", F.col("c.title").alias("chapter_title"), "c.text", "c.word_count")


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    """Characters in the order of the document: ``(path, ord, id, ...)``."""
    docs = spark.read.schema(f"characters map<string,{CHARACTER}>").json(path, multiLine=True).withColumn("path", F.input_file_name())
    return docs.select("path", F.posexplode("characters").alias("ord", "key", "c")).select("path", "ord", F.coalesce("c.id", "key").alias("id"), *[f"c.{n}" for n in ("name", "gender", "age_range", "personality_traits", "voice_description", "speaking_style")])


def read_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all ``chapter_*.json`` of a folder, ordered by chapter number and line."""
    docs = spark.read.schema(SCRIPT_CHAPTER).option("pathGlobFilter", "chapter_*.json").json(folder, multiLine=True)
    return docs.select("chapter_number", "chapter_title", "chapter_summary", F.posexplode("lines").alias("line_ord", "l")).select("chapter_number", "chapter_title", "chapter_summary", "line_ord", "l.*")


def read_voices(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(f"voices map<string,{VOICE}>").json(path, multiLine=True)
    return docs.select(F.explode("voices").alias("character_id", "v")).select("character_id", "v.*")


def write_scripts(lines: DataFrame, folder: str) -> None:
    """One JSON document per chapter, in folders by chapter number."""
    fields = [c for c in lines.columns if c not in ("chapter_number", "chapter_title", "chapter_summary", "line_ord")]
    rows = lines.groupBy("chapter_number", "chapter_title", "chapter_summary").agg(F.array_sort(F.collect_list(F.struct("line_ord", F.struct(*fields).alias("l")))).alias("ls"))
    docs = rows.select("chapter_number", F.col("chapter_number").alias("_dir"), "chapter_title", "chapter_summary", F.transform("ls", lambda x: x["l"]).alias("lines"))
    docs.write.partitionBy("_dir").json(folder)


def write_books(chapters: DataFrame, books: DataFrame, folder: str) -> None:
    """One JSON document per book, in folders by ``_dir``: its metadata with totals, and its chapters by number.

    ``chapters(book_id, number, title, text, word_count)``; ``books(book_id, title, author, language, cover_image_path)``, one row
    a book. A book without chapters has an empty list. A document is one value, so a book must fit one.
    """
    parts = F.array_sort(F.collect_list(F.struct("number", "title", "text", "word_count")))
    rows = chapters.groupBy(F.col("book_id").alias("_dir")).agg(parts.alias("chapters"), F.sum("word_count").alias("_words"))
    docs = books.join(rows, books["book_id"].eqNullSafe(rows["_dir"]), "left")
    listed = F.coalesce("chapters", F.array().cast(rows.schema["chapters"].dataType))
    meta = F.struct("title", "author", "language", F.size(listed).alias("total_chapters"), F.coalesce("_words", F.lit(0)).cast("long").alias("total_words"), "cover_image_path")
    docs.select(F.col("book_id").alias("_dir"), meta.alias("metadata"), listed.alias("chapters")).write.partitionBy("_dir").json(folder)


def write_characters(characters: DataFrame, folder: str, key: str = "book_id") -> None:
    """One registry per ``key``, in folders by ``_dir``: characters by id, in the order of ``ord``; ids are distinct within one."""
    fields = [c for c in characters.columns if c not in (key, "ord")]
    rows = characters.groupBy(F.col(key).alias("_dir")).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("c")))).alias("r"))
    by_id = F.map_from_entries(F.transform("r", lambda x: F.struct(x["c"]["id"], x["c"])))
    rows.select("_dir", by_id.alias("characters")).write.partitionBy("_dir").json(folder)


def write_voices(voices: DataFrame, folder: str, key: str = "project_id") -> None:
    """One voice library per ``key``, in folders by ``_dir``: voices by character, which are distinct within one."""
    fields = [c for c in voices.columns if c not in (key, "character_id")]
    rows = voices.groupBy(F.col(key).alias("_dir")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("character_id", F.struct(*fields).alias("v"))))).alias("voices"))
    rows.select("_dir", F.col("_dir").alias("project_id"), "voices").write.partitionBy("_dir").json(folder)
