"""Metadata from saved answers of a book catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = "struct<volumeInfo:struct<title:string,authors:array<string>,description:string,industryIdentifiers:array<struct<type:string,identifier:string>>,imageLinks:map<string,string>>>"
# Sizes of images in the order of choice, and kinds of numbers that are an ISBN.
IMAGES = ["extraLarge", "large", "medium", "thumbnail", "smallThumbnail"]
ISBN = ["ISBN_13", "ISBN_10"]


def best_image(links: Column) -> Column:
    """The first size that has a link, over https and at the largest zoom; null if none has."""
    link = F.coalesce(*[F.nullif(F.try_element_at(links, F.lit(s)), F.lit("")) for s in IMAGES])
    return F.replace(F.replace(link, F.lit("http://"), F.lit("https://")), F.lit("zoom=1"), F.lit("zoom=3"))


def book_metadata(answers: DataFrame, body: str) -> DataFrame:
    """Title, authors, description, ISBN (the first one listed) and image of the first item of each answer.

    Answers that are null, no JSON or without items have nulls, and empty texts for what the first item lacks.
    """
    info = F.get("_a.items", F.lit(0))["volumeInfo"]
    rows = answers.withColumn("_a", F.from_json(body, f"struct<items:array<{_ITEM}>>"))
    first = F.try_element_at(F.filter(info["industryIdentifiers"], lambda x: x["type"].isin(ISBN)), F.lit(1))
    given = lambda c: F.when(info.isNotNull(), F.coalesce(c, F.lit("")))
    return rows.select(
        *answers.columns,
        info["title"].alias("title"),
        F.coalesce(F.array_join(info["authors"], ", "), F.lit("")).alias("author"),
        given(info["description"]).alias("description"),
        given(first["identifier"]).alias("isbn"),
        best_image(info["imageLinks"]).alias("image"),
    )
