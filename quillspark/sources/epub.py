"""EPUB archives as tables: metadata, spine documents in reading order, covers."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DC, OPF = "{http://purl.org/dc/elements/1.1/}", "{http://www.idpf.org/2007/opf}"
CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"


def read_archive(content: bytes, stem: str = "Unknown") -> dict:
    """Metadata, spine documents and cover of one archive; ValueError if it is none."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        root = ElementTree.fromstring(archive.read("META-INF/container.xml")).find(f".//{CONTAINER}rootfile").get("full-path")
        package = ElementTree.fromstring(archive.read(root))
    except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError) as e:
        raise ValueError(f"not an EPUB archive: {e}") from e
    base = posixpath.dirname(root)
    items = {i.get("id"): (posixpath.normpath(posixpath.join(base, unquote(i.get("href")))), i.get("media-type", ""), i.get("properties") or "") for i in package.iter(f"{OPF}item")}
    names = set(archive.namelist())
    documents = []
    for ref in package.iter(f"{OPF}itemref"):
        path, kind, _ = items.get(ref.get("idref"), (None, "", ""))
        if path in names and "html" in kind:
            documents.append((ref.get("idref"), archive.read(path).decode("utf-8", "replace")))
    images = [(path, kind, extra) for path, kind, extra in items.values() if kind.startswith("image/") and path in names]
    cover = next((i for i in images if "cover-image" in i[2]), None) or next((i for i in images if "cover" in i[0].lower()), None)
    value = lambda tag, default: next((e.text.strip() for e in package.iter(f"{DC}{tag}") if e.text and e.text.strip()), default)
    return {
        "title": value("title", stem),
        "author": value("creator", "Unknown"),
        "language": value("language", "en"),
        "documents": documents,
        "cover": archive.read(cover[0]) if cover else None,
        "cover_type": cover[1] if cover else None,
    }


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(unquote(path)))[0]


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row per archive: ``(path, title, author, language, n_documents, cover, cover_type)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                book = read_archive(content, _stem(p))
                rows.append((p, book["title"], book["author"], book["language"], len(book["documents"]), book["cover"], book["cover_type"]))
            yield pd.DataFrame(rows, columns=["path", "title", "author", "language", "n_documents", "cover", "cover_type"])

    return _files(spark, path).mapInPandas(run, "path string, title string, author string, language string, n_documents int, cover binary, cover_type string")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Spine documents in order: ``(path, spine_ord, item_id, html)``; items without a file are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                docs = read_archive(content, _stem(p))["documents"]
                yield pd.DataFrame([(p, i, ident, html) for i, (ident, html) in enumerate(docs)], columns=["path", "spine_ord", "item_id", "html"])

    return _files(spark, path).mapInPandas(run, "path string, spine_ord int, item_id string, html string")


def raw_chapters(documents: DataFrame, strategy: str = "auto") -> DataFrame:
    """Sections of spine documents as ``(book_id, ord, title, text)``, ready for numbering."""
    from ..operators.html import sections

    rows = sections(documents, ["path", "spine_ord"], strategy=strategy)
    return rows.select(F.col("path").alias("book_id"), (F.col("spine_ord") * 100_000 + F.col("section")).alias("ord"), "title", "text")
