"""From raw sections to numbered chapters, and from chapters to word chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import staged, totals_before

# Titles of sections that aren't read, and lines that open a chapter.
SKIPPED_TITLES = [
    r"table\s+of\s+contents|contents",
    r"appendix|appendices",
    r"glossary|dramatis\s+personae",
    r"maps?",
    r"(?:acknowledgment|acknowledgement)s?",
    r"dedication|copyright|colophon",
    r"about\s+the\s+author",
    r"also\s+by|other\s+books?\s+by",
    r"preview|excerpt|teaser",
]
HEADING_LINES = [r"(?:chapter|part)\s+(?:\d+|[ivxlcdm]+)", r"(?:prologue|epilogue|interlude)\b"]

#: What a join may send to every task: rows of a few numbers and an id.
BROADCAST_ROWS = 100_000


def is_skipped_title(title: Column | str) -> Column:
    return F.regexp_like(tx.c(title), F.lit(r"(?iU)\b(?:" + "|".join(SKIPPED_TITLES) + r")\b"))


def is_skipped_document(title: Column | str, text: Column | str) -> Column:
    """Skip by title; a document without one is skipped if it holds fewer than 50 characters."""
    bare = F.length(F.regexp_replace(F.coalesce(tx.c(text), F.lit("")), r"(?U)^\s+|\s+\z", ""))
    t = F.coalesce(tx.c(title), F.lit(""))
    return F.when(t == "", bare < 50).otherwise(is_skipped_title(t))


def is_heading_line(line: Column | str) -> Column:
    line = tx.c(line)
    return F.regexp_like(line, F.lit(r"(?iU)^(?:" + "|".join(HEADING_LINES) + ")")) | F.regexp_like(line, F.lit(r"(?U)^\d+\.\s"))


def split_by_heading_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(keys, section, title, body)``: text before the first heading and empty bodies go.

    Lines are numbered by position and sections by a running count of headings, both inside one document.
    """
    lines = docs.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line"))
    w = Window.partitionBy(*keys).orderBy("_at")
    lines = lines.withColumn("section", F.sum(is_heading_line("_line").cast("int")).over(w)).where("section > 0")
    out = lines.groupBy(*keys, "section").agg(
        F.min_by(F.regexp_extract("_line", r"(?iU)^((?:chapter|part)\s+(?:\d+|[ivxlcdm]+)|prologue|epilogue|interlude|\d+\.)", 1), "_at").alias("title"),
        F.array_sort(F.collect_list(F.struct("_at", "_line"))).alias("_lines"),
    )
    body = tx.strip(F.array_join(F.transform(F.slice("_lines", 2, 1 << 30), lambda x: x["_line"]), "\n"))
    return out.select(*keys, F.col("section").cast("int").alias("section"), "title", body.alias("body")).where("body <> ''")


def cleaned_sections(raw: DataFrame) -> DataFrame:
    """``raw(book_id, ord, title, text)`` with the text cleaned and its words counted, written once; ``_row`` names a row."""
    clean = raw.select("book_id", "ord", "title", F.length("text").alias("raw_chars"), F.when(F.col("text").isNotNull(), tx.cleaned("text")).alias("text"))
    return staged(clean.select("*", tx.word_count("text").alias("n_words"), F.monotonically_increasing_id().alias("_row")), "sections")


def chapters(raw: DataFrame, min_words: int = 100, max_words: int = 20_000) -> DataFrame:
    """Clean, filter, split and number ``raw(book_id, ord, title, text)``.

    Chapters below ``min_words`` go, longer ones than ``max_words`` become parts of that many words, and
    numbers run over all parts of a book. A book of which nothing survives is one chapter "Full Text".
    Numbers come from counts of parts alone; texts are cleaned once and meet them by row.
    """
    clean = cleaned_sections(raw)
    parts = F.when(F.col("n_words") > max_words, F.ceil(F.col("n_words") / max_words)).otherwise(1).cast("int")
    kept = clean.where(F.col("n_words") >= min_words)
    numbers = totals_before(kept.select("book_id", "ord", "_row", parts.alias("parts")), "book_id", ["ord", "_row"], {"_before": "parts"})
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.array_join(F.slice(w, i * max_words + 1, F.lit(max_words)), " "))
    texts = F.when(F.col("parts") > 1, F.get(F.transform(F.array(tx.word_list("text")), cut), F.lit(0))).otherwise(F.array("text"))  # split once a section
    rows = kept.join(numbers.select("_row", "parts", "_before"), "_row").select("book_id", "title", "parts", "_before", "n_words", F.posexplode(texts).alias("_at", "text")).withColumn("part", F.col("_at") + 1)
    number = (F.col("_before") + F.col("part")).cast("int")
    title = F.when(F.col("title") == "", F.concat(F.lit("Chapter "), number)).otherwise(F.when(F.col("parts") > 1, F.concat("title", F.lit(" (Part "), "part", F.lit(")"))).otherwise(F.col("title")))
    words = F.when(F.col("parts") > 1, F.least(F.lit(max_words), F.col("n_words") - F.col("_at") * max_words)).otherwise(F.col("n_words"))
    out = rows.select("book_id", number.alias("number"), title.alias("title"), "text", words.alias("word_count"))
    return out.union(full_text(clean.join(kept.select("book_id").distinct(), "book_id", "left_anti")))


def full_text(clean: DataFrame) -> DataFrame:
    """Each book of ``clean(book_id, ord, raw_chars, text)`` as one chapter, for books that fit one value; others: ``full_text_parts``.

    Sections whose raw text is null or empty are no parts; those that are empty once cleaned are.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")
    whole = clean.where("raw_chars > 0").groupBy("book_id").agg(joined.alias("text")).where(tx.strip("text") != "")
    return whole.select("book_id", F.lit(1).alias("number"), F.lit("Full Text").alias("title"), "text", tx.word_count("text").alias("word_count"))


def full_text_parts(clean: DataFrame) -> DataFrame:
    """``(book_id, part, start_char, text, n_words)``: the full text of books of any size, as parts in order.

    ``clean`` is what ``cleaned_sections`` returns. ``start_char`` is where a part begins when the parts of a book are
    joined by an empty line. Null and empty raw texts are no parts; a book of blanks alone has none.
    """
    some = clean.where("raw_chars > 0")
    sizes = some.select("book_id", "ord", "_row", F.lit(1).alias("_one"), (F.length("text") + 2).alias("_chars"), (F.col("n_words") > 0).cast("int").alias("_words"))
    at = totals_before(sizes, "book_id", ["ord", "_row"], {"part": "_one", "start_char": "_chars"})
    rows = some.join(at.select("_row", "part", "start_char"), "_row")
    blank = sizes.groupBy("book_id").agg(F.max("_words").alias("_any")).where("_any = 0")
    return rows.join(blank, rows["book_id"].eqNullSafe(blank["book_id"]), "left_anti").select("book_id", "part", "start_char", "text", "n_words")


def book_totals(chapter_rows: DataFrame) -> DataFrame:
    return chapter_rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("total_chapters"), F.sum("word_count").cast("long").alias("total_words"))


def word_chunks(docs: DataFrame, keys: list[str], size: int, overlap: int, text: str = "text") -> DataFrame:
    """Windows of ``size`` words that overlap; a text of up to ``size`` words is one window."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk")
    words = docs.select(*keys, tx.word_list(text).alias("_w")).where(F.size("_w") > 0)
    last = F.when(F.size("_w") > size, F.ceil((F.size("_w") - size) / (size - overlap))).otherwise(0).cast("int")
    rows = words.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = F.col("chunk") * (size - overlap)
    own = F.slice("_w", start + 1, F.lit(size))
    return rows.select(*keys, "chunk", start.alias("start_word"), F.size(own).alias("n_words"), F.array_join(own, " ").alias("text"))


def context_budget(chapter_rows: DataFrame, limit: int = 25_000, whole_below: int = 15_000, summary: int = 500) -> DataFrame:
    """Leading chapters of each book that fit a budget of characters: the first whole, others summarised.

    Lengths alone are summed, over ranges, and texts meet what fits by a broadcast while that has at most
    ``BROADCAST_ROWS`` rows, else by a shuffle. The numbers of a book are distinct. A chapter without a title or text has a null
    entry of no length.
    """
    label = lambda name: F.concat(F.lit("## "), "title", F.lit(f" [{name}]\n\n"))
    full, short = F.concat(label("FULL TEXT"), "text"), F.concat(label("SUMMARY"), tx.to_last_stop("text", summary))
    sizes = chapter_rows.select("book_id", "number", F.length(short).alias("_short"), F.when(F.length("text") < whole_below, F.length(full)).alias("_full"), F.lit(1).alias("_one"))
    at = staged(totals_before(sizes, "book_id", ["number"], {"_i": "_one", "_sum": "_short"}), "budget")
    whole = (F.col("_i") == 0) & F.col("_full").isNotNull()
    more = at.where(whole).select(F.col("book_id").alias("_book"), (F.col("_full") - F.coalesce("_short", F.lit(0))).alias("_more"))
    used = F.col("_sum") + F.coalesce("_short", F.lit(0)) + F.coalesce("_more", F.lit(0))
    kept = at.join(more, at["book_id"].eqNullSafe(F.col("_book")), "left").select(F.col("book_id").alias("_b"), F.col("number").alias("_k"), whole.alias("_whole"), used.alias("used"))
    kept = staged(kept.where(F.col("used") <= limit), "kept")
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    rows = chapter_rows.join(kept, chapter_rows["book_id"].eqNullSafe(F.col("_b")) & chapter_rows["number"].eqNullSafe(F.col("_k")))
    strategy, entry = F.when(F.col("_whole"), "FULL TEXT").otherwise("SUMMARY"), F.when(F.col("_whole"), full).otherwise(short)
    return rows.select("book_id", "number", strategy.alias("strategy"), entry.alias("entry"), "used")
