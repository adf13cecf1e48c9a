"""Operator 3, benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). Its shingles of
``shingle`` words are ordered by rarity, counted over all documents. A document can hold a window only where
it holds the window's rarest shingle, so that one necessary token is the whole prefix to join on; windows
with a shingle that no document has are dropped. The token's place in the window fixes where the window
would start (positional bound), that it must fit into the document (length bound), and the words there are
compared exactly.

The exploded words of a document meet the tokens inside one generated-code stage: no word is shuffled and
only hits leave it. The tokens are broadcast while they number at most ``broadcast_rows`` (checked by a
count); beyond that they are joined by a shuffle, and each word row then carries just the words around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Tables, null_safe

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in order; the first and the last element may be empty, none between them is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.split(F.coalesce(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit("")), NO_WORD)


def _count(w: str) -> Column:
    first, last = F.get(w, F.lit(0)) == "", F.get(w, F.size(w) - 1) == ""
    return F.when(F.size(w) == 1, F.when(first, 0).otherwise(1)).otherwise(F.size(w) - first.cast("int") - last.cast("int")).cast("long")


def _token(w: str, at: str, n: int) -> Column:
    return F.xxhash64(*[F.expr(f"get({w}, {at} + {i})") for i in range(n)])


def _windows(bench: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    w = bench.select(F.col(item_col).cast("string").alias("item"), F.filter(words(F.col(text_col)), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    out = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("win"))
    return out.withColumn("wid", F.xxhash64("win")).distinct()


def _exploded(docs: DataFrame, n: int) -> DataFrame:
    return docs.select("_id", "_h", "w", F.posexplode_outer("w").alias("p", "_x")).withColumn("token", F.xxhash64("_x", *[F.expr(f"get(w, p + {i})") for i in range(1, n)]))


def _hits(docs: DataFrame, wins: DataFrame, n: int, window: int, broadcast_rows: int, stage: Tables) -> DataFrame:
    """Occurrences (_id, _h, s, e, wid) of windows of at least ``n`` words, found by shingles of ``n`` words."""
    places = wins.select("wid", "win", F.explode(F.sequence(F.lit(0), F.size("win") - n)).alias("off")).withColumn("token", _token("win", "off", n))
    places = stage(places, "places")
    tokens = places.select("token").distinct()
    known = stage(tokens, "tokens")
    small = known.count() <= broadcast_rows
    seen = _exploded(docs, n).select("token").join(F.broadcast(known) if small else known, "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = places.join(stage(seen, "rarity"), "token", "left")
    rarest = ranked.groupBy("wid", "win").agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min_by(F.struct("token", "off"), F.struct(F.coalesce("df", F.lit(0)), "off")).alias("t"))
    prefix = stage(rarest.where("least > 0").select("wid", "win", F.size("win").alias("len"), "t.token", "t.off"), "prefix")
    rows = _exploded(docs, n)
    start = F.col("p") - F.col("off")
    if prefix.count() <= broadcast_rows:
        met = rows.join(F.broadcast(prefix), "token").where((start >= 0) & (start + F.col("len") <= F.size("w")))
        met = met.where(F.expr("slice(w, p - off + 1, len)") == F.col("win"))
    else:
        before = F.least("p", F.lit(window - 1))
        rows = rows.select("_id", "_h", "p", "token", before.alias("before"), F.expr(f"slice(w, p - least(p, {window - 1}) + 1, {2 * window - 1})").alias("near"))
        met = rows.join(prefix, "token").where((F.col("off") <= F.col("before")) & (F.expr("slice(near, before - off + 1, len)") == F.col("win")))
    return met.select("_id", "_h", start.alias("s"), (start + F.col("len")).alias("e"), "wid")


def contaminated_words(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, broadcast_rows: int = 200_000
) -> DataFrame:
    """Find the document words that lie in an occurrence of a benchmark window.

    Returns ``(id, _h, n_words, n_hit, items)`` with a row for each row of ``docs``; ``items`` are the sorted
    ids, as strings, of the items of which a window occurs. ``_h`` is xxhash64 of the text, with which the id
    tells rows apart. Null and empty texts have no words; items without words have no window; an item with a
    null id hits words but isn't named. Rows that repeat (in either table), share an id or have a null id
    keep a row each; texts of any length are read whole. Empty tables give no hits or an empty table; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), words(F.col(text_col)).alias("w"))
    stage = Tables()
    wins = stage(_windows(bench, item_col, item_text_col, window), "windows")
    texts = wins.select("wid", "win").distinct()
    hits = _hits(base, texts.where(F.size("win") >= shingle), shingle, window, broadcast_rows, stage)
    short = texts.where(F.size("win") < shingle)
    if short.head(1):
        hits = hits.union(_hits(base, short, 1, window, broadcast_rows, stage))
    hits = stage(hits, "hits")
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")),
        lambda a: a["n"],
    )
    spans = hits.groupBy("_id", "_h").agg(F.collect_set(F.struct("s", "e")).alias("spans")).select("_id", "_h", covered.alias("n_hit"))
    named = hits.select("_id", "_h", "wid").distinct().join(wins.select("wid", "item"), "wid")
    named = named.groupBy("_id", "_h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.join(named, null_safe(spans, named, "_id", "_h")).select(spans["_id"], spans["_h"], "n_hit", "items")
    found = stage(found, "found")
    stage.close(found)
    base = base.select("_id", "_h", _count("w").alias("n_words"))
    out = base.join(found, null_safe(base, found, "_id", "_h"), "left")
    out = out.select(base["_id"], base["_h"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumnRenamed("_id", id_col)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS t, least(len(w), 10) AS n FROM k),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, s, win.n, item_id FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM g) x JOIN win ON win.t = x.t AND win.n = x.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS items FROM m GROUP BY 1)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(h.n_hit, 0)::bigint AS n_hit, coalesce(i.n_items, 0)::bigint AS n_items,
sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
