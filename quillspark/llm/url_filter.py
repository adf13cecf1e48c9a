"""Operator 5, URL filters: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models over characters are trained from all URLs that a rule decides, one
on the accepted and one on the rejected. Contexts of 0 to ``ORDER`` characters are interpolated (Witten-Bell),
so a long context counts as far as it was seen. A URL without a rule is judged by the difference of the two
log-likelihoods per character, against a threshold calibrated on decided URLs that were held out of training.

Characters fall into ``len(ALPHABET) + 1`` classes, so the counts of all contexts are one array of fixed
size whatever the corpus: tasks count into such arrays, Spark adds them up cell by cell, and what reaches the
driver and the scoring tasks has that proven bound (41 ** 4 cells).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import release, staged

ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&%:#~+@"
SIZE = len(ALPHABET) + 1
ORDER = 3
BINS = 400
_CODE = np.full(256, SIZE - 1, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
_CODE[ord("0") : ord("9") + 1] = ALPHABET.index("0")  # digits are one class
_CODE[ord("A") : ord("Z") + 1] = np.arange(26)

#: (rule, verdict), a rule being host and path.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host_col: str, path_col: str, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, p = rule.split("/", 1)
        fits = ((F.col(host_col) == h) | F.endswith(F.col(host_col), F.lit("." + h))) & F.startswith(F.col(path_col), F.lit("/" + p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the (ORDER + 1)-grams of all texts, each padded in front, and the text of each cell."""
    data = [(t or "").encode() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    flat = _CODE[np.frombuffer(b"".join(data), np.uint8)]
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(flat))
    cell = flat.copy()
    for back in range(1, ORDER + 1):
        prior = np.where(at - back >= start, flat[np.maximum(at - back, 0)], SIZE - 1)
        cell += prior * SIZE**back
    return cell, np.repeat(np.arange(len(data)), sizes)


def _count(batches):
    """Rows (verdict, cell, n): counts of this task, of a bounded number of cells."""
    total = {v: np.zeros(SIZE ** (ORDER + 1), np.int64) for v in ("allow", "block")}
    for batch in batches:
        verdicts = np.asarray(batch.column(0).to_pylist(), object)
        cells, text = _codes(batch.column(1).to_pylist())
        for v, counts in total.items():
            counts += np.bincount(cells[verdicts[text] == v], minlength=len(counts)) if len(cells) else 0
    for v, counts in total.items():
        some = np.flatnonzero(counts)
        for lo in range(0, len(some), 100_000):
            part = some[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(part), pa.string()), pa.array(part), pa.array(counts[part])], names=["verdict", "cell", "n"])


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(character | context) for every cell, interpolating contexts of all orders."""
    p = np.full(SIZE, 1.0 / SIZE)
    for order in range(ORDER + 1):
        c = counts.reshape(SIZE ** (ORDER - order), SIZE**order, SIZE).sum(0).astype(float)
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        shorter = np.broadcast_to(p.reshape(1, SIZE), (1, SIZE)) if order == 0 else np.tile(p.reshape(-1, SIZE), (SIZE, 1))[: SIZE**order]
        p = (c + np.maximum(kinds, 1) * shorter) / (total + np.maximum(kinds, 1))
    return np.log(p).ravel()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", held_out: int = 5) -> DataFrame:
    """Host, path, rule and verdict of every URL; returns ``(id, host, path, rule, verdict, score)``.

    ``score`` is the difference of log-likelihoods per character, above 0 for likelier accepted; it is
    compared with a threshold, which maximises balanced accuracy over the ``1 / held_out`` of the decided
    URLs (by crc32) that don't train. Where only one verdict or none was learnt, all URLs without a rule get
    that verdict, or allow. Null URLs and URLs without ``://`` have empty host and path, and an empty or null
    URL has score 0. URLs of any length are read whole. Repeated rows and null ids keep a row each; an empty table gives an empty table; other
    columns are ignored.
    """
    spark = pages.sparkSession
    t = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    t = t.withColumn("_r", matching_rule("host", "path", rules)).withColumn("_out", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(held_out)) == 0)
    decided = t.where("_r is not null")
    counts = decided.where(~F.col("_out")).select("_r.verdict", "url").mapInArrow(_count, "verdict string, cell long, n long")
    counts = counts.groupBy((F.col("verdict") == "allow").alias("allow"), F.col("cell").cast("int").alias("cell")).agg(F.sum("n").alias("n"))
    table = staged(counts, "counts")
    counts = table.toPandas()
    release(table)
    table, seen = {}, []
    for v in ("allow", "block"):
        c = np.zeros(SIZE ** (ORDER + 1))
        own = counts[counts["allow"] == (v == "allow")]
        c[own.cell.to_numpy()] = own.n.to_numpy()
        table[v] = log_probabilities(c)
        seen += [v] if len(own) else []
    ratio = spark.sparkContext.broadcast((table["allow"] - table["block"]).astype(np.float32))

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        cells, text = _codes(urls.tolist())
        total = np.bincount(text, ratio.value[cells], len(urls))
        return pd.Series(total / np.maximum(np.bincount(text, minlength=len(urls)), 1))

    t = t.withColumn("score", score("url"))
    if len(seen) == 2:
        binned = t.where(F.col("_r").isNotNull() & F.col("_out")).groupBy(F.floor(F.greatest(F.lit(-5.0), F.least(F.lit(4.99), "score")) * (BINS / 10)).alias("bin")).agg(
            F.count(F.when(F.col("_r.verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("_r.verdict") == "block", 1)).alias("block")
        )
        hist = binned.toPandas()
        at, allow, block = np.arange(-BINS // 2, BINS // 2 + 1), np.zeros(BINS + 1), np.zeros(BINS + 1)
        allow[hist.bin.to_numpy(int) + BINS // 2], block[hist.bin.to_numpy(int) + BINS // 2] = hist["allow"], hist["block"]
        above = allow[::-1].cumsum()[::-1] / max(1, allow.sum()) + (block.sum() - block[::-1].cumsum()[::-1]) / max(1, block.sum())
        best = np.flatnonzero(above >= above.max() - 1e-12)
        threshold = float(at[best[np.argmin(np.abs(at[best]))]]) / (BINS / 10)
        model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    else:
        model = F.lit(seen[0] if seen else "allow")
    out = t.select(F.col("_id").alias(id_col), "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", model).alias("verdict"), "score")
    return out


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
