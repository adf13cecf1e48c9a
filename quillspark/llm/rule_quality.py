"""Operator 8, quality classifier as a sparse rule ensemble.

Every text is reduced to a few statistics. Shallow trees are grown one after another on the residuals of the
labelled rows, their root-to-node paths become conjunctive rules, and a logistic model with a lasso penalty
keeps few of them. The rules and weights are compiled into one Spark column expression over the statistics,
so scoring is generated code. Fitting takes at most ``fit_rows`` labelled rows, chosen by hash; statistics
and scores cover every row. The score's inputs are statistics of the text alone.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Tables, columns_of

STATISTICS = [
    "log_words",
    "mean_word_chars",
    "upper_share",
    "digit_share",
    "mark_share",
    "symbol_share",
    "pipe_share",
    "odd_char_share",
    "capital_word_share",
    "marked_word_share",
    "shouted_share",
    "distinct_word_share",
    "top_word_share",
    "same_as_before_share",
    "distinct_pair_share",
    "repeated_line_share",
    "words_per_line",
    "words_per_sentence",
    "long_word_share",
]
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_MARK = np.isin(_BYTES, [ord(c) for c in ".,;:!?'\"()-"])
_SYMBOL = np.isin(_BYTES, [ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"])
_ODD = (_BYTES < 32) & ~np.isin(_BYTES, [9, 10, 13])


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, 0 for each that has no base (an empty text has none)."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars, n = len(data), len(words)
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    per_word = np.bincount(code)
    pairs = code[:-1] * len(ids) + code[1:]
    distinct = list(ids)
    first = per_word[[i for i, w in enumerate(distinct) if 65 <= w[0] <= 90]].sum() if distinct else 0
    marked = per_word[[i for i, w in enumerate(distinct) if not (w[-1:].isalnum() or w[-1] >= 128)]].sum()
    shouted = per_word[[i for i, w in enumerate(distinct) if len(w) > 1 and w.isupper()]].sum()
    long = per_word[[i for i, w in enumerate(distinct) if len(w) > 20]].sum()
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = counts[_UPPER].sum() + counts[_LOWER].sum()
    return [
        math.log1p(n),
        sum(map(len, words)) / n,
        counts[_UPPER].sum() / max(1, letters),
        counts[_DIGIT].sum() / chars,
        counts[_MARK].sum() / chars,
        counts[_SYMBOL].sum() / chars,
        counts[124] / chars,
        counts[_ODD].sum() / chars,
        first / n,
        marked / n,
        shouted / n,
        len(ids) / n,
        per_word.max() / n,
        (code[1:] == code[:-1]).sum() / max(1, n - 1),
        len(np.unique(pairs)) / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        n / max(1, counts[46] + counts[33] + counts[63]),
        long / n,
    ]


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def text_statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=STATISTICS, dtype=float)


Rule = tuple[tuple[int, bool, float], ...]  # of (statistic, at most?, cut)


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, depth: int, least: int, out: list[Rule], fit: np.ndarray) -> None:
    """Split ``rows`` on the best cut, add every node's path to ``out`` and the leaf values to ``fit``."""
    g, h = grad[rows], hess[rows]
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        base = g.sum() ** 2 / (h.sum() + 1)
        for j, own in enumerate(cuts):
            if not len(own):
                continue
            b = bins[rows, j]
            gl, hl, nl = (np.bincount(b, v, len(own) + 1).cumsum()[:-1] for v in (g, h, np.ones(len(rows))))
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        fit[rows] += 0.3 * g.sum() / (h.sum() + 1)
        return
    j, k = best[1]
    left = bins[rows, j] <= k
    for side, at_most in ((rows[left], True), (rows[~left], False)):
        own = (*path, (j, at_most, float(cuts[j][k])))
        out.append(own)
        _grow(x, bins, cuts, grad, hess, side, own, depth - 1, least, out, fit)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002) -> tuple[list[Rule], np.ndarray, float]:
    """Rules, weights and intercept of the ensemble; rows of one class or none give the intercept alone."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return [], np.zeros(0), math.log(share / (1 - share)) if len(y) else 0.0
    cuts = [np.unique(np.quantile(v, np.linspace(0.01, 0.99, 64))) for v in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T)]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    fit, found = np.full(len(y), math.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-fit))
        _grow(x, bins, cuts, y - p, p * (1 - p), np.arange(len(y)), (), depth, max(5, len(y) // 400), found, fit)
    rules = list(dict.fromkeys(found))
    held = np.stack([reduce(np.logical_and, [(x[:, j] <= c) == at_most for j, at_most, c in r]) for r in rules], 1).astype(float)
    w, b = np.zeros(len(rules)), math.log(share / (1 - share))
    v, c, t = w, b, 1.0
    step = 4 / (np.linalg.norm(np.column_stack((held, np.ones(len(y)))), 2) ** 2 / len(y))
    for _ in range(400):  # accelerated proximal gradient
        e = (1 / (1 + np.exp(-(held @ v + c))) - y) / len(y)
        new = v - step * (held.T @ e)
        new, new_b = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0), c - step * e.sum()
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (last - 1) / t * (new - w), new_b + (last - 1) / t * (new_b - b)
        w, b = new, new_b
    kept = np.flatnonzero(w)
    return [rules[i] for i in kept], w[kept], float(b)


def compile_rules(rules: list[Rule], weights: np.ndarray, intercept: float, stats: str) -> Column:
    """The ensemble as a column over the struct ``stats``."""
    total = F.lit(float(intercept))
    for rule, w in zip(rules, weights):
        tests = [F.col(f"{stats}.{STATISTICS[j]}") <= F.lit(c) if at_most else F.col(f"{stats}.{STATISTICS[j]}") > F.lit(c) for j, at_most, c in rule]
        total = total + F.when(reduce(lambda a, b: a & b, tests), F.lit(float(w))).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 20_000) -> Column:
    """Fit on labelled documents outside the held-out third; the score as a column over struct ``_stats``.

    At most ``fit_rows`` labelled rows, by hash of id and text, are taken, and only their statistics are computed. Null labels, null ids and labels of
    unknown documents are left out; an id labelled both ways counts once per label. Without usable labels the
    score is 0.5, with labels of one kind it is their smoothed share.
    """
    stage, seed = Tables(), F.xxhash64("_id", "_h")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t"))
    labelled = stage(rows.select("_id", "_h").join(known, "_id").withColumn("_o", seed), "labelled")
    share = 1.2 * fit_rows / max(1, labelled.count())
    some = labelled
    if share < 1:  # so that tasks don't each send as many rows as the bound allows in all
        some = labelled.where(F.pmod("_o", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    some = stage(some.orderBy("_o", "_y").limit(fit_rows), "sample")
    texts = rows.join(F.broadcast(some.select("_id", "_h").distinct()), ["_id", "_h"]).groupBy("_id", "_h").agg(F.first("_t").alias("_t"))
    stats = stage(texts.select("_id", "_h", text_statistics(F.col("_t")).alias("_stats")), "statistics")
    sample = some.join(stats, ["_id", "_h"]).select("_stats.*", "_y", "_o").orderBy("_o", "_y", *STATISTICS).toPandas()
    stage.close()
    rules, weights, intercept = fit_rules(sample[STATISTICS].to_numpy(float), (sample["_y"] == 1).to_numpy(float))
    return compile_rules(rules, weights, intercept, "_stats")


def score_quality(docs: DataFrame, score: Column, text_col: str = "text") -> DataFrame:
    """Add ``_score`` (0 to 1) to every row of ``docs``; null, empty and blank texts are scored alike.

    All columns are kept, but for one named ``_score``, which the score replaces.
    """
    out = docs.select(F.struct(*columns_of(docs)).alias("_row"), text_statistics(F.col(text_col)).alias("_stats"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "_score"], score.alias("_score"))


def op8_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    score = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, score)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
