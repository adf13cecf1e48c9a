"""Operator 11, hard-negative mining: every anchor's scores sorted, limits found by binary search.

Components become whole numbers, so scores are whole numbers and ties are real ties, broken by the smaller id. All
rows are scored against all anchors block by block: a task holds one block of rows and one of anchors, whatever the
tables hold, and a label of a third of the rows is spread over the blocks like any other. A first pass keeps each
block's best rows of the anchor's label, from which the positives follow. In the second a block's scores are sorted by
score and id for each anchor; the place of a positive's upper limit is found by binary search, and the rows after it
that are above the lower limit are the block's hard negatives. Blocks are merged by rank, a few rows of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Tables
from .whitening import whole

#: Rows and anchors of a block: with 64 components 16 MB and 2 MB of numbers in a task.
ROWS, ANCHORS = 32_768, 4_096
#: Scores held at a time in a task.
HELD = 4_000_000


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    return np.asarray(table["x"].combine_chunks().flatten(), np.int64).reshape(table.num_rows, dim)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all rows of ``a`` with all of ``b``, at the limits of 64 bits where they pass them."""
    most = float(np.abs(a, dtype=np.float64).max(initial=0)) * float(np.abs(b, dtype=np.float64).max(initial=0)) * a.shape[1]
    if most < 1 << 53:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    ends = np.iinfo(np.int64)
    return np.array([[min(max(sum(int(p) * int(q) for p, q in zip(x, y)), ends.min), ends.max) for y in b] for x in a], np.int64).reshape(len(a), len(b))


def _scored(anchors: pa.Table, rows: pa.Table, dim: int, same: bool):
    """(anchor, rows by id, scores) of every anchor, with the rows of its label only, or those of all others."""
    a, label, mine = _matrix(anchors, dim), np.asarray(rows["label"]), np.asarray(anchors["label"])
    by_id = np.argsort(np.asarray(rows["vec"]), kind="stable")
    x, label = _matrix(rows, dim)[by_id], label[by_id]
    for own in np.unique(mine):
        here = np.flatnonzero(label == own if same else label != own)
        group, b = np.flatnonzero(mine == own), x[here]
        width = max(1, HELD // max(1, len(here)))
        for lo in range(0, len(group) if len(here) else 0, width):
            some = group[lo : lo + width]
            for i, s in zip(some.tolist(), inner_products(a[some], b)):
                yield i, by_id[here], s


def _positives(k: int):
    """The first ``k`` rows of each anchor's label in this block, without the anchor: (a_row, row, vec, score)."""

    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a_row, row, vec = np.asarray(anchors["row"]), np.asarray(rows["row"]), np.asarray(rows["vec"])
        out = [np.empty((0, 4), np.int64)]
        for i, at, s in _scored(anchors, rows, key[2].as_py(), True):
            best = np.argsort(-s, kind="stable")[: k + 1]  # by score, then by id
            best = best[row[at[best]] != a_row[i]][:k]
            out.append(np.column_stack((np.full(len(best), a_row[i]), row[at[best]], vec[at[best]], s[best])))
        return pa.table(dict(zip(("a_row", "row", "vec", "score"), map(pa.array, np.concatenate(out).T.copy()))))

    return run


def _negatives(k: int, low: int, high: int):
    """For each anchor and positive the first ``k`` rows of other labels between the limits: (a_row, p_row, vec, score)."""

    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a_row, vec, of = np.asarray(anchors["row"]), np.asarray(rows["vec"]), anchors["positives"].to_pylist()
        out = [np.empty((0, 4), np.int64)]
        for i, at, s in _scored(anchors, rows, key[2].as_py(), False):
            order = np.argsort(-s, kind="stable")  # rows come by id: together a sort by score and id
            falling = -s[order]
            for p in of[i]:
                start = int(np.searchsorted(falling, -(high * p["score"] // 100)))
                best = order[start : start + k]
                best = best[s[best] >= -(-low * p["score"] // 100)]
                out.append(np.column_stack((np.full(len(best), a_row[i]), np.full(len(best), p["row"]), vec[at[best]], s[best])))
        return pa.table(dict(zip(("a_row", "p_row", "vec", "score"), map(pa.array, np.concatenate(out).T.copy()))))

    return run


def _blocks(row: str, size: int, rows: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(max(1, math.ceil(rows / size)))).cast("int")


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    block: tuple[int, int] = (ROWS, ANCHORS),
) -> DataFrame:
    """Hard negatives of the rows where ``anchor`` holds, for each of their best ``positives`` rows of equal label.

    A score is the inner product of the vectors' ``floor(scale * c)``; higher come first, then smaller ids. Of the rows
    of other labels whose score is at least ``low`` and at most ``high`` percent of the positive's, the first
    ``negatives`` are returned as ``(anchor_id, positive_id, rank int from 1, negative_id, positive_score long,
    negative_score long)``. A positive of negative score has none.

    Rows take no part whose id, label or vector is null or whose vector holds null or non-finite components.
    Only vectors of equal length are compared. Rows that repeat an id are rows of their own: as anchors each has its
    own results, and an equal row is a positive. Rows that tie in score and id are taken in any order. Scores stay
    within 64 bits. An empty table, or one without anchors, gives an empty table; other columns are ignored. ``label``
    defaults to the column of that name, and ids are whole numbers. Scoring grows with anchors times rows.
    """
    stage = Tables()
    t = rows.select(F.col(id_col).cast("long").alias("vec"), (F.col("label") if label is None else label).alias("_label"), whole(vec_col, scale).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    t = t.where("vec is not null and _label is not null and x is not null").withColumn("row", F.monotonically_increasing_id())
    # Labels of any type are known by a hash, which is the number itself for whole numbers.
    kind = t.schema["_label"].dataType.simpleString()
    t = t.withColumn("label", F.col("_label").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("_label")).drop("_label")
    t = stage(t.withColumn("dim", F.size("x")), "vectors")
    queries = t.where("anchor")
    n, m = t.count(), queries.count()
    parts = max(1, math.ceil(n / block[0])), max(1, math.ceil(m / block[1]))

    def met(anchors: DataFrame):
        a = anchors.withColumn("a", _blocks("row", block[1], m)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts[0] - 1))))
        b = t.select("row", "vec", "label", "dim", "x").withColumn("b", _blocks("row", block[0], n)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1))))
        return a.groupBy("a", "b", "dim").cogroup(b.groupBy("a", "b", "dim"))

    def first(found: DataFrame, key: list[str], k: int, rank: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec")
        return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)

    vectors = queries.select("row", "label", "dim", "x")
    near = met(vectors).applyInArrow(_positives(positives), "a_row long, row long, vec long, score long")
    near = stage(first(near, ["a_row"], positives, "place"), "positives")
    own = near.groupBy("a_row").agg(F.collect_list(F.struct("row", "score")).alias("positives"))  # at most ``positives`` of them
    asked = stage(vectors.join(own, vectors["row"] == own["a_row"]).drop("a_row"), "asked")
    far = met(asked).applyInArrow(_negatives(negatives, low, high), "a_row long, p_row long, vec long, score long")
    far = stage(first(far, ["a_row", "p_row"], negatives, "rank"), "negatives")
    named = near.select("a_row", F.col("row").alias("p_row"), F.col("vec").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = queries.select(F.col("row").alias("a_row"), F.col("vec").alias("anchor_id"))
    stage.close(t, near, far)
    out = far.join(named, ["a_row", "p_row"]).join(ids, "a_row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    label = F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec % 100 == 0, label=label)


OP11_SQL = """
WITH x AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
list_transform(embedding, lambda c: floor(256 * c::double)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS a, b.r AS br, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.x, b.x)::bigint AS s
FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.x) = len(b.x)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::int AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
WINDOW w AS (PARTITION BY p.ar, p.br ORDER BY n.s DESC, n.b) QUALIFY row_number() OVER w <= 10
"""
