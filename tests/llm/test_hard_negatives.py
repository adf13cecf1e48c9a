"""Hard negatives against the SQL and against loops over all rows."""

import math

from pyspark.sql import functions as F

from quillspark.llm.hard_negatives import OP11_SQL, hard_negatives, inner_products, op11_hard_negatives

from ..oracle import connect, oracle_rows, rows_of

DATA = "/root/testdata/sf0.01"


def brute(rows, is_anchor, k=5, m=10):
    good = [(i, v, [math.floor(256 * c) for c in x], lab) for i, (v, x, lab) in enumerate(rows) if v is not None and lab is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, a, x, lab in good:
        if is_anchor(a):
            scored = [(-sum(p * q for p, q in zip(x, y)), b, l2) for j, b, y, l2 in good if j != i and len(x) == len(y)]
            for s, b, _ in sorted(s for s in scored if s[2] == lab)[:k]:
                hard = sorted((t, c) for t, c, l2 in scored if l2 != lab and -30 * s <= -100 * t <= -90 * s)[:m]
                out += [(a, b, r, c, -s, -t) for r, (t, c) in enumerate(hard, 1)]
    return sorted(out)


def test_query_agrees_with_sql(spark):
    assert rows_of(op11_hard_negatives(spark, DATA)) == oracle_rows(connect(DATA), OP11_SQL)


def test_small_blocks_and_whole_ties(spark):
    rows = [(r.vec_id % 97, [round(c, 1) for c in r.embedding[:6]], r.label % 3) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 300").collect()]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives(t, F.col("vec_id") % 10 == 0, block=(40, 7))
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda a: a % 10 == 0)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 1.0], 2), (3, [0.5, 1.0], 2), (4, [0.2, 0.0], 3), (5, None, 1), (6, [nan, 1.0], 1),
        (7, [None, 1.0], 2), (8, [0.5, 0.5], None), (None, [0.5, 0.0], 2), (9, [0.5], 2), (10, [], 1), (11, [float("inf"), 0.0], 2), (20, [-1.0, 0.0], 9), (30, [-1.0, 0.0], 9), (40, [1.0, 0.0], 8),
    ]
    t = spark.createDataFrame([(a, b, c, 0, "x") for a, b, c in rows], "vec_id long, embedding array<double>, label int, row int, `a.b` string")
    got = sorted(map(tuple, hard_negatives(t, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(rows, lambda a: a % 10 == 0) and got
    assert hard_negatives(t.limit(0), F.lit(True)).collect() == []
    assert hard_negatives(t, F.lit(None).cast("boolean")).collect() == []


def test_labels_of_text_and_wide_numbers(spark):
    big = 2.0**20
    rows = [(0, [big, 1.0], "a"), (1, [big, 2.0], "a"), (2, [big * 0.8, 3.0], "b"), (3, [big, 3.0], "b")]
    got = hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda a: a == 0)
    import numpy as np

    wide = np.array([[2**62, 2**62], [-(2**62), -(2**62)]])
    assert inner_products(wide, wide).tolist() == [[2**63 - 1, -(2**63)], [-(2**63), 2**63 - 1]]
