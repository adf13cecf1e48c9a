"""Whitening against numpy over exact integers."""

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm.whitening import op13_whitening, whiten

DATA = "/root/testdata/sf0.01"


def exact(vectors):
    xs = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = sorted({tuple(x) for x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    return xs, n, sums, cov


def test_query_agrees_with_numpy(spark):
    source = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    xs, n, sums, cov = exact([r.embedding for r in source])
    e, u = np.linalg.eigh(cov)
    got = {(r.vec_id, r.component): r for r in op13_whitening(spark, DATA).collect()}
    assert len(got) == 4 * len(source)
    for j in range(4):
        v, value = u[:, -1 - j], e[-1 - j]
        want = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in xs]) @ v / np.sqrt(value)
        have = np.array([got[r.vec_id, j + 1].whitened for r in source])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-9
    for r, x in zip(source, xs):
        row = got[r.vec_id, 2]
        assert row.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) and row.n == n
        assert abs(row.explained - e[-2] / e.sum()) < 1e-9 and row.identity_error < 1e-9
    assert len({r.identity_error for r in got.values()}) == 1


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [-1.0, 0.5]), (4, None), (5, [1.0, nan]), (6, [1.0, None]), (7, [float("inf"), 0.0]), (8, [1.0]), (9, [])]
    t = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "vec_id long, embedding array<float>, component int, `a.b` string")
    out = whiten(t).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r.n for r in out} == {3} and all(r.identity_error < 1e-12 for r in out)
    assert whiten(t.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.5])], [(1, [0.0, 1.0]), (2, [0.0, 3.0])]])
def test_without_variance(spark, rows):
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("component").collect()
    flat = [r for r in out if r.whitened is None]
    assert len(flat) == (2 if len(rows) == 1 else 2) and len(out) == 2 * len(rows)
    assert (out[0].explained is None) == (len(rows) == 1)


def test_numbers_past_64_bits_are_exact(spark):
    big = 2.0**44
    rows = [(1, [big, 1.0]), (2, [-big, 2.0]), (3, [big / 2, 4.0])]
    xs, n, sums, _ = exact([v for _, v in rows])
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation for r in out] == [Decimal(sum((n * a - s) ** 2 for a, s in zip(x, sums))) for x in xs]
