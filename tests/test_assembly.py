import numpy as np
import pytest

from quillspark.functions import audio as au
from quillspark.operators import audio as op

RATE = 1000
ROWS = [
    # chapter, line, samples, pause before, pause after
    ("a", 1, 40, 0, 0),
    ("a", 2, 100, 0, 0),
    ("a", 3, 12, 0, 0),  # shorter than a fade, between sounds
    ("a", 4, 25, 0, 0),
    ("a", 5, 0, 0, 0),
    ("a", 6, 9, 0, 0),
    ("a", 7, 70, 5, 3),
    ("a", 8, 70, 0, 0),
    ("a", 9, 1, 0, 2),
    ("b", 1, 33, 50, 0),
    (None, 1, 21, 0, 1),
]


def samples(rows):
    r = np.random.default_rng(3)
    return [(c, i, r.normal(size=n).tolist(), b, a) for c, i, n, b, a in rows]


def by_hand(lines, fade, lead, tail):
    """Pieces as lists; a sample is changed one at a time."""
    pieces = [[0.0] * lead]
    for x, before, after in lines:
        x = list(x)
        if before:
            pieces.append([0.0] * before)
        n = min(fade, len(pieces[-1]), len(x))
        if n > 1:
            for k in range(n):
                angle = k / (n - 1) * np.pi / 2
                at = len(pieces[-1]) - n + k
                pieces[-1][at] = pieces[-1][at] * np.cos(angle) + x[k] * np.sin(angle)
            x = x[n:]
        pieces.append(x)
        if after:
            pieces.append([0.0] * after)
    return [v for p in [*pieces, [0.0] * tail] for v in p]


def chapters(rows):
    out = {}
    for c, _, x, b, a in rows:
        out.setdefault(c, []).append((x, b, a))
    return out


def test_one_array_by_places():
    for lines in chapters(samples(ROWS)).values():
        got = au.assemble([(np.array(x), b, a) for x, b, a in lines], RATE, 30, 50, 20)
        assert np.allclose(got, by_hand(lines, 30, 50, 20))
    assert len(au.assemble([], RATE)) == 0


def test_parts_in_order_are_the_chapter(spark):
    rows = samples(ROWS)
    df = spark.createDataFrame(rows, "ch string, line_ord int, pcm array<double>, pause_before_ms int, pause_after_ms int").repartition(4)
    parts = op.assembled_parts(df, ["ch"], RATE, 30, 50, 20).collect()
    for c, lines in chapters(rows).items():
        own = sorted((p for p in parts if p.ch == c), key=lambda p: p.part)
        assert [p.part for p in own] == list(range(len(lines) + 2))
        assert [p.start_sample for p in own] == np.cumsum([0] + [len(p.pcm) for p in own])[:-1].tolist()
        assert np.allclose([v for p in own for v in p.pcm], by_hand(lines, 30, 50, 20))


def test_null_samples_pauses_and_empty_table(spark):
    schema = "ch int, line_ord int, pcm array<float>, pause_before_ms int, pause_after_ms int, part string"
    rows = [(1, 1, None, 7, 9, "x"), (1, 2, [1.0, 1.0, 1.0], None, None, "x"), (1, 3, None, None, 9, "x"), (2, 1, None, 0, 4, "x")]
    got = {(p.ch, p.part): p.pcm for p in op.assembled_parts(spark.createDataFrame(rows, schema), ["ch"], RATE, 2, 3, 1).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3)}
    assert np.allclose(sum((got[1, k] for k in range(4)), []), [0.0] * 3 + [0.0] * 6 + [1.0, 1.0] + [0.0])
    assert op.assembled_parts(spark.createDataFrame([], schema), ["ch"], RATE).collect() == []


@pytest.mark.parametrize("curve", ["linear", "exponential"])
def test_curves(spark, curve):
    x = [1.0] * 10
    whole = au.assemble([(np.array(x), 0, 0), (np.array(x), 0, 0)], RATE, 4, 0, 0, curve)
    assert whole[6] == pytest.approx(1.0) and whole[9] == pytest.approx(1.0) and len(whole) == 16
    if curve == "linear":
        assert np.allclose(whole, 1.0)
    df = spark.createDataFrame([(1, 1, x, 0, 0), (1, 2, x, 0, 0)], "ch int, line_ord int, pcm array<double>, pause_before_ms int, pause_after_ms int")
    parts = sorted(op.assembled_parts(df, ["ch"], RATE, 4, 0, 0, curve).collect(), key=lambda p: p.part)
    assert np.allclose([v for p in parts for v in p.pcm], whole)
