"""Integrated loudness of known tones, and of noise against a loop over samples."""

import math

import numpy as np
import pytest

from quillspark.operators.loudness import _biquads, bounds, integrated_loudness, weighted


def by_loop(x, rate):
    """Sample by sample, block by block."""
    y = list(map(float, x))
    for b, a in _biquads(rate):
        x1 = x2 = y1 = y2 = 0.0
        out = []
        for v in y:
            w = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            x1, x2, y1, y2 = v, x1, w, y1
            out.append(w)
        y = out
    lo, hi = bounds(rate, len(x))
    z = [sum(v * v for v in y[a:b]) / (0.4 * rate) for a, b in zip(lo, hi)]
    level = lambda v: -0.691 + 10 * math.log10(v) if v > 0 else -math.inf
    loud = [v for v in z if level(v) >= -70]
    if not loud:
        return -70.0
    gate = level(sum(loud) / len(loud)) - 10
    kept = [v for v in z if level(v) > gate and level(v) > -70]
    return level(sum(kept) / len(kept)) if kept else -70.0


def test_filter_in_runs_equals_sample_by_sample():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal(1000)
    whole, end = weighted(x, 8000)
    state, parts = None, []
    for a, b in ((0, 0), (0, 1), (1, 130), (130, 131), (131, 700), (700, 1000)):
        y, state = weighted(x[a:b], 8000, state)
        parts.append(y)
    assert np.allclose(np.concatenate(parts), whole) and np.allclose(state, end)


@pytest.mark.parametrize("rate", [48_000, 24_000])
def test_tone_of_known_level(spark, rate):
    """At 997 Hz the weighting is 0.69 dB, which the offset takes back: full scale is -3.01."""
    t = np.arange(6 * rate) / rate
    rows = []
    for name, gain in (("full", 1.0), ("soft", 0.1)):
        x = gain * np.sin(2 * math.pi * 997 * t)
        rows += [(name, k, rate, x[a : a + 9999].tolist()) for k, a in enumerate(range(0, len(x), 9999))]
    got = {r.audio: r.lufs for r in integrated_loudness(spark.createDataFrame(rows, "audio string, piece int, sample_rate int, pcm array<float>").repartition(3)).collect()}
    assert got["full"] == pytest.approx(-3.01, abs=0.1) and got["soft"] == pytest.approx(-23.01, abs=0.1)


def test_noise_against_a_loop(spark):
    rnd, rate, rows, want = np.random.default_rng(2), 8000, [], {}
    for name, n in (("a", 30_000), ("b", 3_201), ("c", 3_200), ("d", 3_199), ("e", 15_000), (None, 10_000), ("quiet", 9_000), ("nothing", 7_000)):
        x = rnd.standard_normal(n) * np.where(np.arange(n) < n // 3, 0.5, 0.02)  # a soft end that the second gate leaves out
        x = x * {"quiet": 1e-5, "nothing": 0.0}.get(name, 1.0)
        want[name] = by_loop(x, rate)
        cuts = np.unique(np.concatenate(([0, n], rnd.integers(0, n, 9))))
        rows += [(name, int(k), rate, x[a:b].tolist(), "x") for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows += [("a", 99, rate, [], "x"), ("b", 99, rate, None, "x"), ("null", 0, rate, None, "x")]
    want["null"] = -70.0
    df = spark.createDataFrame(rows, "audio string, piece long, sample_rate int, pcm array<double>, block string").repartition(5)
    got = {r.audio: r.lufs for r in integrated_loudness(df).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert want["quiet"] == want["nothing"] == want["d"] == -70 and want["a"] > -20
    assert integrated_loudness(df.where("false")).collect() == []
