"""Held-out accuracy, compiled rules against numpy, and odd tables."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm.rule_quality import STATISTICS, compile_rules, fit_quality, fit_rules, held_out, op8_rule_quality, score_quality, statistics

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op8_rule_quality(spark, DATA)
    rows = got.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert right > 0.9 and auc > 0.85, (right, auc)
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_compiled_rules_agree(spark):
    rnd = np.random.default_rng(2)
    x = rnd.random((600, len(STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4)).astype(float)
    rules, weights, b = fit_rules(x, y, trees=5)
    total = b + sum(w * np.all([(x[:, j] <= c) == m for j, m, c in r], 0) for r, w in zip(rules, weights))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *STATISTICS]).select("i", F.struct(*STATISTICS).alias("_stats"))
    got = [r.s for r in df.withColumn("s", compile_rules(rules, weights, b, "_stats")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert np.mean((np.array(got) >= 0.5) == (y == 1)) > 0.97 and len(rules) < 60


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, "x"), (2, "", "x"), (2, " \n", "x"), (3, "w " * 50_000, "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, text int")
    out = score_quality(docs, fit_quality(docs, labels)).collect()
    assert [r._score for r in out] == [0.5] * 5 and out[0].quality == "x"
    one = labels.union(spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0)], labels.schema))
    assert all(0.5 < r._score <= 1 for r in score_quality(docs, fit_quality(docs, one)).collect())
    assert score_quality(docs.where("false"), fit_quality(docs.where("false"), labels)).count() == 0
    assert spark.range(30).select(held_out("id").alias("h")).where("h").count() in range(5, 16)
    assert statistics(None) == statistics(" ") == [0.0] * len(STATISTICS)


def plain_statistics(text):
    """Every statistic by loops over bytes, words and lines."""
    import math
    import re

    data = (text or "").encode()
    words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", data)
    if not words:
        return [0.0] * len(STATISTICS)
    share = lambda allowed: sum(b in allowed for b in data) / len(data)
    upper, lower = (set(range(a, a + 26)) for a in (65, 97))
    letters = sum(b in upper | lower for b in data)
    n = len(words)
    lines = [x for x in data.split(b"\n") if re.search(rb"[^ \t\n\r\x0b\x0c]", x)]
    pairs = list(zip(words, words[1:]))
    of = lambda f: sum(map(f, words)) / n
    cased = lambda w: [b for b in w if b in upper | lower]
    alnum = upper | lower | set(range(48, 58))
    return [
        math.log(n + 1),
        sum(map(len, words)) / n,
        sum(b in upper for b in data) / max(1, letters),
        share(set(range(48, 58))),
        share(set(b".,;:!?'\"()-")),
        share(set(b"#$%&*+/<=>@\\^_`{}~[]")),
        share({124}),
        share(set(range(32)) - {9, 10, 13}),
        of(lambda w: w[0] in upper),
        of(lambda w: w[-1] < 128 and w[-1] not in alnum),
        of(lambda w: len(w) > 1 and bool(cased(w)) and all(b in upper for b in cased(w))),
        len(set(words)) / n,
        max(words.count(w) for w in set(words[:400])) / n if n <= 400 else None,
        sum(a == b for a, b in pairs) / max(1, n - 1),
        len(set(pairs)) / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        n / max(1, sum(b in b".!?" for b in data)),
        of(lambda w: len(w) > 20),
    ]


def test_statistics_match_plain_loops(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", " \n\t", "A", "AB ab 12 É!", "a | b\n\na | b\x01\x0b", "x" * 50 + " " + "y" * 21, "...", "a a a a", "É É É", "One.\nOne.\nTwo"]
    for t in texts:
        for name, got, want in zip(STATISTICS, statistics(t), plain_statistics(t)):
            assert want is None or abs(got - want) < 1e-12, (name, t)


def test_first_split_is_the_best_of_all():
    """The root of the first tree against every split at every cut, by the gain of a Newton step."""
    rnd = np.random.default_rng(5)
    x = rnd.random((200, 4))
    y = ((x[:, 2] > 0.6) ^ (rnd.random(200) < 0.1)).astype(float)
    rules, *_ = fit_rules(x, y, trees=1, depth=1, penalty=0.0)
    p = (y.sum() + 1) / (len(y) + 2)
    best = (-1.0, None)
    for j in range(4):
        cuts = [c for c in sorted(set(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64)))) if c < x[:, j].max()]
        for c in cuts:
            gain = 0.0
            for rows in ([i for i in range(200) if x[i, j] <= c], [i for i in range(200) if x[i, j] > c]):
                if len(rows) < 5:
                    break
                gain += sum(y[i] - p for i in rows) ** 2 / (len(rows) * p * (1 - p) + 1)
            else:
                best = max(best, (gain, (j, c)))
    assert {(r[0][0], r[0][2]) for r in rules} == {best[1]} and {r[0][1] for r in rules} <= {True, False}


def test_weights_are_those_of_the_lasso():
    """At the least of mean loss plus penalty the slope along a kept rule is the penalty, and along the intercept nothing."""
    rnd = np.random.default_rng(6)
    x = rnd.random((800, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7) ^ (rnd.random(800) < 0.1)).astype(float)
    rules, w, b = fit_rules(x, y, trees=6, penalty=0.004)
    held = np.array([[all((v[j] <= c) == m for j, m, c in r) for r in rules] for v in x], float)
    miss = 1 / (1 + np.exp(-(held @ w + b))) - y
    slopes = [sum(m * h for m, h in zip(miss, col)) / len(y) for col in held.T]
    assert len(rules) > 2 and all(abs(s + 0.004 * np.sign(v)) < 4e-4 for s, v in zip(slopes, w)) and abs(miss.mean()) < 4e-4
