"""Jaccard components against brute force over all pairs."""

import random
import re

import pytest

from quillspark.llm.jaccard_join import bands, jaccard_components, shingles, tiles, _Words

SCHEMA = "doc_id long, text string, n string"


def brute_set(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, percent=90):
    sets = [brute_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {d: (len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(rows)}


def corpus(seed=3):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "Ab", "aB"]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    docs = [prose(rnd.choice([1, 2, 3, 8, 12, 20, 60, 150, 400])) for _ in range(60)]
    for base in docs[:30]:
        for _ in range(6):  # from near to just too far
            d = list(base)
            for _ in range(rnd.randint(0, 1 + len(d) // 25)):
                d[rnd.randrange(len(d))] = rnd.choice(vocabulary)
            if rnd.random() < 0.5:
                d += prose(rnd.randint(0, 1 + len(d) // 12))
            docs.append(d)
    texts = [" ".join(d) for d in docs]
    texts += [texts[0].upper(), texts[1], texts[1], "", " \t\n", None, "a b c d", "A b c d", "one", "One"]
    passage = " ".join(prose(40))
    texts += [passage + " " + " ".join(prose(k % 7)) for k in range(40)]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [3, 4])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard_components(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_components(empty).count() == 0
    text = " ".join("t%d" % i for i in range(50))
    got = jaccard_components(spark.createDataFrame([(5, text, ""), (5, text, ""), (None, text + " z", ""), (None, None, ""), (7, "x", "")], SCHEMA)).collect()
    assert sorted((r.component_id or -1, r.n_shingles) for r in got) == [(-1, 0), (5, 48), (5, 48), (5, 49), (7, 1)]


def test_linked_sets_share_a_tile():
    import numpy as np

    starts, rnd = np.array(bands(90, 100)), random.Random(2)
    for _ in range(400):
        base = [str(rnd.random()) for _ in range(rnd.choice([10, 11, 15, 19, 30, 47, 200, 1000]))]
        a = np.unique(np.frombuffer(np.random.default_rng(rnd.randrange(1 << 30)).bytes(8 * len(base)), np.uint64))
        drop = rnd.randint(0, len(a) // 10)
        b = np.delete(a, rnd.sample(range(len(a)), drop))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and drop:
            assert len(np.intersect1d(tiles(a, starts, 90, 100), tiles(b, starts, 90, 100)))
    assert len(shingles(b"a b", _Words())) == 1


@pytest.mark.parametrize("small, block, named", [(2, 3, 16), (0, 512, 1), (0, 7, 2)])
def test_large_tiles_are_compared_in_blocks(spark, monkeypatch, small, block, named):
    from quillspark.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "NAMED", named)
    monkeypatch.setattr(jaccard_join, "TASK_BYTES", 500)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rnd = random.Random(8)
    base = ["w%d" % rnd.randrange(900) for _ in range(80)]
    rows = []
    for i in range(60):  # a hub, copies linked through it, and copies just too far from all
        d = list(base)
        for _ in range(0 if i == 30 else rnd.choice([1, 2, 3, 4])):
            d[rnd.randrange(80)] = "x%d" % rnd.randrange(10**6)
        rows.append((i, " ".join(d)))
    got = jaccard_components(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def test_any_shingle_and_percent_match_brute_force(spark):
    rows = corpus(6)
    sets = {d: brute_set(t, 5) for d, t in rows}
    link = {d: [e for e in sets if sets[d] and sets[e] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])] for d in sets}
    want = {d: d for d in sets}
    while (new := {d: min([want[d], *(want[e] for e in link[d])]) for d in sets}) != want:
        want = new
    got = jaccard_components(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(4), shingle=5, percent=80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {d: (len(sets[d]), want[d]) for d in sets}


def test_few_sets_visit_the_tiles_of_empty_parts():
    import numpy as np

    for percent in (80, 90):
        starts, rnd, own = np.array(bands(percent, 100)), np.random.default_rng(5), []
        for n in range(20, 600, 3):
            x = [np.unique(np.frombuffer(rnd.bytes(8 * n), np.uint64)) for _ in range(4)]
            own += [tiles(s, starts, percent, 100) for s in x]
        keys, times = np.unique(np.concatenate(own), return_counts=True)
        assert (times > 1).sum() < len(keys) / 100


def test_pairs_are_decided_in_portions_and_no_text_is_copied(spark, monkeypatch):
    from quillspark.llm import jaccard_join

    staged = []

    class Seen(jaccard_join.Tables):
        def __call__(self, df, label):
            staged.append((label, {f.name for f in df.schema if f.dataType.simpleString() in ("binary", "string")}))
            return super().__call__(df, label)

    monkeypatch.setattr(jaccard_join, "Tables", Seen)
    monkeypatch.setattr(jaccard_join, "PORTION_PAIRS", 4, raising=False)
    rnd, base = random.Random(4), ["w%d" % i for i in range(90)]
    rows = [(i, " ".join([*base[:k], "x%d" % rnd.randrange(10**6), *base[k:]])) for i, k in enumerate(range(0, 90, 10))]
    rows += [rows[3], rows[3], (70, rows[4][1]), (80, ""), (81, None)]
    got = jaccard_components(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)
    assert not any(texts for _, texts in staged)
    assert [label for label, _ in staged].count("links") > 3
