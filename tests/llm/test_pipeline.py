"""The pipeline against plain Python over a small corpus, and its stages over odd rows."""

from collections import defaultdict

import pytest

import corpus_pipeline
from quillspark.llm import rule_quality

from .test_decontaminate import brute as contaminated

DATA = "/root/testdata/sf0.001"


def test_mixing_order_reaches_the_slots(spark):
    from quillspark.runtime import staged

    docs = spark.createDataFrame([(i, f"text {i}", "en", "src0" if i % 3 else "b", 6) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = staged(corpus_pipeline.mixing(spark, docs, DATA), "mixed")
    position = {r.doc_id: r._position for r in corpus_pipeline.mix(docs, corpus_pipeline.SHARES).collect()}
    by_shard = defaultdict(list)
    for r in corpus_pipeline.sharding(spark, mixed, DATA).collect():
        by_shard[r.shard].append((r.slot, position[r.doc_id]))
    assert len(by_shard) == 40
    for own in by_shard.values():
        assert [p for _, p in sorted(own)] == sorted(p for _, p in own)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_pass_every_stage(spark, name, stage):
    docs = spark.createDataFrame([(1, "a b c", "en", None, 5), (1, "a b c", "en", None, 5), (None, "x y z", None, "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, DATA)
    rows = out.collect()
    assert len(rows) == (5 if name == "n-gram Jaccard join" else 6)
    assert name == "sharding" or out.columns == docs.columns
    assert stage(spark, docs.where("false"), DATA).count() == 0


def test_near_copies_by_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(400)]
    cases = []
    for base, copy in [
        (words[:100], [*words[:30], "x", *words[31:60], "y", *words[61:100]]),  # two words changed: 86 of 106
        (words[100:200], [*words[100:200], *(f"f{i}" for i in range(20))]),  # a footer: 96 of 116
        (words[200:300], [*words[200:220], "x", *words[221:240], "y", *words[241:260], "z", *words[261:300]]),  # three words changed: 81 of 111
    ]:
        cases += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(cases)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == [0, 2, 4, 5]


def test_rows_match_brute_force_at_five_words(spark, monkeypatch):
    from .test_jaccard_join import brute_set

    seen = {}
    monkeypatch.setattr(rule_quality, "fit_rules", lambda *a, f=rule_quality.fit_rules: seen.setdefault("model", f(*a)))
    rows = corpus_pipeline.run(spark, DATA).collect()
    got = {r.doc_id for r in rows}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == len(got) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    rules, weights, b = seen["model"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    stats = {d: rule_quality.statistics(t) for d, t in docs}
    kept = [(d, t) for d, t in docs if b + sum(w for r, w in zip(rules, weights) if all((stats[d][j] <= c) == m for j, m, c in r)) >= 0]
    sets = {d: brute_set(t, 5) for d, t in kept}
    link = {d: [e for e in sets if sets[d] and sets[e] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])] for d in sets}
    first = {d: d for d in sets}
    while (new := {d: min([first[d], *(first[e] for e in link[d])]) for d in sets}) != first:
        first = new
    kept = [(d, t) for d, t in kept if first[d] == d]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert got == {d for (d, _), c in zip(kept, contaminated(kept, bench)) if not c[1]}
    size = dict(docs)
    assert all(r["size"] == len(size[r.doc_id].encode()) + 16 for r in rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_long_texts_and_clashing_names(spark, name, stage):
    long = " ".join(f"word{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long, "en", "s", "k"), (2, "a b c", "en", "s", "k"), (3, long + " end", "en", "src0", "k")], "doc_id long, text string, lang string, source string, n_chars string")
    clash = "_h _stats _key _rank _row _score _block _release _deadline _slot _position size shard slot".split()
    docs = docs.selectExpr("*", *(f"doc_id as {c}" for c in clash))
    out = stage(spark, docs, DATA)
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {1, 2, 3} and (name == "quality classifier" or len(rows) == (2 if name == "n-gram Jaccard join" else 3))
    if name != "sharding":
        assert out.columns == docs.columns and all(r[c] == r.doc_id for r in rows for c in clash)
