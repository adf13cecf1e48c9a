"""Mixing: windows, deviation and whole rows. Sharding: balance, groups and slots."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm.mixing import mix
from quillspark.llm.sharding import difference, shard


def test_every_prefix_is_within_a_block(spark):
    shares = {"a": 7, "b": 3, "c": 2, None: 1}
    rows = [(i, s) for s, n in (("a", 700), ("b", 300), ("c", 200), (None, 100), ("d", 100)) for i in range(n)]
    out = mix(spark.createDataFrame(rows, "doc_id long, source string").repartition(4), shares, block_rows=5).orderBy("_position").collect()
    assert len(out) == len(rows) and len({r._position for r in out}) == len(rows)
    slots = [r for r in out if r._position % 5 == 0]
    done, period = Counter(), 14
    for t, r in enumerate(slots):
        assert r._slot == t and r._release <= t < r._deadline
        done[r.source] += 1
        for s, a in {**shares, "d": 1}.items():
            assert abs(done[s] - (t + 1) * a / period) < 1


def test_mix_keeps_rows_when_a_source_runs_out(spark):
    rows = [(i % 50, "x" if i < 90 else "y", "t") for i in range(100)] + [(None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _rank_ string")
    out = mix(df, {"y": 3}, block_rows=4)
    assert out.select("doc_id", "source", "_rank_").exceptAll(df).count() == 0 and out.count() == 101
    assert mix(df.where("false"), {}).count() == 0


def test_differencing_is_tight():
    rnd = np.random.default_rng(1)
    loads = np.zeros((4000, 8))
    loads[:, 0] = rnd.lognormal(6, 1.5, 4000).astype(int)
    label = difference(loads)[:, 0]
    total = np.bincount(label, loads[:, 0], 8)
    assert total.max() - total.min() <= 2


def test_shards_are_even_and_whole(spark):
    rnd = random.Random(3)
    texts = ["é" * rnd.randint(0, 400) + str(i % 900) for i in range(3000)] + [None, "", "", "same"] + ["copy"] * 200
    df = spark.createDataFrame([(i if i != 7 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(5)
    got = shard(df, 10).collect()
    want = Counter((i if i != 7 else None, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sizes, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        where[texts[r.doc_id if r.doc_id is not None else 7] or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 10
    assert max(sizes.values()) - min(sizes.values()) < 200 and all(len(s) == 1 for s in where.values())
    assert shard(df.where("false")).count() == 0


def test_cells_join_level_by_level(spark):
    from quillspark.llm.sharding import assign_groups

    groups = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 97 + 1).alias("load"))
    got = assign_groups(groups, 4, cell_rows=100, fan_in=5).join(groups, "key").groupBy("shard").agg(F.sum("load").alias("n")).collect()
    assert len(got) == 4 and max(r.n for r in got) - min(r.n for r in got) <= 10


def test_many_sources_keep_their_windows(spark):
    n = 5000
    docs = spark.range(2 * n + 60).selectExpr("id as doc_id", f"if(id < {2 * n}, cast(id % {n} as string), if(id < {2 * n} + 30, 'a', null)) as source")
    out = mix(docs, {"a": 5, None: 3}, block_rows=1).orderBy("_position").collect()
    assert len(out) == 2 * n + 60 and len({r._position for r in out}) == len(out)
    assert all(r._release <= r._slot < r._deadline for r in out)
    first = [r for r in out if r._slot < n + 8]
    assert [r._slot for r in first] == list(range(n + 8))
    done = Counter()
    for t, r in enumerate(first):
        done[r.source] += 1
        assert all(abs(done[s] - (t + 1) * a / (n + 8)) < 1 for s, a in (("a", 5), (None, 3), (r.source, {"a": 5, None: 3}.get(r.source, 1))))


def plain_differencing(weights, shards):
    """Karmarkar-Karp with lists: the two partial partitions of the largest spread are joined, oppositely ordered."""
    parts = [sorted(([w, [i]] if k == 0 else [0, []] for k in range(shards)), key=lambda x: -x[0]) for i, w in enumerate(weights)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(([x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b))), key=lambda x: -x[0]))
    return {frozenset(own) for _, own in parts[0]}


def test_differencing_matches_plain_lists():
    rnd = np.random.default_rng(7)
    for n, shards in ((1, 3), (5, 2), (40, 3), (200, 7)):
        weights = rnd.uniform(1, 100, n)
        loads = np.zeros((n, shards))
        loads[:, 0] = weights
        label = difference(loads)[:, 0]
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in range(shards)} == plain_differencing(weights.tolist(), shards)


def test_query_shards_match_plain_lists(spark):
    """At sf0.001 all groups are in one cell, so that the query is one differencing over the distinct texts."""
    from quillspark.llm.sharding import op10_sharding

    path = "/root/testdata/sf0.001"
    size = Counter()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for t in docs.values():
        size[t] += len(t.encode()) + 16
    got = op10_sharding(spark, path).collect()
    load, where = Counter(), defaultdict(set)
    for r in got:
        load[r.shard] += r["size"]
        where[docs[r.doc_id]].add(r.shard)
    parts = plain_differencing([n for _, n in sorted(size.items(), key=lambda x: -x[1])], 40)
    order = [n for _, n in sorted(size.items(), key=lambda x: -x[1])]
    assert all(len(s) == 1 for s in where.values()) and len(got) == len(docs)
    assert abs((max(load.values()) - min(load.values())) - (max(sum(order[i] for i in p) for p in parts) - min(sum(order[i] for i in p) for p in parts))) <= 16


def test_clashing_names_and_many_null_ids(spark):
    rows = [(None if i < 3000 else i, "x" if i % 3 else "y", i, -i, "k", 5) for i in range(3200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _key int, _rank int, `_md5.a` string, _block int").repartition(3)
    out = mix(df, {"x": 2}, block_rows=8)
    assert out.columns == ["doc_id", "source", "_key", "_rank", "_md5.a", "_block", "_release", "_deadline", "_slot", "_position"]
    got = out.collect()
    assert sorted((r._key, r._rank) for r in got) == sorted((i, -i) for i in range(3200)) and len({r._position for r in got}) == 3200
    assert all(r._release <= r._slot < r._deadline and r._block >= 0 for r in got)
    texts = spark.createDataFrame([(None, f"t{i % 7}", i) for i in range(900)], "doc_id long, text string, slot int")
    slots = defaultdict(list)
    for r in shard(texts, 3).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 900


def test_period_in_pieces_is_the_same(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "cast(id % 23 as string) as source")
    shares = {"1": 7, "2": 7, "3": 3, "9": 12}
    whole, cut = ({(r.doc_id, r._position) for r in mix(docs, shares, block_rows=2, piece=n).collect()} for n in (1000, 5))
    assert whole == cut


def test_large_shares_take_no_quadratic_time(spark):
    import time

    docs = spark.range(1000).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', 'b') as source")
    began = time.time()
    out = mix(docs, {"a": 70_000, "b": 30_001}, block_rows=1).collect()
    assert time.time() - began < 60 and all(r._release <= r._slot < r._deadline for r in out)
    done = Counter()
    for t, r in enumerate(sorted(out, key=lambda r: r._position)[:600]):
        done[r.source] += 1
        assert r._slot == t and abs(done["a"] - (t + 1) * 70_000 / 100_001) < 1


def test_slots_of_rows_that_tie(spark):
    """One id for all rows: the order says nothing, and slots have no gaps all the same."""
    rows = [(1, f"t{i % 50}") for i in range(2000)]
    slots = defaultdict(list)
    for r in shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 2000
