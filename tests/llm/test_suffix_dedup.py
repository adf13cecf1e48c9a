"""Repeated bytes against brute force over every string of 200 bytes."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm.suffix_dedup import remove_repeated_bytes

SCHEMA = "doc_id long, text string, spans string"


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                hit[p : p + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, hit) if not x)
        spans = sum(1 for i, x in enumerate(hit) if x and (i == 0 or not hit[i - 1]))
        out.append((len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    docs = [prose(rnd.randint(1, 200)) for _ in range(30)]
    docs += [prose(30) + rnd.choice(shared) + prose(30) for _ in range(30)]
    docs += [docs[3], docs[3], docs[4][:150], docs[4][:250], docs[4][10:211]]
    docs += [d[:100] + "x" + d[100:] for d in docs[5:15]]
    docs += ["a" * 700, "ab" * 400, "abc" * 66, "z" * 200, "y" * 201, prose(40) * 3, "", None, " "]
    docs += [shared[0][:199], shared[0][:200], shared[0][1:201]]
    return docs


@pytest.mark.parametrize("window", [120, 60])
def test_matches_brute_force(spark, window):
    docs = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], SCHEMA).repartition(5)
    got = remove_repeated_bytes(df, window=window).select("doc_id", "n_bytes", "spans", F.sha2("kept", 256).alias("d")).collect()
    got = {r.doc_id: (r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), r.d) for r in got}
    assert got == dict(enumerate(brute(docs)))


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = "q w e r t y " * 1 + "".join(chr(97 + i * 7 % 26) + str(i) for i in range(120))
    df = spark.createDataFrame([(1, long, ""), (1, long, ""), (None, long, ""), (None, None, "")], SCHEMA)
    rows = remove_repeated_bytes(df).collect()
    assert sorted(len(r.kept) for r in rows) == [0, 0, 0, 0] and len(rows) == 4
    assert remove_repeated_bytes(df.where("false")).count() == 0


def test_blocks_cut_phrases_without_loss(spark, monkeypatch):
    from quillspark.llm import suffix_dedup

    base = random.Random(1).choices(range(97, 123), k=3000)
    text = bytes(base) + b"--" + bytes(base)
    one = [p for part in suffix_dedup.parse(text, 200, 120) for p in zip(*part)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    cut = [p for part in suffix_dedup.parse(text, 200, 120) for p in zip(*part)]
    assert sum(hi - lo + 1 for lo, hi, *_ in one) == sum(hi - lo + 1 for lo, hi, *_ in cut) == len(text) - 199
    assert {k for *_, k, _ in one} == {k for *_, k, _ in cut}


def test_corpus_order_meets_across_ranges(spark):
    from quillspark.llm.suffix_dedup import _in_order

    rnd = random.Random(2)
    strings = [bytes(rnd.choices(b"ab\x00\xff", k=5)) for _ in range(700)] + [b"aaaaa"] * 900 + [b"zzzzz"]
    rows = [(i if i % 3 else None, i % 2, i, 1, bytearray(x)) for i, x in enumerate(strings)]
    df = spark.createDataFrame(rows, "_id int, _h long, p long, n long, s binary")
    count = Counter(strings)
    expected = [i for i, x in enumerate(strings) if count[x] > 1]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", parts, "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert sorted(r.p for r in _in_order(df, 5).collect()) == expected
            assert _in_order(df.where("p = 1600"), 5).count() == 0 == _in_order(df.where("false"), 5).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_above_a_block(spark):
    """Texts of more than 1 MB: a passage at their ends, and a text of one byte over and over."""
    rnd = random.Random(9)
    prose = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    passage = prose(400)
    rows = [(1, prose(1_300_000) + "<" + passage + ">", ""), (2, "(" + passage + ")", ""), (3, "z" * 1_200_000, ""), (4, prose(300_000), "")]
    got = {r.doc_id: ([(s["start"], s["end"]) for s in r.spans], r.n_bytes) for r in remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ([(1_300_001, 1_300_401)], 1_300_402), 2: ([(1, 401)], 402), 3: ([(0, 1_200_000)], 1_200_000), 4: ([], 300_000)}
