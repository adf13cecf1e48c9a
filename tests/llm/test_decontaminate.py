"""Contaminated words against brute force."""

import random
import re

import pytest

from quillspark.llm.decontaminate import contaminated_words

DOCS, BENCH = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench, size=10):
    out = []
    for _, text in docs:
        w, hit, items = brute_words(text), set(), set()
        for item, t in bench:
            b = brute_words(t)
            n = min(len(b), size)
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for s in range(len(w) - n + 1 if wins else 0):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    items.add(str(item))
        out.append((len(w), len(hit), ",".join(sorted(items))))
    return out


def tables():
    rnd = random.Random(9)
    prose = lambda n: " ".join(rnd.choice(["The", "der", "été", "A1", "x", "Σas", "ΑΣ"]) + rnd.choice(["", "a", "b", "c", "É"]) for _ in range(n))
    bench = [(i, prose(rnd.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(12)] + [(3, prose(15)), (50, ""), (51, None), (52, "...")]
    bench += [(60, bench[6][1]), (61, "zz yy"), (62, "zz")]
    docs = []
    for i in range(80):
        parts = [prose(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            t = rnd.choice(bench)[1] or ""
            parts += [t.upper() if rnd.random() < 0.3 else t.replace(" ", rnd.choice([" ", ", ", "\n"])), prose(rnd.randint(0, 4))]
        docs.append((i, rnd.choice([" ", ". "]).join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (103, bench[6][1]), (104, "zz"), (105, "a zz yy zz")]
    return docs, bench


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_matches_brute_force(spark, broadcast_rows):
    docs, bench = tables()
    got = contaminated_words(spark.createDataFrame([(*d, "x") for d in docs], DOCS).repartition(3), spark.createDataFrame([(*b, "x") for b in bench], BENCH), broadcast_rows=broadcast_rows).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, ",".join(r["items"])) for r in got} == dict(zip((d for d, _ in docs), brute(docs, bench)))


def test_odd_tables(spark):
    docs, bench = tables()
    d, b = spark.createDataFrame([(*x, "x") for x in docs], DOCS), spark.createDataFrame([(*x, "x") for x in bench], BENCH)
    assert contaminated_words(d.where("false"), b).count() == 0
    assert all(r.n_hit == 0 for r in contaminated_words(d, b.where("false")).collect())
    twice = contaminated_words(d.where("doc_id = 103").union(d.where("doc_id = 103")).selectExpr("cast(null as long) as doc_id", "text"), b.union(b)).collect()
    assert len(twice) == 2 and all(r.n_hit == r.n_words and r["items"] == sorted(r["items"]) for r in twice)
