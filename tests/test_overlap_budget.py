import random

import pytest

from quillspark.operators import chapters as ch
from quillspark.operators import script as sc


def kept_by_hand(chunks, last, prefix):
    """Every line that stays, from lists of texts."""
    kept, out = [], []
    for c, texts in enumerate(chunks):
        heads = [t.strip().lower()[:prefix] for t in texts]
        k = 0
        while k < len(heads) and heads[k] in kept[-last:]:
            k += 1
        kept += heads[k:]
        out += [(c, i) for i in range(k, len(heads))]
    return out


@pytest.mark.parametrize("last", [1, 2, 5])
def test_overlap_of_random_chunks(spark, last):
    r = random.Random(last)
    books = {b: [[r.choice(["Aa ", "ab", "B", " b", "c", "dd"]) for _ in range(r.choice([1, 2, 3, 9, 14]))] for _ in range(25)] for b in ("x", "y", None)}
    rows = [(b, c, i, t) for b, chunks in books.items() for c, texts in enumerate(chunks) for i, t in enumerate(texts)]
    r.shuffle(rows)
    got = sc.drop_overlap(spark.createDataFrame(rows, "book string, chunk int, idx int, text string").repartition(5), ["book"], last, 2).collect()
    for b, chunks in books.items():
        expected = kept_by_hand(chunks, last, 2)
        assert sorted((g.chunk, g.idx) for g in got if g.book == b) == expected
        assert len(expected) < sum(map(len, chunks))


def test_overlap_of_odd_rows(spark):
    schema = "book string, chunk int, idx int, text string, n int"
    rows = [("a", 0, 0, None, 7), ("a", 1, 0, "", 7), ("a", 1, 1, "x" * 200 + "1", 7), ("a", 2, 0, "X" * 200 + "2", 7), ("a", 2, 1, "y", 7)]
    got = sc.drop_overlap(spark.createDataFrame(rows, schema), ["book"]).collect()
    assert sorted((g.chunk, g.idx) for g in got) == [(0, 0), (1, 1), (2, 1)] and got[0].n == 7
    assert sc.drop_overlap(spark.createDataFrame([], schema), ["book"]).collect() == []


def test_budget_takes_leading_chapters(spark):
    rows = [("a", 1, "T", "x" * 30), ("a", 2, "T", "One. Two"), ("a", 3, "T", "y" * 40), ("a", 4, "T", "z"), ("b", 5, "T", "x" * 60), ("b", 6, "T", None), (None, 1, "T", "q")]
    df = spark.createDataFrame(rows, "book_id string, number int, title string, text string")
    got = {(r.book_id, r.number): (r.strategy, r.entry, r.used) for r in ch.context_budget(df, limit=90, whole_below=50, summary=20).collect()}
    first, second = "## T [FULL TEXT]\n\n" + "x" * 30, "## T [SUMMARY]\n\nOne."
    assert got["a", 1] == ("FULL TEXT", first, len(first))
    assert got["a", 2] == ("SUMMARY", second, len(first) + len(second))
    assert set(got) == {("a", 1), ("a", 2), ("b", 5), ("b", 6), (None, 1)}
    assert got["b", 5][0] == "SUMMARY" and got["b", 6][1] is None and got["b", 6][2] == got["b", 5][2]
