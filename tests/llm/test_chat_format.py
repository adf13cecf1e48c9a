"""Round trips of the template and best paths of small trees."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.chat_format import format_conversations, format_turns, parse_turns, unescape

PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "\\", "<", "|", "\n", "é", "assistant", "a", "\\|", "<\\|"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), PIECES), PIECES), max_size=5))
def test_round_trip(turns):
    text, mask = format_turns(turns)
    assert parse_turns(text) == turns
    assert [unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_other_texts_are_refused():
    with pytest.raises(ValueError):
        parse_turns("<|im_start|>user\nhi")


def test_rows_by_turn(spark):
    rows = [(1, 2, "assistant", "b", 0), (1, 1, "user", "a", 0), (1, 2, "assistant", "b", 0), (2, 1, None, None, 0), (None, 1, "user", "n", 0), (None, None, "user", "first", 0)]
    rows += [(3, i, "user", str(i), 0) for i in range(70)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    got = {r.conv_id: parse_turns(r.formatted) for r in format_conversations(df).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("assistant", "b")], 2: [("", "")], None: [("user", "first"), ("user", "n")], 3: [("user", str(i)) for i in range(70)]}
    assert format_conversations(df.where("false")).count() == 0


def test_best_branch(spark):
    rows = [
        (1, 10, None, "user", "root", 1.0),
        (1, 11, 10, "assistant", "poor", 0.0),
        (1, 12, 10, "assistant", "good", 3.0),
        (1, 13, 12, "user", "more", 1.0),
        (1, 14, 12, "user", "best", 9.0),
        (1, 15, 99, "user", "lost parent", 2.0),
        (2, 1, 2, "user", "cycle", 1.0),
        (2, 2, 1, "user", "cycle", 1.0),
        (2, 3, None, "user", "alone", None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, parent long, role string, text string, score double")
    got = {r.conv_id: [t for _, t in parse_turns(r.formatted)] for r in format_conversations(df, parent_col="parent", score_col="score").collect()}
    assert got == {1: ["root", "good", "best"], 2: ["alone"]}


def test_every_path_and_the_best_of_each_root(spark):
    rnd = random.Random(7)
    rows = [(c, n, None if n % 9 == 0 else rnd.randrange(n), "user", f"{c}/{n}", float(rnd.randint(0, 4))) for c in (1, 2, None) for n in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, parent long, role string, text string, score double").repartition(3)
    want = {}
    for c, n, *_ in rows:
        own = {r[1]: r for r in rows if r[0] == c}
        if any(r[2] == n for r in own.values()):
            continue
        path = [own[n]]
        while path[0][2] is not None:
            path.insert(0, own[path[0][2]])
        want[c, str(path[0][1]), str(n)] = [r[4] for r in path], sum(r[5] for r in path) / len(path)

    def got(choose):
        out = format_conversations(df, parent_col="parent", score_col="score", choose=choose).collect()
        found = {(r.conv_id, r.root, r.leaf): ([t for _, t in parse_turns(r.formatted)], r.score) for r in out}
        assert len(found) == len(out)
        return found

    assert got("all") == want
    for k in (1, 2):
        ranked = sorted(want, key=lambda p: (want[p][1], int(p[2])), reverse=True)
        assert got(k) == {p: want[p] for i, p in enumerate(ranked) if sum(q[:2] == p[:2] for q in ranked[:i]) < k}


def test_messages_without_a_name_or_with_one_name(spark):
    rows = [
        (1, "a", None, "user", "hello"),
        (1, "b", "a", "assistant", "twice"),
        (1, "b", "a", "assistant", "twice"),
        (1, None, "b", "user", "nameless"),
        (1, None, None, "user", "nameless root"),
        (1, "c", "c", "user", "answers itself"),
        (1, "d", "c", "user", "below a cycle"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn string, parent string, role string, text string")
    out = format_conversations(df, parent_col="parent", choose="all").collect()
    assert sorted((r.root or "", r.leaf or "", [t for _, t in parse_turns(r.formatted)]) for r in out) == [("", "", ["nameless root"]), ("a", "", ["hello", "twice", "nameless"]), ("a", "b", ["hello", "twice"])]
    assert format_conversations(df.where("false"), parent_col="parent", choose="all").count() == 0


def test_very_long_texts_and_conversations(spark):
    long = "x<|im_end|>" * 100_000
    rows = [(1, 1, "user", long), (1, 2, "assistant", long)] + [(2, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(20_000)]
    got = {r.conv_id: parse_turns(r.formatted) for r in format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert got[1] == [("user", long), ("assistant", long)] and got[2] == [(r, t) for _, _, r, t in rows[2:]]
