"""Twenty broken answers and the objects that they mean, and a thousand whole ones cut short."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.json_repair import repaired

CASES = [
    ('{"a": 1,}', {"a": 1}),
    ('{"a": [1, 2, 3,], "b": {"c": 2,},}', {"a": [1, 2, 3], "b": {"c": 2}}),
    ('{"a": [1, 2, {"b": 3', {"a": [1, 2, {"b": 3}]}),
    ('{"a": "cut of', {"a": "cut of"}),
    ("{'a': 'b', 'c': 'it''s'}", {"a": "b", "c": "it''s"}),
    ("{'a': 'it's fine', 'b': 2}", {"a": "it's fine", "b": 2}),
    ("{a: 1, b_2: two words, c: true}", {"a": 1, "b_2": "two words", "c": True}),
    ('```json\n{"a": 1}\n```', {"a": 1}),
    ('Here you are: {"a": {"b": [}} thanks', {"a": {"b": []}}),
    ('{"a": 1 "b": 2\n"c": 3}', {"a": 1, "b": 2, "c": 3}),
    ('{"a": True, "b": None, "c": False, "d": NaN}', {"a": True, "b": None, "c": False, "d": None}),
    ('{"a": 1, // one\n "b": 2, /* two */ "c": 3 # three\n}', {"a": 1, "b": 2, "c": 3}),
    ('{"say": "he said "no" to me", "n": -1.5e3}', {"say": 'he said "no" to me', "n": -1500.0}),
    ('{"a": "line one\nline two", "b": "tab\\t\\u00e9\\/"}', {"a": "line one\nline two", "b": "tab\té/"}),
    ('{"a": , "b": 1}', {"a": "", "b": 1}),
    ('{"a": 1, "a": 2}}}', {"a": 2}),
    ('{“a”: “b”, ‘c’: 1}', {"a": "b", "c": 1}),
    ('{"a": [1, 2}, "b": 3}', {"a": [1, 2]}),
    ('{"a":: 1,, "b": 2', {"a": 1, "b": 2}),
    ('{"a": "http://x.y/z", b: 007, c: http}', {"a": "http://x.y/z", "b": "007", "c": "http"}),
    ("{}", {}),
    ("{", {}),
    ('{"lines": [{"id": 0, "speaker": "narrator"}, {"id": 1, "speaker": "tom"', {"lines": [{"id": 0, "speaker": "narrator"}, {"id": 1, "speaker": "tom"}]}),
]


@pytest.mark.parametrize("broken, meant", CASES)
def test_broken_answers(broken, meant):
    assert json.loads(repaired(broken)) == meant


def test_column_repairs_what_is_broken_only(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(90, "no object"), (91, None), (92, ""), (93, '<think>{"x": 1}</think>\n{"a": 1.0}'), (94, "[1, 2]")]
    got = {r.i: r.j for r in spark.createDataFrame(rows, "i int, t string").select("i", tx.json_object("t").alias("j")).collect()}
    assert all(json.loads(got[i]) == meant for i, (_, meant) in enumerate(CASES) if i not in (8, 22))
    assert got[90] is got[91] is got[92] is got[94] is None and got[93] == '{"a": 1.0}'


def test_whole_objects_stay_and_cut_ones_lose_their_end_alone():
    rnd = random.Random(4)

    def thing(depth):
        kind = rnd.randrange(6 if depth else 4)
        if kind == 4:
            return [thing(depth - 1) for _ in range(rnd.randrange(4))]
        if kind == 5:
            return {rnd.choice("abcdef") * rnd.randint(1, 3): thing(depth - 1) for _ in range(rnd.randrange(4))}
        return [rnd.randint(-99, 99), rnd.choice(["x", "two words", 'q"uote', "b\\ack", "é\n", ""]), rnd.random() < 0.5, None][kind]

    for _ in range(1000):
        whole = {"k": thing(3), "m": thing(3)}
        text = json.dumps(whole, ensure_ascii=rnd.random() < 0.5)
        assert json.loads(repaired(text)) == whole
        cut = json.loads(repaired(text[: rnd.randrange(1, len(text))]))
        assert isinstance(cut, dict) and set(cut) <= {"k", "m"} | {"k"[:1], "m"[:1], ""}


def test_long_and_deep():
    assert json.loads(repaired('{"a": [' + "1, " * 200_000)) == {"a": [1] * 200_000}
    assert repaired('{"a": "' + "x" * 1_000_000 + '"}') == '{"a": "' + "x" * 1_000_000 + '"}'
    assert F is not None
