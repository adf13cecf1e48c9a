"""Column functions against plain Python on hand-written rows."""

import json
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import audio as au
from quillspark.functions import text as tx
from quillspark.operators import script as sc
from quillspark.operators import state as stt
from quillspark.runtime import CLEANUP, staged

#: Texts and what is left of them, worked out by hand.
CLEANED = {
    "\ufb01ne \ufb04y\u00a0x\u200by\ufeff z": "fine ffly xy z",
    "\u201cQuote\u201d \u2018it\u2019s\u201a \u00abg\u00bb": "\"Quote\" 'it's' \"g\"",
    "a \u2013 b -- c ---- d \u2012\u2015": "a \u2014 b \u2014 c \u2014 d \u2014\u2014",
    "one\n\n 12 \n\ntwo\n12345\n7\n": "one\n\ntwo",
    'TITLE PAGE\nKeep this.\n* * *\n"LOUD"\nA B C D E F\n   \nend': 'Keep this.\n"LOUD"\nA B C D E F\n\nend',
    "a\r\nb\rc  \t d\n\n\n\n\ne \n": "a\nb\nc d\n\ne",
    "e\u0301te\u0301 n\u0303": "\u00e9t\u00e9 \u00f1",
    "line\u2028sep\u2029para": "line\nsep\n\npara",
    "   ": "",
    "": "",
    "3.14 is pi. Yes!? No... \u00e9\u00e8 caf\u00e9": "3.14 is pi. Yes!? No... \u00e9\u00e8 caf\u00e9",
}
TEXTS = list(CLEANED)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_clean(texts):
    assert column(texts, tx.cleaned("t")) == list(CLEANED.values())
    assert column(texts, tx.word_count("t")) == [len(t.split()) for t in TEXTS]
    assert column(texts.limit(1), tx.cleaned(F.lit(None).cast("string"))) == [""]


def test_fragments(spark):
    cases = {
        'He said "one" and "two!". Then left': ["He said", '"one"', "and", '"two!"', ".", "Then left"],
        'Open "quote stays. Next': ['Open "quote stays.', "Next"],
        "3.14 is pi. What?! Yes\n\n  \nnew line": ["3.14 is pi.", "What?!", "Yes", "new line"],
        "“Curly” end": ["“Curly”", "end"],
        "": [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert column(df, tx.fragments("t")) == list(cases.values())


def test_word_error_rate(spark):
    def wer(r, h):
        prev = list(range(len(h) + 1))
        for i, a in enumerate(r, 1):
            cur = [i]
            for j, b in enumerate(h, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
            prev = cur
        return min(1.0, prev[-1] / len(r)) if r else 1.0

    cases = [("a b c", "a b c"), ("a b c", "a x c"), ("a b", "a b c d e f"), ("a b c", ""), ("", "x"), ("It's, fine!", "it's fine"), ("a a b", "b a a")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r string, h string")
    words = lambda c: tx.word_list(tx.normalized_for_wer(c))
    norm = lambda s: re.sub(r"[^\w\s']", " ", s.lower()).split()
    assert column(df, tx.word_error_rate(words("r"), words("h"))) == pytest.approx([wer(norm(r), norm(h)) for r, h in cases])


def test_word_error_rate_of_many_words(spark):
    """More distinct words than a character set has characters."""
    n = 70_000
    df = spark.range(1).select(F.lit(0).alias("i"), F.expr(f"transform(sequence(1, {n}), x -> concat('w', x))").alias("r"))
    other = F.transform("r", lambda w: F.when(w.isin("w5", "w40000", "w69999"), "x").otherwise(w))
    assert column(df, tx.word_error_rate(F.col("r"), other))[0] == pytest.approx(3 / n)


def test_chapter_grid(spark):
    jobs = spark.createDataFrame([("p", 6, [1, 2, 3, 4], [1, 2], [1], 3, 5)], "project_id string, total int, scripted array<int>, generated array<int>, mastered array<int>, generating int, scripting int")
    assert [r.state for r in stt.chapter_grid(jobs).orderBy("chapter").collect()] == ["Done", "Master", "Gen", "Scripted", "Script", "Pending"]


def test_effect_chain(spark):
    from quillspark.operators import audio as op

    rows = [(0, 100, [0.5, -0.5], 0.0, 1.0, "neutral", [0.9, -3.0]), (1, 100, [0.5, -0.5], None, None, None, [9.0, 9.0]), (2, 100, [0.5, -0.5], -4.0, 0.8, "neutral", None)]
    df = spark.createDataFrame(rows, "i int, sample_rate int, pcm array<double>, pitch_semitones double, speed double, tone string, other array<double>")
    got = column(op.with_effects(df, stretched="other"), "pcm")
    assert got[0] == pytest.approx([0.2 * 0.5 + 0.8 * 0.9, -1.0]) and got[1] == [0.5, -0.5] and got[2] == pytest.approx([0.5, -0.5])


def test_ranks_of_equal_keys_and_hot_leaves(spark):
    from quillspark.runtime import gapless_rank

    rows = [("g", "aa", "aa" + ("x" if i < 500 else str(i % 7)), i) for i in range(700)] + [("h", "b", "b", 1)]
    df = spark.createDataFrame(rows, "g string, b string, k string, i int").repartition(3)
    for limit in (10, 10_000):
        got = [r for r in gapless_rank(df, "g", ["b"], "k", "n", leaf_rows=limit).collect()]
        own = sorted((r.n, r.k) for r in got if r.g == "g")
        assert [n for n, _ in own] == list(range(700)) and [k for _, k in own] == sorted(k for _, k in own)
        assert sorted(r.i for r in got if r.g == "g") == list(range(700)) and [r.n for r in got if r.g == "h"] == [0]


def test_small_text_functions(spark):
    one = spark.range(1).withColumn("i", F.lit(0))
    get = lambda c: column(one, c)[0]
    assert get(tx.slug(F.lit("  The Café: A_Tale -- Two!  "))) == "the-café-a_tale-two"
    assert get(tx.speaker_id(F.lit("Old-Man Tom"), hyphens=True)) == "old_man_tom"
    assert get(tx.to_last_stop(F.lit("One. Two. thr"))) == "One. Two." and get(tx.to_last_stop(F.lit("none"))) == "none."
    assert get(tx.rewrite_words(F.lit("Tom's tom-cat atom TOM"), [("tom", "T$1\\x")])) == "T$1\\x's T$1\\x-cat atom T$1\\x"
    assert get(tx.hms(F.lit(3725.9))) == "1:02:05" and get(tx.human_bytes(F.lit(1536))) == "1.5 KB"
    sizes = {0: "0 Bytes", None: "0 Bytes", 1: "1 Bytes", 1023: "1023 Bytes", 1024: "1 KB", 2048: "2 KB", 1152: "1.13 KB", 1034: "1.01 KB", 1048576: "1 MB", 10 * 1024**3: "10 GB", 1024**4 * 100: "100 TB", 1024**5: "1024 TB"}
    assert {k: get(tx.human_bytes(F.lit(k).cast("long"))) for k in sizes} == sizes
    assert get(tx.escape_html(F.lit("<'&\">"))) == "&lt;&#039;&amp;&quot;&gt;" and get(tx.escape_html(F.lit(None).cast("string"))) == ""
    assert get(tx.fragments(F.lit('He said "one\rtwo\u2028three" and left. Then'))) == ["He said", '"one\rtwo\u2028three"', "and left.", "Then"]
    assert get(tx.json_object(F.lit('<think>{"x"}</think> ok {"a": {"b": 1}} bye'))) == '{"a": {"b": 1}}'
    assert get(tx.json_object(F.lit("no"))) is None and get(tx.json_object(F.lit("{broken"))) == '{"broken": ""}'
    said = {("joy", 0.8): "Speak with joy. at a slow, measured pace.", ("neutral", 0.95): "Speak with neutral. at a slightly slower pace.", ("", 1.05): "at a slightly faster pace.", ("", 1.2): "at a quick, energetic pace.", ("", 1.0): "", ("calm", 1.0): "Speak with calm."}
    assert {k: get(sc.instruction(F.lit(k[0]), F.lit(k[1]))) for k in said} == said
    shares = {(0.0, 1.0, "neutral"): 0.2, (-4.0, 0.8, "neutral"): 0.0, (1.5, 1.0, "warm"): 0.2 * 0.35, (0.0, 1.05, "neutral"): 0.2, (0.3, 0.8, "bright"): 0.2 * 0.65}
    for (p, s, tone), share in shares.items():
        assert get(au.blend_share(F.lit(p), F.lit(s), F.lit(tone))) == pytest.approx(share, abs=1e-12)
    names = {"old_tom": "Old Tom", "o'neil": "O'Neil", "agent7x": "Agent7X", "VOICE_2": "Voice 2"}
    assert {k: get(tx.display_name(F.lit(k))) for k in names} == names
    for status in ("paused_scheduled", "deploy_paused", "extracting", "created"):
        assert get(stt.stages_to_run(F.lit(status))) == stt.STAGES
    assert get(stt.stages_to_run(F.lit("complete"), F.lit(True))) == ["exporting"] and get(stt.stages_to_run(F.lit("mastering"), F.lit(True))) == ["mastering", "exporting"]
    percents = {("validating", 1, 4): 38.0, ("generating", 4, 4): 100.0, ("bootstrapping", 0, 4): 25.0, ("exporting", 0, 0): 50.0, ("mastering", 1, 3): 33.0}
    assert {k: get(stt.stage_percent(F.lit(k[0]), F.lit(k[1]), F.lit(k[2]))) for k in percents} == percents
    assert get(stt.stage_percent(F.lit("bootstrapping"), F.lit(0), F.lit(4), F.lit(True))) == 100
    assert get(stt.merged_state(F.lit('{"a": 1, "b": {"c": [1]}, "s": "x"}'), F.lit('{"a": {"d": null}, "n": 2.5}'))) is not None
    merged = json.loads(get(stt.merged_state(F.lit('{"a": 1, "b": {"c": [1]}, "s": "x"}'), F.lit('{"a": {"d": "y"}, "n": 2.5}'))))
    assert merged == {"a": {"d": "y"}, "b": {"c": [1]}, "s": "x", "n": 2.5}
    assert get(stt.stages_to_run(F.lit("paused"))) == stt.STAGES and get(stt.stages_to_run(F.lit("complete"))) == []
    assert get(stt.percent(F.lit(73), F.lit(400))) == 18.2 and get(stt.percent(F.lit(1), F.lit(0))) == 0


def test_gate():
    """At 1 kHz an envelope is 10 samples, the gate opens by 0.2 and closes by 0.02 a sample; at 1 it falls once, then rises."""
    x = np.array([1.0] * 10 + [0.5] * 2 + [0.0] * 19)
    opened = [0.2, 0.4, 0.6, 0.8, 1.0, 0.98, 1.0, 0.98, 1.0, 0.98]
    loud = [1.0 * 0.5, 0.98 * 0.5]  # the second envelope holds 0.5 twice: still above the threshold
    assert np.allclose(au.gate(x, 1000)[:12], [*opened, *loud]) and not au.gate(x, 1000)[12:].any()
    for n in (0, 5, 10):  # shorter than an envelope and a sample: never opened
        assert au.gate(np.ones(n), 1000).tolist() == [0.0] * n


def test_assembly_and_resampling():
    x = np.ones(100)
    assert len(au.assemble([(x, 0, 0)], 1000, fade_ms=30)) == 1000 + 100 - 30 + 2000
    assert len(au.assemble([(x, 50, 10), (x, 0, 0)], 1000, fade_ms=0)) == 1000 + 50 + 100 + 10 + 100 + 2000
    joined, rest = au.crossfade(np.ones(50), x, 1000, 30)
    assert len(rest) == 70 and joined[20] == pytest.approx(1) and joined[-1] == pytest.approx(1)
    assert len(au.resample(np.arange(10.0), 100, 250)) == 25
    assert np.allclose(au.tone(np.sin(np.arange(64.0)), "neutral"), np.sin(np.arange(64.0)))


def test_audio_columns(spark):
    rows = [(0, [0.0] * 40), (1, [1.0, -1.0] * 20), (2, [0.001] * 30 + [0.5] * 10), (3, [])]
    df = spark.createDataFrame(rows, "i int, pcm array<double>")
    assert column(df, au.peak_dbfs("pcm")) == pytest.approx([-100, 0, 20 * np.log10(0.5), -100])
    assert column(df, au.longest_silence("pcm")) == [40, 0, 30, 0]
    assert column(df, F.size(au.frames("pcm", F.lit(10)))) == [3, 3, 3, 0]
    assert column(df, au.noise_floor_db("pcm", F.lit(200)))[2] == pytest.approx(-60)
    assert column(df.where("i < 3"), au.peak(au.to_loudness("pcm", F.lit(100)))) == pytest.approx([0, 10 ** ((-19 + 0.691) / 20), 10 ** (-1 / 20) * 0 + column(df.where("i = 2"), au.peak(au.to_loudness("pcm", F.lit(100))))[0]])
    assert column(df, au.peak(au.limited("pcm"))) == pytest.approx([0, 10 ** (-1 / 20), 0.5, 0])


def test_nfc_gives_back_what_is_normal():
    """A batch without changes is the same Arrow array, not a second one; changes stay with their rows."""
    nfc, plain = tx.nfc.func, pa.array(["\u201cx\u201d", None, "\u00e9"] * 50)
    assert nfc(plain) is plain
    mixed = plain.to_pylist()
    mixed[70] = "e\u0301"
    assert nfc(pa.array(mixed)).to_pylist() == [*mixed[:70], "\u00e9", *mixed[71:]]
    assert len(nfc(pa.array([], pa.string()))) == 0


def test_a_filter_on_cleaned_texts_runs_python_once(texts, capsys):
    few = texts.select("i", tx.word_count(tx.cleaned("t")).alias("n")).where("n >= 2")
    few.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert {r.i: r.n for r in few.collect()} == {i: len(t.split()) for i, t in enumerate(CLEANED.values()) if len(t.split()) >= 2}


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    """Else an operator of many steps holds the shuffles of all of them until the driver collects its garbage."""

    def blocks() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().endswith(".data")}

    before, kept = blocks(), spark.conf.get(CLEANUP, None)
    out = staged(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count(), "shuffled")
    until = time.time() + 20
    while blocks() - before and time.time() < until:  # executors are told some time later
        time.sleep(0.2)
    assert not blocks() - before
    assert out.count() == 100 and out.agg(F.sum("count")).first()[0] == 10_000
    assert spark.conf.get(CLEANUP, None) == kept
