"""Operators on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chapters as ch
from quillspark.operators import quality as ql
from quillspark.operators import registry as rg
from quillspark.operators import script as sc
from quillspark.operators import state as stt
from quillspark.operators import timeline as tl
from quillspark.runtime import totals_before


@pytest.mark.parametrize("n, starts", [(1, [0]), (600, [0]), (601, [0, 450]), (1500, [0, 450, 900]), (0, [])])
def test_chunks(spark, n, starts):
    df = spark.createDataFrame([(1, " ".join(["w"] * n))], "id int, text string")
    got = ch.word_chunks(df, ["id"], 600, 150).orderBy("chunk").collect()
    assert [r.start_word for r in got] == starts
    with pytest.raises(ValueError):
        ch.word_chunks(df, ["id"], 100, 100)


def test_chapters(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [("a", 1, "Short", words(99)), ("a", 2, "", words(100)), ("a", 3, "Long", words(450)), ("a", 4, "", words(401)), ("b", 1, "x", words(3)), ("b", 2, "y", "  "), ("c", 1, "", None)]
    got = ch.chapters(spark.createDataFrame(rows, "book_id string, ord int, title string, text string"), max_words=200).orderBy("book_id", "number").collect()
    assert [(r.book_id, r.number, r.title, r.word_count) for r in got] == [
        ("a", 1, "Chapter 1", 100), ("a", 2, "Long (Part 1)", 200), ("a", 3, "Long (Part 2)", 200), ("a", 4, "Long (Part 3)", 50),
        ("a", 5, "Chapter 5", 200), ("a", 6, "Chapter 6", 200), ("a", 7, "Chapter 7", 1), ("b", 1, "Full Text", 3),
    ]


def test_full_text_parts(spark):
    rows = [("a", 2, "", "two  words"), ("a", 1, "", "one"), ("a", 3, "", None), ("b", 1, "", " "), (None, 5, "", "x"), (None, 5, "", "y")]
    got = ch.full_text_parts(ch.cleaned_sections(spark.createDataFrame(rows, "book_id string, ord int, title string, text string"))).collect()
    assert sorted((r.book_id or "", r.part, r.start_char) for r in got) == [("", 0, 0), ("", 1, 3), ("a", 0, 0), ("a", 1, 5)]
    assert [r.text for r in sorted(got, key=lambda r: (r.book_id or "", r.part))][2:] == ["one", "two words"]


def test_totals_before(spark):
    rows = [("hot" if i % 3 else None, i * 7 % 1000, i % 5) for i in range(1000)] + [("z", 1, None), ("z", 2, 4), ("z", 3, 1)]
    got = totals_before(spark.createDataFrame(rows, "g string, o int, v int"), "g", ["o"], {"s": "v", "n": "o"}).collect()
    expected, total = {}, {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        expected[g, o] = total.get(g, (0, 0))
        total[g] = expected[g, o][0] + (v or 0), expected[g, o][1] + o
    assert {(r.g, r.o): (r.s, r.n) for r in got} == expected and len(got) == len(rows)


def test_alignment(spark):
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "ch int, idx int, fragment string")
    meta = spark.createDataFrame([(1, 0, "0", "Tom", "joy", "normal", None, "0"), (1, 1, "0", "Ann", None, "0.9", "7", "20"), (1, 2, "x", "no", "", "", "", ""), (1, 3, "2", None, "sad", None, "x", None)], "ch int, pos int, id string, speaker string, emotion string, speed string, pause_before_ms string, pause_after_ms string")
    got = [tuple(r)[2:] for r in sc.align(lines, meta, ["ch"]).orderBy("idx").collect()]
    assert got == [("a", "ann", "neutral", 0.9, 7, 20), ("b", "narrator", "neutral", 1.0, 0, 500), ("c", "narrator", "sad", 1.0, 0, 500)]


def test_overlap(spark):
    rows = [(1, 0, i, t) for i, t in enumerate("abcd")] + [(1, 1, i, t) for i, t in enumerate(["C ", "d", "e"])] + [(1, 2, i, t) for i, t in enumerate("xye")] + [(1, 3, 0, "y"), (2, 0, 0, "a")]
    got = sc.drop_overlap(spark.createDataFrame(rows, "ch int, chunk int, idx int, text string"), ["ch"]).orderBy("ch", "chunk", "idx").collect()
    assert [(r.ch, r.text) for r in got] == [(1, t) for t in "abcdexye"] + [(2, "a")]


def test_registry(spark):
    rows = [("b", 1, "Old-Man", "x" * 5, "MALE", ""), ("b", 2, "old man", "x" * 5 + "y", None, "grim"), ("b", 3, "old_man", "z" * 6, "robot", "gay"), ("b", 4, "narr", None, "female", "")]
    raw = spark.createDataFrame(rows, "book_id string, chapter int, raw_id string, voice_description string, gender string, tone string")
    got = {r.id: (r.first_chapter, r.voice_description) for r in rg.accumulate(raw).collect()}
    assert got == {"old_man": (1, "xxxxxy"), "narr": (4, None)}
    assert rg.first_tone(raw).first().tone == "grim"
    full = rg.with_narrator(rg.parsed(raw))
    assert {(r.id, r.gender) for r in full.collect()} == {("old_man", "other"), ("narr", "female"), ("narrator", "male")}
    assert {r.id for r in rg.capped(full, most=2).collect()} == {"old_man", "narrator"}
    narrator = full.where("id = 'narrator'").first()
    assert (narrator.name, narrator.age_range, narrator.personality_traits, narrator.ord) == ("Narrator", "40s", ["measured", "warm", "authoritative"], 5) and narrator.voice_description.startswith("A warm, mature male")
    said = spark.createDataFrame([("male",), ("female",), ("other",), ("robot",), (None,)], "g string").select(F.substring(rg.test_sentence("g"), 1, 11).alias("s"))
    assert [r.s for r in said.collect()] == ["The ancient", "She walked ", "The library", "The library", "The library"]


def test_whole_records_by_place(spark):
    """The record with the strictly longest description, and where its id was first named."""
    rows = [("b", 2, 1, "A B", "long one", "male", "n1"), ("b", 1, 3, "a-b", "long two", "female", "n2"), ("b", 1, 2, "a_b", "short", "other", "n3"), ("b", 2, 0, "x", None, None, "n4"), ("b", 3, 0, "X", "", "male", "n5")]
    got = rg.accumulate(spark.createDataFrame(rows, "book_id string, chapter int, place int, raw_id string, voice_description string, gender string, name string")).collect()
    assert {r.id: (r.first_chapter, r.first_place, r.name, r.gender, r.mentions) for r in got} == {"a_b": (1, 2, "n2", "female", 3), "x": (2, 0, "n4", None, 2)}


def test_time_still_to_go(spark):
    rows = spark.createDataFrame([(10.0, 2, 6), (10.0, 0, 6), (10.0, 6, 6), (10.0, 7, 6)], "e double, d int, t int")
    assert [r.s for r in rows.select(tl.remaining_seconds(F.col("e"), F.col("d"), F.col("t")).alias("s")).collect()] == [20.0, None, 0.0, 0.0]


def test_quality(spark):
    rows = [(1, "p", "l1", 1, 1, 0.0, 0.9, "pass", None), (2, "p", "l2", 1, 1, 0.5, 0.3, "flagged", '{"silence_issues": true}'), (3, "p", "l2", 1, 2, None, 0.8, "pass", '{"silence_issues": false}'), (4, "p", "l3", 1, 3, 0.4, 0.2, "fail", '{"clipping_issues": true}')]
    logs = spark.createDataFrame(rows, "id long, project_id string, line_id string, chapter_number int, attempt int, wer double, quality_score double, status string, details string")
    s = ql.chapter_summary(logs).first()
    assert (s.total_segments, s.passed, s.failed, s.flagged, s.worst_wer, s.total_retries) == (3, 2, 1, 0, 0.4, 2) and s.average_wer == pytest.approx(0.2)
    p = ql.project_summary(logs).first()
    assert (p.total_segments, p.failed_silence, p.failed_clipping, p.retries_triggered) == (3, 0, 1, 2) and p.average_wer == pytest.approx(0.4 / 3)
    asked = spark.createDataFrame([("p", "l1", 1), ("p", "l2", 1), ("p", "l9", 1)], "project_id string, line_id string, chapter_number int")
    r = ql.chapter_report(asked, logs).first()
    assert (r.total_segments, r.passed, r.flagged, r.flagged_lines) == (3, 2, 1, "l2")


def test_timelines(spark):
    d = spark.createDataFrame([("b", 1, 1.5), ("b", 2, None), ("b", 3, 0.25)], "book_id string, number int, seconds double")
    assert [tuple(r)[2:] for r in tl.chapter_markers(d).orderBy("number").collect()] == [(0, 1500), (1500, 1500), (1500, 1750)]
    lines = spark.createDataFrame([(1, 0, 100, 0, 500), (1, 1, 10, 200, 0), (1, 2, 50, 0, 0)], "ch int, line_ord int, audio_ms int, pause_before_ms int, pause_after_ms int")
    assert [tuple(r)[2:] for r in tl.segment_timeline(lines, ["ch"]).orderBy("line_ord").collect()] == [(1000, 1070), (1770, 1770), (1770, 1810)]


def test_state(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(stt.chapter_ranges(F.lit("1-3, 7,x,9-8,2"))) == [1, 2, 3, 7]
    assert get(stt.merged_json(F.lit('{"a": 1, "b": "x"}'), F.lit('{"b": 2}'))) == {"a": "1", "b": "2"}
    assert get(stt.merged_json(F.lit(None).cast("string"), F.lit('{"b": 2}'))) == {"b": "2"}
    win = lambda d, t, s, e, days=None: get(stt.in_window(F.lit(d), F.lit(t), F.lit(None).cast("array<string>") if days is None else F.array(*map(F.lit, days)), F.lit(s), F.lit(e)))
    assert win("mon", "08:00", "08:00", "12:00") and win("mon", "23:30", "22:00", "06:00") and win("mon", "06:00", "22:00", "06:00")
    assert not win("mon", "07:59", "08:00", "12:00") and not win("mon", "09:00", "08:00", "12:00", ["tue"])
    times = spark.createDataFrame([(1, "mon", "10:00")], "id int, day string, time string")
    none = spark.createDataFrame([], "days array<string>, start string, end string")
    assert stt.may_run(times, none).first().allowed
    a = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    b = spark.createDataFrame([("k2", 9), ("k3", 3)], "k string, v int")
    assert sorted(map(tuple, stt.upsert(a, b, "k").collect())) == [("k1", 1), ("k2", 9), ("k3", 3)]
    assert [tuple(r) for r in stt.delete(a, b, "k").collect()] == [("k1", 1)]
    slugs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "n int, slug string")
    got = stt.free_slugs(slugs, spark.createDataFrame([("s",)], "slug string"), "n", "n").orderBy("n").collect()
    assert [r.project_id for r in got] == ["s-1", "s-2", "t"]


def brute_names(rows, taken):
    """The slug itself for its first request if it isn't taken, else number after number until one is free."""
    asked, used, out = {s for _, s in rows}, set(taken), {}
    for n, s in sorted(rows):
        if s not in used:
            out[n] = s
            used.add(s)
            continue
        k = 1
        while f"{s}-{k}" in used or f"{s}-{k}" in asked:
            k += 1
        out[n] = f"{s}-{k}"
        used.add(out[n])
    return out


def test_free_names(spark):
    import random

    def named(rows, taken):
        t = spark.createDataFrame(rows, "n int, slug string").repartition(3)
        return {r.n: r.project_id for r in stt.free_slugs(t, spark.createDataFrame([(x,) for x in taken], "slug string"), "n", "n").collect()}

    assert named([(1, "en"), (2, "en"), (3, "en")], ["en", "en-1"]) == {1: "en-2", 2: "en-3", 3: "en-4"}
    rnd = random.Random(5)
    slugs = ["en", "en-1", "en-2", "en-1-1", "fr", "fr-07", "fr-", "", "-1", "x y"]
    rows = [(i, "hot" if i % 3 == 0 else rnd.choice(slugs)) for i in range(300)]
    taken = ["en", "en-3", "en-4", "hot", "hot-1", "hot-50", "hot-51", "fr-2", "fr-0", "-3", "hot-99999999999999999999"]
    got = named(rows, taken)
    assert got == brute_names(rows, taken) and len(set(got.values())) == 300 and not set(got.values()) & set(taken)
    assert named([(1, None), (2, "a")], ["b"]) == {1: None, 2: "a"}


def test_schedule_ends_and_empty_jobs(spark):
    times = spark.createDataFrame([(1, "Monday", "00:00"), (2, "Monday", "23:59"), (3, "Sunday", "12:00")], "id int, day string, time string")
    allowed = lambda *w: [r.allowed for r in stt.may_run(times, spark.createDataFrame(list(w), "days array<string>, start string, end string")).orderBy("id").collect()]
    assert allowed(([], "00:00", "01:00")) == [True, False, False] and allowed((None, None, None)) == [True] * 3
    assert allowed((["Monday"], None, "01:00"), (["Sunday"], "12:00", None)) == [True, False, True]
    jobs = spark.createDataFrame([("p", 0), ("q", None), ("r", 1)], "project_id string, total int")
    for c in ("scripted", "generated", "mastered"):
        jobs = jobs.withColumn(c, F.array().cast("array<int>"))
    grid = stt.chapter_grid(jobs.withColumns({"generating": F.lit(None).cast("int"), "scripting": F.lit(None).cast("int")})).collect()
    assert [(r.project_id, r.chapter, r.state) for r in grid] == [("r", 1, "Pending")]


def test_empty_raw_sections_are_no_parts(spark):
    rows = [("a", 1, "", "one"), ("a", 2, "", ""), ("a", 3, "", "  "), ("a", 4, "", "two")]
    clean = ch.cleaned_sections(spark.createDataFrame(rows, "book_id string, ord int, title string, text string"))
    assert [r.text for r in ch.full_text_parts(clean).orderBy("part").collect()] == ["one", "", "two"]
    assert ch.full_text(clean).first().text == "one\n\n\n\ntwo"


def test_medians_of_even_and_odd_counts(spark):
    import random
    import statistics

    rnd, rows = random.Random(2), []
    for key, n in (("hot", 401), ("even", 10), ("one", 1), ("two", 2), ("equal", 7), (None, 4)):
        rows += [(key, 0.5 if key == "equal" else rnd.choice([rnd.random(), 0.25])) for _ in range(n)]
    rows += [("hot", None), ("nothing", None)]
    got = {r.k: r.median for r in ql.medians(spark.createDataFrame(rows, "k string, v double").repartition(4), "k", "v").collect()}
    want = {k: statistics.median([v for q, v in rows if q == k and v is not None]) for k in ("hot", "even", "one", "two", "equal", None)}
    assert got == want
    spent = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 1.0), ("c", 1.0)], "book_id string, seconds double")
    audio = spark.createDataFrame([("a", 3.0), ("b", 0.0), ("d", 2.0)], "book_id string, seconds double")
    assert {r.book_id: r.ratio for r in ql.generation_ratio(spent, audio, ["book_id"]).collect()} == {"a": 2.0, "b": None, "c": None, "d": 0.0}
