"""Removed sentences against a brute force that shares no code with the library."""

import random
import re

import xxhash

from quillspark.llm.sentence_spans import drop_repeated_spans, sentences

SCHEMA = "doc_id long, text string, spans int"


def cut(text):
    """Sentences as (text, folded words)."""
    out, words, at = [], [], 0
    for m in re.finditer(r"\S+\s*", text):
        word = m[0].strip().lower()
        words.append(word)
        bare = word
        while bare and bare[-1] in "\"')]}»”’":
            bare = bare[:-1]
        if (bare and bare[-1] in ".!?") or xxhash.xxh3_64_intdigest(word) // 2 % 4 == 0 or m.end() == len(text):
            out.append((text[at : m.end()], words))
            words, at = [], m.end()
    return out


def brute(rows, span=3, min_words=25):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        own, gone, new = cut(text or ""), set(), []
        for i in range(len(own)):
            for j in range(i + span, len(own) + 1):
                words = tuple(w for _, part in own[i:j] for w in part)
                if len(words) >= min_words:
                    if words in seen:
                        gone |= set(range(i, j))
                    seen.add(words)
                    break
        out[doc] = (None if text is None else "".join(t for k, (t, _) in enumerate(own) if k not in gone) if own else text, len(own), len(gone))
    return out


def corpus():
    rnd = random.Random(4)
    sentence = lambda: " ".join(rnd.choice(["Ab", "cd", "éf", "gh3.5", "x"]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 12))) + rnd.choice([". ", "! ", "?\n", '." ', "\n", "... "])
    shared = ["".join(sentence() for _ in range(7)) for _ in range(5)]
    texts = [rnd.choice(["", " "]) + "".join(rnd.choice([sentence(), sentence(), rnd.choice(shared)]) for _ in range(rnd.randint(0, 8))) for _ in range(80)]
    return list(enumerate([*texts, texts[3], texts[3].upper(), "", None, " \n ", "...", shared[0] * 3, shared[1].replace(" ", "\t\n")]))


def test_matches_brute_force(spark):
    rows, want = corpus(), brute(corpus())
    got = drop_repeated_spans(spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA).repartition(4)).collect()
    assert {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in got} == want
    assert sum(w[2] > 0 for w in want.values()) > 20


def test_sentences_hold_the_whole_text():
    for _, t in corpus():
        own = sentences(t or "")
        assert ("".join(own) if own else t or "") == (t or "") and own == [s for s, _ in cut(t or "")]


def prose(rnd, n):
    return " ".join("w%d" % rnd.randrange(5000) for _ in range(n))


def lengths(spark, docs):
    got = drop_repeated_spans(spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], SCHEMA)).collect()
    return {r.doc_id: len(r.text.split()) for r in got}


def test_passages_of_fifty_words_are_found_and_others_stay(spark):
    rnd = random.Random(6)
    passages = [prose(rnd, 51) for _ in range(100)]
    docs = [f"{prose(rnd, 40)} {p} {prose(rnd, 40)}" for p in passages for _ in range(2)] + [prose(rnd, 131) for _ in range(100)]
    got = lengths(spark, docs)
    assert all(got[2 * i] == 131 for i in range(100)) and all(got[200 + i] == 131 for i in range(100))
    assert sum(got[2 * i + 1] < 131 - 25 for i in range(100)) >= 95


def test_cutting_depends_on_words_alone(spark):
    rnd = random.Random(7)
    verse = prose(rnd, 60)
    first, second = prose(rnd, 26), prose(rnd, 26)
    docs = [f"{prose(rnd, 20)}.\n{verse}\n{prose(rnd, 20)}.", f"{prose(rnd, 30)} {verse.replace(' ', chr(10))} {prose(rnd, 20)}", verse.replace(" ", "\t").upper()]
    docs += [f"{prose(rnd, a)} {first}. {second} {prose(rnd, a)}." for a in (3, 20)]
    got = lengths(spark, docs)
    assert got[0] == 100 and got[1] < 75 and got[2] < 25 and got[3] == 58 and got[4] < 60


def test_a_sentence_alone_is_no_span(spark):
    line = "one two three four five six seven eight nine ten eleven. "
    assert lengths(spark, [line + "a.", line + "b.", "c. " + line]) == {0: 12, 1: 12, 2: 12}


def test_odd_tables(spark):
    rnd = random.Random(8)
    text = prose(rnd, 60)
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0), (None, None, 0)], SCHEMA)
    got = drop_repeated_spans(df).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in got) == [(0, False), (0, False), (1, True), (1, True)]
    assert drop_repeated_spans(df.where("false")).count() == 0


def test_long_text_and_many_equal_rows(spark):
    rnd = random.Random(9)
    text, line = prose(rnd, 300_000), prose(rnd, 80)
    df = spark.createDataFrame([(1, text, 0), (2, text, 0)] + [(None, line, 0)] * 2000 + [(5, line, 0)], SCHEMA).repartition(4)
    got = drop_repeated_spans(df).collect()
    assert sum(r.doc_id is None and r.n_removed == 0 for r in got) == 2000
    assert {r.doc_id: r.text for r in got if r.doc_id in (2, 5)} == {2: "", 5: ""} or all(len(r.text.split()) < 25 for r in got if r.doc_id in (2, 5))
