from quillspark.operators import script as sc
from quillspark.operators import timeline as tl
from quillspark.sources import json_docs


def test_books_are_read_as_written(spark, tmp_path):
    chapters = spark.createDataFrame([("a", 2, "two", "y z", 2), ("a", 1, "one", "x", 1)], "book_id string, number int, title string, text string, word_count int")
    books = spark.createDataFrame([("a", "T", "A", "en", None), ("b", "U", None, "de", "c.png")], "book_id string, title string, author string, language string, cover_image_path string")
    json_docs.write_books(chapters, books, str(tmp_path / "books"))
    got = json_docs.read_book(spark, str(tmp_path / "books" / "_dir=a")).select("title", "author", "number", "chapter_title", "text", "word_count")
    assert [tuple(r) for r in got.orderBy("number").collect()] == [("T", "A", 1, "one", "x", 1), ("T", "A", 2, "two", "y z", 2)]
    meta = {r._dir: r.metadata for r in spark.read.json(str(tmp_path / "books")).collect()}
    assert (meta["a"].total_chapters, meta["a"].total_words, meta["b"].total_chapters, meta["b"].total_words) == (2, 3, 0, 0)


def test_registries_are_read_as_written(spark, tmp_path):
    rows = [("a", 1, "tom", "Tom", "male", ["sly"]), ("a", 0, "narrator", "N", None, None), ("b", 0, "x", "X", "other", [])]
    people = spark.createDataFrame(rows, "book_id string, ord int, id string, name string, gender string, personality_traits array<string>")
    json_docs.write_characters(people, str(tmp_path / "people"))
    got = json_docs.read_characters(spark, str(tmp_path / "people" / "_dir=a")).orderBy("ord").collect()
    assert [(r.ord, r.id, r.name, r.gender, r.personality_traits) for r in got] == [(0, "narrator", "N", None, None), (1, "tom", "Tom", "male", ["sly"])]
    voices = spark.createDataFrame([("p", "tom", "t.wav", 24000), ("p", "ann", "a.wav", None)], "project_id string, character_id string, file string, sample_rate int")
    json_docs.write_voices(voices, str(tmp_path / "voices"))
    got = json_docs.read_voices(spark, str(tmp_path / "voices" / "_dir=p")).orderBy("character_id").collect()
    assert [(r.character_id, r.file, r.sample_rate) for r in got] == [("ann", "a.wav", None), ("tom", "t.wav", 24000)]


def test_groups_pauses_and_results(spark):
    lines = spark.createDataFrame([("b", 1, i, s, sc_, p) for i, (s, sc_, p) in enumerate([("narrator", False, True), ("narrator", True, True), ("tom", None, True), ("narrator", None, None), ("ann", True, False)])], "book_id string, chapter_number int, line_ord int, speaker string, scene boolean, para boolean")
    assert [r.pause_after for r in sc.pauses_by_breaks(lines, "scene", "para").orderBy("line_ord").collect()] == [600, 1500, 300, 500, 2000]
    people = spark.createDataFrame([("b", "tom", "male"), ("b", "tom", None)], "book_id string, id string, gender string")
    assert {r.speaker: r.voice for r in sc.voice_groups(lines, people).collect()} == {"narrator": "narrator", "tom": "generic_male", "ann": "generic_other"}
    durations = spark.createDataFrame([("b", 1, 3600.5), ("b", 2, None), ("c", 1, 61.0)], "book_id string, number int, seconds double")
    files = spark.createDataFrame([("b", 1048576), ("b", 524288)], "book_id string, bytes long")
    got = {r.book_id: tuple(r)[1:] for r in tl.export_results(durations, files).collect()}
    assert got == {"b": (2, "1:00:00", 1.5), "c": (1, "0:01:01", 0.0)}
