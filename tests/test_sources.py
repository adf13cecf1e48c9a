"""Archives, sound files and JSON documents written here and read back."""

import io
import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import chapters as ch
from quillspark.operators import html as ht
from quillspark.schemas import split_by_ranges
from quillspark.sources import epub, json_docs, wav

OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Tale</dc:title><dc:creator>Ann</dc:creator></metadata>
<manifest><item id="b" href="b%20c.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="lost" href="x.xhtml" media-type="application/xhtml+xml"/><item id="img" href="Cover.png" media-type="image/png"/></manifest>
<spine><itemref idref="a"/><itemref idref="lost"/><itemref idref="b"/></spine></package>"""


def archive(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", OPF)
        z.writestr("O/a.xhtml", "<html><body><h1>Contents</h1><p>list</p></body></html>")
        z.writestr("O/b c.xhtml", "<html><body><h1>One</h1><p>" + "word " * 120 + "</p><h2>Two</h2><blockquote>verse<br/>two</blockquote><p>" + "more " * 120 + "</p></body></html>")
        z.writestr("O/Cover.png", b"png")


def test_epub(spark, tmp_path):
    archive(tmp_path / "tale.epub")
    book = epub.read_books(spark, str(tmp_path)).first()
    assert (book.title, book.author, book.language, book.n_documents, bytes(book.cover)) == ("A Tale", "Ann", "en", 2, b"png")
    docs = epub.read_documents(spark, str(tmp_path))
    assert [r.item_id for r in docs.orderBy("spine_ord").collect()] == ["a", "b"]
    rows = ch.chapters(epub.raw_chapters(docs)).orderBy("number").collect()
    assert [(r.number, r.title, r.word_count) for r in rows] == [(1, "One", 120), (2, "Two", 122)]
    with pytest.raises(ValueError):
        epub.read_archive(b"no archive")


@pytest.mark.parametrize(
    "html, want",
    [
        ("<h1>Glossary</h1><p>x</p>", []),
        ("<p>short</p>", []),
        ("<p>" + "long " * 20 + "</p>", [("", ("long " * 20).strip())]),
        ("<h1>A</h1>loose<p>one</p><p>two</p><h2>B</h2><div>three<p>four</p></div>", [("A", "one\n\ntwo"), ("B", "three four")]),
        ("<title>T</title><p>x</p><pre>Chapter 1\nbody here</pre>", [("Chapter 1", "body here")]),
        (None, []),
    ],
)
def test_sections(html, want):
    assert ht.document_sections(html) == want


def test_nested_blocks_are_told_twice():
    assert ht.full_text(ht.parse("<nav>no</nav><div>a<p>b</p></div><script>x</script>")) == "a b\n\nb"


def test_wav(spark, tmp_path):
    x = np.sin(np.arange(800) / 7) * 0.5
    df = spark.createDataFrame([("s1", 8000, x.tolist()), ("s2", 8000, [2.0, -2.0])], "name string, sample_rate int, pcm array<double>")
    for r in wav.encoded(df).collect():
        (tmp_path / f"{r.name if hasattr(r, 'name') else r['name']}.wav").write_bytes(r["content"])
    back = {r.path.rsplit("/", 1)[1]: r for r in wav.read_segments(spark, str(tmp_path)).collect()}
    assert np.allclose(back["s1.wav"].pcm, x, atol=1e-4) and back["s1.wav"].sample_rate == 8000
    assert np.allclose(back["s2.wav"].pcm, [1, -1], atol=1e-4)
    assert wav.read_segments(spark, str(tmp_path), to_rate=4000).where(F.size("pcm") == 400).count() == 1


def test_wav_widths():
    import wave

    for width, raw in ((1, bytes([0, 128, 255])), (3, b"\x00\x00\x80\x00\x00\x00\xff\xff\x7f"), (4, np.array([-(2**31), 0, 2**31 - 1], "<i4").tobytes())):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1), f.setsampwidth(width), f.setframerate(10), f.writeframes(raw)
        assert np.allclose(wav.decode(out.getvalue())[2], [-1, 0, 1], atol=0.01)


def test_json_documents(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps({"metadata": {"title": "T", "author": "A"}, "chapters": [{"number": 1, "title": "x", "text": "t", "word_count": 1}]}, indent=1))
    assert json_docs.read_book(spark, str(tmp_path / "book.json")).select("title", "number", "chapter_title").collect() == [("T", 1, "x")]
    (tmp_path / "characters.json").write_text(json.dumps({"characters": {"narrator": {"name": "N", "gender": "male"}, "b": {"id": "b", "name": "B"}}}))
    assert [r.id for r in json_docs.read_characters(spark, str(tmp_path / "characters.json")).orderBy("ord").collect()] == ["narrator", "b"]
    lines = spark.createDataFrame([(2, "c", "s", 0, "l0", "narrator", "hi", 1.0), (2, "c", "s", 1, "l1", "tom", "yo", 0.9)], "chapter_number int, chapter_title string, chapter_summary string, line_ord int, line_id string, speaker string, text string, speed double")
    json_docs.write_scripts(lines, str(tmp_path / "out"))
    [part] = (tmp_path / "out" / "_dir=2").glob("*.json")
    (tmp_path / "scripts").mkdir()
    part.rename(tmp_path / "scripts" / "chapter_002.json")
    got = json_docs.read_scripts(spark, str(tmp_path / "scripts")).orderBy("line_ord")
    assert got.select("chapter_number", "line_ord", "line_id", "speaker", "speed").collect() == [(2, 0, "l0", "narrator", 1.0), (2, 1, "l1", "tom", 0.9)]
    (tmp_path / "voices.json").write_text(json.dumps({"voices": {"tom": {"file": "t.wav", "sample_rate": 24000}}}))
    assert json_docs.read_voices(spark, str(tmp_path / "voices.json")).select("character_id", "file").collect() == [("tom", "t.wav")]


def test_ranges_set_rows_aside(spark):
    df = spark.createDataFrame([(1.0, 100), (3.0, 100), (None, 6000), (0.5, None)], "speed double, pause_before_ms int")
    good, bad = split_by_ranges(df)
    assert good.count() == 2 and bad.count() == 2


def test_page_texts_by_hand():
    from quillspark.operators.html import full_text, parse

    pages = {
        "<body>  one <b>two</b>\n<i> three </i></body>": "one\n\ntwo\n\nthree",
        "<p>a <b>b</b></p><pre>  first\n    second\n\nthird  </pre>": "a b\n\nfirst\n    second\n\nthird",
        "<div><p>x</p></div><script>no</script><nav><p>no</p></nav>": "x\n\nx",
        "": "",
    }
    assert {p: full_text(parse(p)) for p in pages} == pages


def test_catalogue_answers(spark):
    import json

    from quillspark.sources.catalogue import book_metadata

    info = {"title": "T", "authors": ["A", "B"], "industryIdentifiers": [{"type": "OTHER", "identifier": "x"}, {"type": "ISBN_10", "identifier": "10"}, {"type": "ISBN_13", "identifier": "13"}], "imageLinks": {"small": "http://s", "medium": "", "thumbnail": "http://t?zoom=1&u=http://v&zoom=10"}}
    rows = [(1, json.dumps({"items": [{"volumeInfo": info}, {"volumeInfo": {"title": "no"}}]})), (2, '{"items": []}'), (3, "{}"), (4, "broken"), (5, None), (6, '{"items": [{"volumeInfo": {}}]}')]
    got = {r.i: tuple(r)[2:] for r in book_metadata(spark.createDataFrame(rows, "i int, body string"), "body").collect()}
    assert got[1] == ("T", "A, B", "", "10", "https://t?zoom=3&u=https://v&zoom=30")
    assert all(got[i][2:] == (None, None, None) for i in (2, 3, 4, 5)) and got[6][2:] == ("", "", None)


def test_results_of_a_batch_leave_in_parts():
    """What a task holds doesn't grow with the rows of an Arrow batch; a page without rows takes nothing from its neighbours."""
    fields = [pa.field("n", pa.int32()), pa.field("text", pa.string())]
    pages = [None if i % 10 == 3 else f"<p>{i} " + "x" * 200_000 + "</p>" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(pages)], names=["k", "html"])
    out = list(ht.told([batch], lambda h: [(len(h), ht.full_text(ht.parse(h)))] * 2 if h else [], fields))
    assert max(sum(map(len, b["text"].to_pylist())) for b in out) <= ht.OUT_CHARS + 2 * 200_100
    rows = [r for b in out for r in b.to_pylist()]
    assert rows == [{"k": i, "n": len(h), "text": h[3:-4]} for i, h in enumerate(pages) if h for _ in range(2)]


def test_titles_cut_off_within_a_reference(spark):
    """As the SQL of b1_page_titles, which a parser of HTML doesn't follow for references without a semicolon."""
    titles = {"a &amp;&amp": "a &&amp", "b &lt;i&gt; &ampx; &am": "b <i> &ampx; &am", "c &#228; &nosuch; & d": "c ä &nosuch; & d"}
    rows = spark.createDataFrame([(i, f"<h1>{t}</h1><p>x</p>") for i, t in enumerate(titles)], "page_id long, html string")
    assert [r.title for r in ht.outlines(rows, ["page_id"], open_references=False).orderBy("page_id").collect()] == list(titles.values())
    assert ht.outlines(rows.limit(1), ["page_id"]).first().title == "a &&"
