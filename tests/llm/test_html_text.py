"""HTML extraction: markup by hand, repeats against loops over all pages of a host."""

import html
import re
from collections import defaultdict

from quillspark.llm import html_text
from quillspark.llm.html_text import blocks, judged, main_text, op12_html_text, repeated_blocks
from quillspark.runtime import Tables

DATA = "/root/testdata/sf0.01"
KEPT = "Kept one.\n\nKept two."


def text_of(page):
    found, kinds, _ = judged(page)
    return "\n\n".join(b.text for b, k in zip(found, kinds) if k)


def test_query_keeps_articles_whole(spark):
    got = {r.page_id: r for r in op12_html_text(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(x for x in parts if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_markup():
    cases = {
        "<article><p>Kept one.<p>Kept two.</article>": KEPT,
        "<main><nav>x</nav><p>Kept <b>one</b>.</p><aside>x</aside><p>Kept\n\t two.</p><footer>x</footer></main><footer>y</footer>": KEPT,
        "<div class='site-header'>x</div><article><header><h1>Kept one.</h1><span>by x</span></header><p>Kept two.</p><section id=comments><article>x</article></section></article>": KEPT,
        "<body class='no-sidebar has-comments'><div id='nav-wrapper'><article><p>Kept one.</p><div class='ad'>x</div><p>Kept two.</p><form><p>x</p></form></article></div>": KEPT,
        "<p>Kept one.</p><script>var a = '</p><p>x';</script><style>p{}</style><!-- <p>x</p> --><p>Kept <button>x</button>two<span class='share'>x</span>.</p><noscript>x</noscript>": KEPT,
        "<header><h1>x</h1><main><p>Kept one.</p><p>Kept two.</p></main>": KEPT,
        "<table><tr><td>Kept one.<td>Kept two.</table><div role='navigation'>x</div><div class='cookieNotice'>x</div><div hidden>x</div>": KEPT,
        "<div><a href=1>x</a></div><div><a href=2>y</a></div><div><a href=3>z</a></div><p>Kept one.</p><p><a href=4>Kept two.</a></p>": KEPT,
        "<article>a&amp;b &lt;i&gt; &eacute;&#233;&#xE9; &amp &am x<br>y&nbsp;z</article>": "a&b <i> ééé & &am x y z",
        "<ul><li>Kept one.<li>Kept two.</ul><p title='a > b'></p><div class='comment-list'><p>x</p></div>": KEPT,
        "Kept one.<hr>Kept two.<title>x": KEPT,
        "": "",
        "<p>1 < 2 & 3": "1 < 2 & 3",
        "</div></p><article>": "",
    }
    for page, want in cases.items():
        assert text_of(page) == want, page


def test_deep_and_broken_markup_ends():
    assert text_of("<div>" * 20_000 + "<p>Kept one.</p>" + "</div>" * 5 + "<p>Kept two.") == KEPT
    assert text_of("<article><p>" + "word " * 1_000_000 + "</p>") == " ".join(["word"] * 1_000_000)
    assert text_of("<article>Kept one.<script>") == "Kept one."
    assert text_of("<b>a " * 50_000 + "</i>" * 50_000) == " ".join("a" * 50_000)
    assert len(text_of("<div>a" * 20_000)) == 3 * 20_000 - 2
    assert len(text_of("<p><a class=x>" * 20_000 + "a")) == 1


def page(*parts):
    return "<html><body>" + "".join(f"<div>{p}</div>" for p in parts) + "</body></html>"


def brute(rows, depth):
    """Blocks of each (url, page) that repeats of ``depth`` tokens cover, by sets of all strings of a host."""
    seen, streams = defaultdict(set), {}
    for url, text in rows:
        found = blocks(text)
        tokens = [t for b in found for t in [f"<{b.tag}>", *b.text.split()]]
        starts = [0]
        for b in found:
            starts.append(starts[-1] + 1 + len(b.text.split()))
        streams[url, text] = tokens, starts
        h = re.sub(r"^.*?://([^/?#]*).*", r"\1", url)
        for p in range(len(tokens) - depth + 1):
            seen[h, tuple(tokens[p : p + depth])].add(" ".join(tokens))
    out = {}
    for (url, text), (tokens, starts) in streams.items():
        h = re.sub(r"^.*?://([^/?#]*).*", r"\1", url)
        hit = set()
        for p in range(len(tokens) - depth + 1):
            if len(seen[h, tuple(tokens[p : p + depth])]) > 1:
                hit |= set(range(p, p + depth))
        out[url, text] = [i for i, (a, b) in enumerate(zip(starts, starts[1:])) if not set(range(a, b)) <= hit]
    return out


def test_repeats_agree_with_all_strings_of_a_host(spark):
    docs = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) between 200 and 900").orderBy("doc_id").limit(60).collect()]
    top, end = "Home News Sport Weather About the site", "All rights reserved by the owners of this site and their heirs"
    rows = []
    for i, d in enumerate(docs):
        a, b = html.escape(d[: len(d) // 2]), html.escape(d[len(d) // 2 :])
        rows.append((f"http://h{i % 3 if i < 50 else i}.org/{i}", page(top, a, "Read on", b, f"{end} {i % 7}" if i % 2 else end, "Short")))
    rows += [(rows[0][0] + "?print", rows[0][1]), (rows[3][0], rows[3][1])]
    want = brute(rows, 6)
    t = spark.createDataFrame([(i, u, h, 1, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text int, `a.b` string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # intervals run across batches
    try:
        got = {r.page_id: r.text for r in main_text(t).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, (u, h) in enumerate(rows):
        found = blocks(h)
        assert got[i] == "\n\n".join(found[k].text for k in want[u, h]), (u, h)
    assert top not in got[0] and end not in got[0] and got[0] == got[len(rows) - 2]  # the printed copy isn't a repeat of it
    assert top in got[55]  # a host of one page


def test_hot_stream_and_its_variants(spark):
    end = " ".join(f"w{i}" for i in range(9))
    rows = [(f"http://h.org/{i}", page(f"Own text number {i} is here", end if i % 3 else f"{end} {i}")) for i in range(300)]
    t = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in main_text(t).collect()}
    assert all(got[i] == [f"Own text number {i} is here"] + ([] if i % 3 else [f"{end} {i}"]) for i in range(300))


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://a.b/", "<p>x</p>"), (2, "no scheme", ""), (3, "", "   "), (4, "http://a.b/", None), (5, "http://a.b/", "<nav>x</nav>")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.url or "", r.text) for r in main_text(t).collect())
    assert got == [(0, "http://a.b/", "x"), (1, "", ""), (1, "", ""), (2, "no scheme", ""), (3, "", ""), (4, "http://a.b/", ""), (5, "http://a.b/", "")]
    assert main_text(t.limit(0)).collect() == []
    assert repeated_blocks(spark.createDataFrame([], "host long, stream long, page long, tokens binary, starts array<int>"), 6, Tables()).collect() == []
    assert html_text.NAMES >= html_text.BESIDE
