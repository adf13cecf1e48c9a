"""Operator 12, HTML extraction: repeated runs of a host's pages found by a suffix array, unique runs kept.

Each page is cut into blocks of text, each either inside the page's main element or outside of it. What lies outside
forms the host's token streams (words, and a token for each block that starts). Distinct streams are put into
a suffix array by a range sort of their suffixes, to the depth of the shortest repeat that counts. Neighbours that
share that many tokens and come from different pages are a repeat. A block that repeats cover from end to end is
boilerplate; the others are unique. A host of a third of all pages is one range of the order like any other: equal
streams are counted before they are sorted, and ties are told apart by place, so that they fill many ranges.

What repeats can't tell, markup settles: elements and attributes that name menus, headers, footers, sidebars, notices,
adverts, forms and comments are dropped where the host has one page only or the text is unique; text inside the main
element is kept however often it repeats, since copies and shared passages are part of an article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Tables, null_safe
from .url_filter import host

#: Elements that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, up to their end tag; of these no text is kept.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: Elements without article text.
NEVER = RAW | frozenset("audio button canvas datalist head math object select svg template video".split())
#: Elements that are boilerplate by their name.
CHROME = frozenset("aside dialog footer form header menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that name boilerplate.
NAMES = frozenset(
    "ad ads adsense adslot advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disqus footer gdpr header login "
    "masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promotion promotions recommended related replies reply respond search "
    "share sharebar sharing sidebar signup social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
#: Of these the ones that never name something around the article.
BESIDE = frozenset("ad ads advert adverts advertisement advertisements comment comments commentlist disqus recommended related replies reply respond sidebar teaser teasers widget widgets".split())
#: A class with one of these in front says that a part is absent or beside the element.
DENIED = frozenset("has hide is no with without".split())
#: Elements that are closed by the start of one of these.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}}
CLOSES = {tag: [open_tag for open_tag, by in CLOSED_BY.items() if tag in by] for tag in BLOCKS}
SCOPES, TABLE = frozenset("article body div dl menu ol section table ul".split()), frozenset(["table"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@lru_cache(maxsize=8192)
def _facts(tag: str, attributes: str) -> tuple[bool, bool, int, bool]:
    """Of a start tag: whether its content is never text, is boilerplate by element or role, by class or id (2: whatever it holds), is the main element."""
    given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    role = given.get("role", "").lower()
    style = re.sub(r"\s", "", given.get("style", "")).lower()
    gone = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    named = 0
    for token in (given.get("class", "") + " " + given.get("id", "")).split():
        words = [w.lower() for w in _NAME.findall(token)]
        if words and words[0] not in DENIED and not NAMES.isdisjoint(words):
            named = max(named, 1 if BESIDE.isdisjoint(words) else 2)
    if tag in ("html", "body"):
        return gone, False, 0, False
    main = (tag in ("article", "main") or role in ("article", "main") or given.get("itemprop") == "articleBody") and not named
    return tag in NEVER or gone, (tag in CHROME or role in ROLES) and not main, named, main


class _Element:
    """An open element, with what it takes over from those around it, so that deep nesting is read once."""

    __slots__ = ("tag", "chrome", "named", "main", "holds_main", "parent", "never", "heading", "mute", "telling")

    def __init__(self, tag: str, attributes: str, parent: _Element | None) -> None:
        self.tag, self.parent, self.holds_main = tag, parent, False
        never, self.chrome, self.named, self.main = _facts(tag, attributes)
        self.never = never or bool(parent and parent.never)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        within_line = parent and parent.tag not in BLOCKS
        self.mute = never or self.chrome or bool(self.named) or bool(within_line and parent.mute)
        self.telling = self if self.chrome or self.named or self.main else parent and parent.telling

    def around(self) -> Iterator[_Element]:
        """This element and those around it that tell whether text is boilerplate, inside out."""
        e = self.telling
        while e:
            yield e
            e = e.parent and e.parent.telling


class Block:
    """Text of a block and the element that it stands in; ``linked`` if all of it is in links."""

    __slots__ = ("tag", "text", "inside", "linked")

    def __init__(self, tag: str, text: str, inside: _Element | None, linked: bool) -> None:
        self.tag, self.text, self.inside, self.linked = tag, text, inside, linked

    def never(self) -> bool:
        return bool(self.inside and self.inside.never)

    def heading(self) -> bool:
        return bool(self.inside and self.inside.heading)

    def chrome(self) -> bool:
        """Inside boilerplate. A header within a main element keeps its headings; names don't count around a main element."""
        headers = False
        for e in self.inside.around() if self.inside else ():
            if e.main:
                headers = False
                if e.tag == "main":  # no boilerplate holds this element
                    return False
            if e.chrome or e.named == 2 or e.named and not e.holds_main:
                if e.tag != "header" or not self.heading():
                    return True
                headers = True
        return headers

    def main(self) -> bool:
        return bool(self.inside) and any(e.main for e in self.inside.around())


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space folded, references decoded; empty ones are left out."""
    out: list[Block] = []
    top: _Element | None = None
    opened: Counter = Counter()
    parts: list[tuple[str, bool]] = []
    links, name, at, links_seen = 0, "", 0, False

    def ends() -> None:
        nonlocal parts
        if not parts:
            return
        text = " ".join("".join([p for p, _ in parts]).split())
        if text:
            out.append(Block(name, text, top, links_seen and all(k for p, k in parts if p.strip())))
        parts = []

    def said(raw: str) -> None:
        if raw and not (top and top.tag not in BLOCKS and top.mute):
            parts.append((html.unescape(raw) if "&" in raw else raw, links > 0))

    def leave(tag: str, within: frozenset) -> None:
        """Close the innermost open ``tag``, unless one of ``within`` is nearer."""
        nonlocal top
        if not opened[tag]:
            return
        e = top
        while e.tag != tag and e.tag not in within:
            e = e.parent
        if e.tag == tag:
            while top is not e.parent:
                opened[top.tag] -= 1
                top = top.parent

    end = len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if not m:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                said(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                ends()
                name = ""
            if tag == "a":
                links = max(0, links - 1)
            if tag == "br":
                parts.append((" ", True))
            leave(tag, TABLE if tag != "table" else frozenset())
            continue
        if tag in BLOCKS:
            ends()
            links, name = 0, tag
            for open_tag in CLOSES[tag]:
                leave(open_tag, SCOPES)
        if tag in VOID or m[3].endswith("/") and tag not in RAW and tag not in BLOCKS:
            if tag in ("br", "wbr", "hr"):
                parts.append(("" if tag == "wbr" else " ", True))
            continue
        if tag == "a":
            links, links_seen = 1, True
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        top = _Element(tag, m[3], top)
        opened[tag] += 1
        if top.main:
            e = top.parent
            while e and not e.holds_main:
                e.holds_main = True
                e = e.parent
    ends()
    return out


def judged(page: str) -> tuple[list[Block], list[int], list[bool]]:
    """Blocks that may be text, for each 0 (boilerplate by its markup), 1 (open) or 2 (main), and whether it is outside the main element."""
    found = [b for b in blocks(page) if not b.never()]
    chrome = [b.chrome() for b in found]
    main = [b.main() and not c for b, c in zip(found, chrome)]
    marked = any(main)
    first = next((i for i, k in enumerate(main) if k), 0)
    titled = any(k and b.tag == "h1" for b, k in zip(found, main))
    kinds = []
    for i, (b, c, k) in enumerate(zip(found, chrome, main)):
        # Beside a main element only the headline above it can belong to the article.
        kinds.append(2 if k else 0 if c or marked and not (b.tag == "h1" and i < first and not titled) else 1)
    run = 0
    for i, b in enumerate([*found, None]):  # three or more links in a row are a menu
        if b and kinds[i] == 1 and b.linked and not b.heading():
            run += 1
            continue
        if run >= 3:
            kinds[i - run : i] = [0] * run
        run = 0
    return found, kinds, [k != 2 for k in kinds]


def _tokens(run: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a run of blocks as hashes, and where each block starts: the name of its element, then its words."""
    out, starts = [], []
    for b in run:
        starts.append(len(out))
        out.append(xxhash.xxh32_intdigest(f"<{b.tag}>"))
        out += [xxhash.xxh32_intdigest(w) for w in b.text.split()]
    return np.array(out, ">u4"), np.array(starts, np.int32)


def _runs(found: list[Block], outside: list[bool]) -> Iterator[list[int]]:
    own: list[int] = []
    for i, o in enumerate(outside):
        if o:
            own.append(i)
        elif own:
            yield own
            own = []
    if own:
        yield own


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, k1, k2, page, run, stream, n_tokens, starts, tokens, unsettled): the runs of blocks outside the main element.

    ``page`` is a hash of all blocks, so that pages of the same text count once. ``unsettled`` are the
    places within the page of blocks that only repeats can tell, null for the others.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32())]
    names = ["host", "k1", "k2", "page", "run", "stream", "starts", "tokens", "unsettled"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for h, k1, k2, page in zip(*(c.to_pylist() for c in batch.columns)):
            found, kind, outside = judged(page)
            own = np.uint64(xxhash.xxh3_64_intdigest("\0".join(b.text for b in found))).view(np.int64)
            for at, run in enumerate(_runs(found, outside)):
                tokens, starts = _tokens([found[i] for i in run])
                stream = np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)
                unsettled = [i if kind[i] == 1 else None for i in run]
                for column, v in zip(rows, (h, k1, k2, int(own), at, int(stream), starts.tolist(), tokens.tobytes(), unsettled if any(u is not None for u in unsettled) else None)):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)


def _suffixes(depth: int):
    """Suffixes of at least ``depth`` tokens as rows (host, s, stream, p, low, high), ``s`` being their first tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, stream, tokens, low, high = batch.columns
            for i, own in enumerate(tokens):
                data = own.as_py()
                for lo in range(0, max(0, len(data) // 4 - depth + 1), 50_000):
                    at = range(lo, min(lo + 50_000, len(data) // 4 - depth + 1))
                    s = pa.array([data[4 * p : 4 * (p + depth)] for p in at], pa.binary())
                    same = (pa.array([x[i].as_py()] * len(at), pa.int64()) for x in (h, stream, low, high))
                    a, b, c, d = same
                    yield pa.RecordBatch.from_arrays([a, s, b, pa.array(at, pa.int32()), c, d], names=["host", "s", "stream", "p", "low", "high"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes in order, rows (host, stream, p, s, low, high): repeats, and, with ``s``, the first and last interval of a batch.

    An interval is a run of neighbours that share the depth; it is a repeat if it holds two pages. The first
    and last one of a batch may go on in others, so theirs is settled afterwards.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        h, s, stream, p, low, high = batch.columns
        key = np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(len(s), -1)
        h_, low_, high_ = (np.asarray(c) for c in (h, low, high))
        new = np.concatenate(([True], (h_[1:] != h_[:-1]) | (key[1:] != key[:-1]).any(axis=1)))
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        repeat = np.minimum.reduceat(low_, first)[of] != np.maximum.reduceat(high_, first)[of]
        edge = ((of == 0) | (of == of[-1])) & ~repeat
        take = np.flatnonzero(repeat | edge)
        # A repeat at the edge is settled here, but tells the interval's other parts that it is one.
        tell = (of == 0) | (of == of[-1])
        t = pa.array(take)
        yield pa.RecordBatch.from_arrays([h.take(t), stream.take(t), p.take(t), pa.array([s[i].as_py() if tell[i] else None for i in take], pa.binary()), low.take(t), high.take(t), pa.array(repeat[take])], names=["host", "stream", "p", "s", "low", "high", "same"])


def _covered(depth: int):
    """Of each stream (host, stream, starts, n_tokens, places) the numbers of the blocks that repeats cover from end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, stream, starts, size, places = batch.columns
            out = []
            for own, n, at in zip(starts.to_pylist(), size.to_pylist(), places):
                change = np.zeros(n + 1, np.int64)
                at = np.asarray(at.values)
                np.add.at(change, at, 1)
                np.add.at(change, at + depth, -1)
                open_before = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) == 0)))
                ends = [*own[1:], n]
                out.append([i for i, (a, b) in enumerate(zip(own, ends)) if open_before[b] == open_before[a]])
            yield pa.RecordBatch.from_arrays([h, stream, pa.array(out, pa.list_(pa.int32()))], names=["host", "stream", "covered"])

    return run


def repeated_blocks(streams: DataFrame, depth: int, stage: Tables) -> DataFrame:
    """Blocks of each distinct stream that are boilerplate of their host: ``(host, stream, covered array<int>)``."""
    distinct = streams.groupBy("host", "stream").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.first("tokens").alias("tokens"), F.first("starts").alias("starts"))
    distinct = stage(distinct, "streams")
    kinds = "host long, stream long, p int, s binary, low long, high long"
    order = distinct.select("host", "stream", "tokens", "low", "high").mapInArrow(_suffixes(depth), "host long, s binary, stream long, p int, low long, high long")
    place = ["host", "s", "stream", "p"]
    found = order.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(_neighbours, kinds + ", same boolean")
    found = stage(found, "neighbours")
    across = found.where("s is not null").groupBy("host", "s").agg(F.min("low").alias("l"), F.max("high").alias("h"))
    across = stage(across.where("l <> h").select("host", "s"), "across")
    late = found.where("not same").join(across, ["host", "s"]).select("host", "stream", "p")
    places = found.where("same").select("host", "stream", "p").union(late).groupBy("host", "stream").agg(F.collect_list("p").alias("places"))
    sized = distinct.select("host", "stream", "starts", (F.octet_length("tokens") / 4).cast("int").alias("n_tokens"))
    return stage(sized.join(places, ["host", "stream"]).mapInArrow(_covered(depth), "host long, stream long, covered array<int>"), "boilerplate")


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages (id, url, html, unique): main blocks, and the open ones among those that are unique."""
    for batch in batches:
        texts = []
        for page, unique in zip(batch.column(2), batch.column(3).to_pylist()):
            found, kinds, _ = judged(page.as_py() or "")
            own = set(unique or ())
            texts.append("\n\n".join(b.text for i, (b, k) in enumerate(zip(found, kinds)) if k == 2 or k == 1 and i in own))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["_id", "_url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = 6) -> DataFrame:
    """The main text of each page as ``(id, url, text)``, blocks joined by an empty line.

    ``depth`` tokens make a repeat: words, and one for each block that starts. Pages of one host whose texts are equal
    in full count as one page. Null and empty pages have an empty text; a null URL or one without ``://`` counts as the
    host of no name. Markup may be broken: unclosed elements end with the page. Texts of any length are read whole, a page at a
    time. Repeated rows and null ids keep a row each; an empty table gives an empty table; other columns are ignored.
    Pages are known by two hashes of URL and content, tokens by hashes.
    """
    stage = Tables()
    t = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    t = t.withColumn("k1", F.xxhash64("_url", "_html")).withColumn("k2", F.hash("_html", "_url"))
    k2 = F.col("k2").cast("long").alias("k2")
    streams = t.where(F.length("_html") > 0).select(F.xxhash64(host(F.col("_url"))).alias("host"), "k1", k2, "_html").mapInArrow(
        _streams, "host long, k1 long, k2 long, page long, run int, stream long, starts array<int>, tokens binary, unsettled array<int>"
    )
    streams = stage(streams, "runs")
    covered = repeated_blocks(streams, depth, stage)
    asked = streams.where("unsettled is not null").select("host", "stream", "k1", "k2", "run", F.posexplode("unsettled").alias("i", "place")).where("place is not null")
    asked = asked.join(covered, ["host", "stream"], "left").where(F.col("covered").isNull() | ~F.array_contains("covered", F.col("i")))
    unique = stage(asked.groupBy("k1", "k2").agg(F.collect_set("place").alias("unique")).withColumn("k2", F.col("k2").cast("int")), "unique")
    stage.close(unique)
    out = t.join(unique, null_safe(t, unique, "k1", "k2"), "left").select("_id", "_url", "_html", "unique")
    kind, url = (t.schema[c].dataType.simpleString() for c in ("_id", "_url"))
    return out.mapInArrow(_text, f"_id {kind}, _url {url}, text string").withColumnsRenamed({"_id": id_col, "_url": url_col})


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
