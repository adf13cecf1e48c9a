"""Queries of cleaning, chapters and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chapters as ch
from .registry import query
from .views import query as sql
from .views import view

# The cleaning rules as the oracle states them.
_BLANK = "[\\s\\x0b\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]"
_WORDS = "list_filter(regexp_split_to_array({0}, '" + _BLANK.replace("{{", "{{{{").replace("}}", "}}}}") + "+'), lambda x: x <> '')"
_LIG = "replace(replace({0}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
_SP = "replace(replace(replace({0}, chr(160), ' '), chr(8203), ''), chr(8232), chr(10))"
_QUO = "translate({0}, '“”„‟«»‘’‚‛', '\"\"\"\"\"\"''''''''')"
_DASH = "translate(regexp_replace(regexp_replace(replace({0}, '–', '—'), '---+', '—', 'g'), '--', '—', 'g'), '‒―', '——')"
_PAGE = "regexp_replace({0}, '(?m)^\\s*\\d{{1,4}}\\s*$', '', 'g')"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_HEAD = (
    "array_to_string(list_filter(string_split({0}, chr(10)), lambda l: NOT (" + _STRIP.format("l") + " <> '' AND " + _STRIP.format("l") + " = upper(" + _STRIP.format("l") + ") AND length(" + _STRIP.format("l") + ") < 60 AND len(regexp_split_to_array("
    + _STRIP.format("l") + ", '\\s+')) <= 5 AND NOT starts_with(" + _STRIP.format("l") + ", '\"'))), chr(10))"
)
_TIDY = "regexp_replace(regexp_replace(regexp_replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^[ \\t]+|[ \\t]+$', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def chain(x: str) -> str:
    for rule in (_LIG, _SP, _QUO, _DASH, _PAGE):
        x = rule.format(x)
    return x


CLEAN = (
    "c1 AS (SELECT source AS book_id, doc_id, " + chain("nfc_normalize(text)") + " AS t FROM {{dirty}}), c2 AS (SELECT book_id, doc_id, " + _HEAD.format("t") + " AS t FROM c1), "
    "clean AS (SELECT book_id, doc_id, " + _STRIP.format(_TIDY.format("t")) + " AS text FROM c2)"
)
CLEAN = CLEAN.replace("{{dirty}}", "{dirty}").replace("{1,4}", "{{1,4}}").replace("{2,}", "{{2,}}").replace("{3,}", "{{3,}}")


def _one(name: str, rule: str, f):
    @query(name, f"SELECT doc_id, md5({rule.format('text').replace('{1,4}', '{{1,4}}').replace('{2,}', '{{2,}}').replace('{3,}', '{{3,}}')}) AS digest FROM {{dirty}}")
    def run(spark, d):
        return view(spark, d, "dirty").select("doc_id", F.md5(f("text").cast("binary")).alias("digest"))

    run.__doc__ = f.__doc__


_one("c1_nfc", "nfc_normalize({0})", tx.composed)
_one("c2_ligatures", _LIG, tx.ligatures)
_one("c3_spaces", _SP, tx.plain_spaces)
_one("c4_quotes", _QUO, tx.plain_quotes)
_one("c5_dashes", _DASH, tx.em_dashes)
_one("c6_page_numbers", _PAGE, tx.without_page_numbers)
_one("c7_headers", _HEAD, tx.without_headers)
_one("c8_blanks", _TIDY, tx.tidy_blanks)


@query("c0_clean_text", f"WITH {CLEAN} SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM clean")
def c0_clean_text(spark, d):
    rows = view(spark, d, "dirty").select("doc_id", tx.cleaned("text").alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("c9_word_count", "SELECT doc_id, len(" + _WORDS.format("text") + ") AS n_words FROM {dirty}")
def c9_word_count(spark, d):
    return view(spark, d, "dirty").select("doc_id", tx.word_count("text").cast("long").alias("n_words"))


RAW = f"""WITH {CLEAN}, k AS (SELECT c.book_id, r.ord, r.title, c.text, {_WORDS.format('c.text')} AS w FROM clean c JOIN (SELECT source AS book_id, doc_id, doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Title ', doc_id) END AS title FROM {{documents}}) r USING (book_id, doc_id))"""


@query("d1_min_words", RAW + " SELECT book_id, ord, len(w) AS n_words FROM k WHERE len(w) >= 100")
def d1_min_words(spark, d):
    rows = view(spark, d, "raw_chapters").select("book_id", F.col("ord").cast("long").alias("ord"), tx.word_count(tx.cleaned("text")).cast("long").alias("n_words"))
    return rows.where("n_words >= 100")


NUMBERED = (
    RAW
    + """, s AS (SELECT *, CASE WHEN len(w) > 400 THEN (len(w) + 399) // 400 ELSE 1 END AS parts FROM k WHERE len(w) >= 100),
b AS (SELECT *, coalesce(sum(parts) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
e AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM b),
n AS (SELECT book_id, CAST(before + part AS INT) AS number, CASE WHEN title = '' THEN concat('Chapter ', CAST(before + part AS INT)) WHEN parts > 1 THEN concat(title, ' (Part ', part, ')') ELSE title END AS title,
CASE WHEN parts > 1 THEN array_to_string(w[(part - 1) * 400 + 1:part * 400], ' ') ELSE text END AS text, CASE WHEN parts > 1 THEN len(w[(part - 1) * 400 + 1:part * 400]) ELSE len(w) END AS word_count FROM e)"""
)


@query("g1_chapters", NUMBERED + " SELECT book_id, number, title, md5(text) AS digest, CAST(word_count AS INT) AS word_count FROM n")
def g1_chapters(spark, d):
    out = ch.chapters(view(spark, d, "raw_chapters"), max_words=400)
    return out.select("book_id", "number", "title", F.md5(F.col("text").cast("binary")).alias("digest"), "word_count")


@query("f1_book_totals", NUMBERED + " SELECT book_id, count(*) AS total_chapters, CAST(sum(word_count) AS BIGINT) AS total_words FROM n GROUP BY 1")
def f1_book_totals(spark, d):
    return ch.book_totals(ch.chapters(view(spark, d, "raw_chapters"), max_words=400))


@query(
    "d2_full_text",
    RAW + " SELECT book_id, CAST(row_number() OVER w - 1 AS BIGINT) AS part, CAST(coalesce(sum(length(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, "
    "md5(text) AS digest, CAST(len(w) AS INT) AS n_words FROM k WHERE text IS NOT NULL WINDOW w AS (PARTITION BY book_id ORDER BY ord)",
)
def d2_full_text(spark, d):
    """The full text of every book as ordered parts."""
    out = ch.full_text_parts(ch.cleaned_sections(view(spark, d, "raw_chapters")))
    return out.select("book_id", "part", "start_char", F.md5(F.col("text").cast("binary")).alias("digest"), "n_words")


@query(
    "g4_word_chunks",
    "WITH w AS (SELECT doc_id, " + _WORDS.format("text") + " AS w FROM {documents}), k AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) > 600 THEN (len(w) - 600 + 449) // 450 ELSE 0 END + 1)) AS c FROM w WHERE len(w) > 0) "
    "SELECT doc_id, CAST(c AS INT) AS chunk, CAST(c * 450 AS INT) AS start_word, CAST(len(w[c * 450 + 1:c * 450 + 600]) AS INT) AS n_words, md5(array_to_string(w[c * 450 + 1:c * 450 + 600], ' ')) AS digest FROM k",
)
def g4_word_chunks(spark, d):
    out = ch.word_chunks(view(spark, d, "documents"), ["doc_id"], 600, 150)
    return out.select("doc_id", "chunk", "start_word", "n_words", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "g15_context_budget",
    """WITH c AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number, concat('T', doc_id) AS title, text FROM {documents}),
s AS (SELECT *, number = 1 AND length(text) < 15000 AS whole, substr(text, 1, 500) AS t FROM c),
e AS (SELECT *, concat('## ', title, CASE WHEN whole THEN concat(' [FULL TEXT]', chr(10), chr(10), text) ELSE concat(' [SUMMARY]', chr(10), chr(10), CASE WHEN contains(t, '.') THEN regexp_extract(t, '(?s)^(.*)\\.', 1) ELSE t END, '.') END) AS entry FROM s),
u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY book_id ORDER BY number) AS used FROM e),
o AS (SELECT *, max(CASE WHEN used > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY number) AS past FROM u)
SELECT book_id, number, CASE WHEN whole THEN 'FULL TEXT' ELSE 'SUMMARY' END AS strategy, md5(entry) AS digest, CAST(used AS BIGINT) AS used FROM o WHERE past = 0""",
)
def g15_context_budget(spark, d):
    from pyspark.sql import Window

    docs = view(spark, d, "documents")
    rows = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("number"), F.concat(F.lit("T"), "doc_id").alias("title"), "text")
    out = ch.context_budget(rows, limit=6000)
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("number"))  # of the few that fit, which come first
    return out.withColumn("number", place).select("book_id", "number", "strategy", F.md5(F.col("entry").cast("binary")).alias("digest"), F.col("used").cast("long").alias("used"))


_TITLES = "(SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'Table of  Contents' WHEN doc_id % 8 = 1 THEN 'MAPS' WHEN doc_id % 8 = 2 THEN 'roadmap' WHEN doc_id % 8 = 3 THEN 'About the Author' WHEN doc_id % 8 = 4 THEN '' ELSE substr(text, 1, 30) END AS title, text FROM {documents})"


@query(
    "b1_skipped_documents",
    "SELECT doc_id, CASE WHEN title = '' THEN length(trim(text)) < 50 ELSE regexp_matches(title, '(?i)\\b(table\\s+of\\s+contents|contents|appendix|appendices|glossary|dramatis\\s+personae|map|maps|acknowledgments?|acknowledgements?|dedication|copyright|colophon|about\\s+the\\s+author|also\\s+by|other\\s+books?\\s+by|preview|excerpt|teaser)\\b') END AS skipped FROM " + _TITLES,
)
def b1_skipped_documents(spark, d):
    n = F.col("doc_id") % 8
    title = F.when(n == 0, "Table of  Contents").when(n == 1, "MAPS").when(n == 2, "roadmap").when(n == 3, "About the Author").when(n == 4, "").otherwise(F.substring("text", 1, 30))
    return view(spark, d, "documents").select("doc_id", ch.is_skipped_document(title, "text").alias("skipped"))


@query("b5_heading_lines", "SELECT doc_id, len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '(?i)^(chapter|part)\\s+(\\d+|[ivxlcdm]+)|(?i)^(prologue|epilogue|interlude)\\b|^\\d+\\.\\s'))) AS n FROM (SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'Chapter IV' WHEN doc_id % 3 = 1 THEN '12. Title' ELSE 'Prologues' END, chr(10), text) AS t FROM {documents})")
def b5_heading_lines(spark, d):
    n = F.col("doc_id") % 3
    t = F.concat(F.when(n == 0, "Chapter IV").when(n == 1, "12. Title").otherwise("Prologues"), F.lit("\n"), "text")
    return view(spark, d, "documents").select("doc_id", F.size(F.filter(F.split(t, "\n"), ch.is_heading_line)).cast("long").alias("n"))


@query(
    "b4_heading_sections",
    """WITH t AS (SELECT doc_id, concat('front', chr(10), 'Chapter 1', chr(10), substr(text, 1, 50), chr(10), 'Epilogue', chr(10), substr(text, 51)) AS t FROM {documents}),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS p FROM t),
h AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^(chapter|part)\\s+(\\d+|[ivxlcdm]+)|(?i)^(prologue|epilogue|interlude)\\b|^\\d+\\.\\s') THEN 1 ELSE 0 END AS hd FROM l),
s AS (SELECT *, sum(hd) OVER (PARTITION BY doc_id ORDER BY p) AS section FROM h),
b AS (SELECT doc_id, section, regexp_replace(coalesce(string_agg(CASE WHEN hd = 0 THEN line END, chr(10) ORDER BY p), ''), '^\\s+|\\s+$', '', 'g') AS body FROM s WHERE section > 0 GROUP BY 1, 2)
SELECT doc_id, CAST(section AS INT) AS section, md5(body) AS digest FROM b WHERE body <> ''""",
)
def b4_heading_sections(spark, d):
    t = F.concat(F.lit("front\nChapter 1\n"), F.substring("text", 1, 50), F.lit("\nEpilogue\n"), F.substring("text", 51, 1 << 30))
    out = ch.split_by_heading_lines(view(spark, d, "documents").select("doc_id", t.alias("text")), ["doc_id"])
    return out.select("doc_id", "section", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("j1_slug", "SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), 1, 64) AS slug FROM {documents}")
def j1_slug(spark, d):
    return view(spark, d, "documents").select("doc_id", tx.slug("text").alias("slug"))


SLUGS = "SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN concat(lang, '-', doc_id % 9) WHEN doc_id % 50 = 8 THEN concat(lang, '-', doc_id % 9, '-1') ELSE lang END AS slug FROM {documents}"


@query(
    "j2_slug_collisions",
    f"""WITH s AS ({SLUGS}), t AS (SELECT unnest(['en', 'en-1', 'en-3', 'fr-2']) AS slug), n AS (SELECT slug FROM s UNION SELECT slug FROM t),
r AS (SELECT doc_id, slug, row_number() OVER (PARTITION BY slug ORDER BY doc_id) - 1 + CASE WHEN slug IN (SELECT slug FROM t) THEN 1 ELSE 0 END AS k FROM s),
c AS (SELECT slug, unnest(range(1, 2 * max(k) + 20)) AS number FROM r GROUP BY slug),
f AS (SELECT slug, number, row_number() OVER (PARTITION BY slug ORDER BY number) AS k FROM c WHERE concat(slug, '-', number) NOT IN (SELECT slug FROM n))
SELECT r.doc_id, CASE WHEN r.k = 0 THEN r.slug ELSE concat(r.slug, '-', f.number) END AS project_id FROM r LEFT JOIN f ON f.slug = r.slug AND f.k = r.k""",
)
def j2_slug_collisions(spark, d):
    """The SQL finds names by trial: of all numbers those whose name is free, in order."""
    from ..operators import state as stt

    taken = spark.createDataFrame([("en",), ("en-1",), ("en-3",), ("fr-2",)], "slug string")
    return stt.free_slugs(sql(spark, d, SLUGS), taken, "doc_id", "doc_id").select("doc_id", "project_id")


_PART = "[^\\p{{L}}\\p{{M}}\\p{{N}}_]"


def whole_words(text: str, word: str, put: str) -> str:
    """The oracle's replacement of whole words: its word boundary knows ASCII alone, so each side is matched."""
    once = "regexp_replace({0}, '(?i)(^|" + _PART + ")" + word + "(" + _PART + "|$)', '\\1" + put + "\\2', 'g')"
    return once.replace("{0}", once.replace("{0}", text))


@query("j17_pronunciation", "SELECT conv_id, turn, md5(" + whole_words(whole_words("text", "the", "thee"), "of", "o$f") + ") AS digest FROM {conversations}")
def j17_pronunciation(spark, d):
    rows = view(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.md5(tx.rewrite_words("text", [("the", "thee"), ("of", "o$f")]).cast("binary")).alias("digest"))


@query("j21_summary", "SELECT doc_id, md5(CASE WHEN contains(t, '.') THEN concat(regexp_extract(t, '(?s)^(.*)\\.', 1), '.') ELSE concat(t, '.') END) AS digest FROM (SELECT doc_id, substr(text, 1, 500) AS t FROM {documents})")
def j21_summary(spark, d):
    return view(spark, d, "documents").select("doc_id", F.md5(tx.to_last_stop("text").cast("binary")).alias("digest"))


@query("j22_j25_escapes", "SELECT doc_id, md5(concat(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;'), replace(replace(t, '\\', '/'), '''', '''\\'''''))) AS digest FROM (SELECT doc_id, concat('a&<b>\"''\\', text) AS t FROM {documents})")
def j22_j25_escapes(spark, d):
    t = F.concat(F.lit("a&<b>\"'\\"), F.col("text"))
    return view(spark, d, "documents").select("doc_id", F.md5(F.concat(tx.escape_html(t), tx.escape_concat_path(t)).cast("binary")).alias("digest"))


@query("f10_total_chars", "SELECT source, CAST(sum(length(text)) AS BIGINT) AS total_chars, max(length(text)) AS longest, sum(CASE WHEN length(text) / 1024.0 > 80 THEN 1 ELSE 0 END)::bigint AS over_80_kb FROM {documents} GROUP BY 1")
def f10_total_chars(spark, d):
    n = F.length("text")
    return view(spark, d, "documents").groupBy("source").agg(F.sum(n).alias("total_chars"), F.max(n).cast("long").alias("longest"), F.sum(F.when(n / 1024 > 80, 1).otherwise(0)).alias("over_80_kb"))


_BROKEN = [
    "concat('<think>{{x}}', chr(10), '</think>{{\"a\": ', item_id, '}}')",
    "concat('Sure: {{\"a\": ', item_id, ', \"b\": {{}}}} done')",
    "'no object'",
    "concat('{{\"b\": [1, 2, {{\"c\": 3}}], \"a\": ', item_id)",
    "concat('```json', chr(10), '{{\"b\": [1, 2,], \"a\": ', item_id, ',}}', chr(10), '```')",
    "concat('{{a: ', item_id, ', b: it is, c: True}}')",
    "concat('{{\"b\": \"say \"hi\" to him\" \"a\": ', item_id, ' // end', chr(10), '}} and more')",
    "concat('{{ok: None, ''a'': ', item_id, ', \"b\": ]}}')",
]
ANSWERS = "SELECT item_id, CASE " + " ".join(f"WHEN item_id % {len(_BROKEN)} = {i} THEN {t}" for i, t in enumerate(_BROKEN)) + " END AS t FROM {benchmark}"


@query("j18_json_answers", "SELECT item_id, CASE WHEN item_id % 8 NOT IN (2, 3) THEN CAST(item_id AS VARCHAR) END AS a, CASE item_id % 8 WHEN 3 THEN '3' WHEN 5 THEN 'true' END AS c, CASE item_id % 8 WHEN 5 THEN 'it is' WHEN 6 THEN 'say \"hi\" to him' WHEN 7 THEN '' END AS b FROM {benchmark}")
def j18_json_answers(spark, d):
    """Answers whole and broken, with a number under ``a``; what comes after the last brace is no part of an object."""
    rows = sql(spark, d, ANSWERS.replace("chr(10)", "char(10)")).withColumn("j", tx.json_object("t"))
    own = lambda k: F.get_json_object("j", k)
    b = F.when(F.col("item_id") % 8 >= 5, own("$.b"))
    return rows.select("item_id", own("$.a").alias("a"), F.coalesce(own("$.b[2].c"), own("$.c")).alias("c"), b.alias("b"))
