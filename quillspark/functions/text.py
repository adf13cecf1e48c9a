"""Text as Column expressions: cleaning rules, counting, normalising and splitting.

Patterns follow Python's reading of ``\\s``, ``\\w`` and ``$`` (``(?U)`` for Unicode classes, ``(?d)`` for Unix lines).
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .json_repair import repair

# What each character becomes.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
SPACES = {"\u00a0": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "", "\u2028": "\n", "\u2029": "\n\n"}
QUOTES = {**dict.fromkeys("\u201c\u201d\u201e\u201f\u00ab\u00bb", '"'), **dict.fromkeys("\u2018\u2019\u201a\u201b", "'")}
DASHES = "\u2013\u2012\u2015"
EM_DASH = "\u2014"
UNITS = ["Bytes", "KB", "MB", "GB", "TB"]

BLANK = r"(?U)\s+"


def c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def replaced(text: Column, table: dict[str, str]) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), table.items(), text)


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode NFC, for which Spark has no function.

    Few texts at a time are Python strings, and a batch without changes is given back, so that memory is that of Arrow.
    """

    def normal(part: pa.Array) -> pa.Array:
        given = part.to_pylist()
        out = [None if s is None else unicodedata.normalize("NFC", s) for s in given]
        return part if out == given else pa.array(out, part.type)

    given = [text.slice(i, 64) for i in range(0, len(text), 64)]
    out = [normal(part) for part in given]
    return text if all(a is b for a, b in zip(given, out)) else pa.concat_arrays(out)


nfc = nfc.asNondeterministic()  # else a filter on what comes of it runs it a second time, in a worker of its own


def composed(text: Column | str) -> Column:
    """NFC; only texts with characters beyond ASCII go through Python, others are not even sent there."""
    t = c(text)
    plain = F.octet_length(t) == F.length(t)
    return F.when(plain, t).otherwise(nfc(F.when(~plain, t)))


def ligatures(text: Column | str) -> Column:
    return replaced(c(text), LIGATURES)


def plain_spaces(text: Column | str) -> Column:
    return replaced(c(text), SPACES)


def plain_quotes(text: Column | str) -> Column:
    return F.translate(c(text), "".join(QUOTES), "".join(QUOTES.values()))


def em_dashes(text: Column | str) -> Column:
    """Other dashes and runs of hyphens as em dashes: ``---`` and longer become one, ``--`` becomes one."""
    t = F.replace(c(text), F.lit("\u2013"), F.lit(EM_DASH))
    t = F.regexp_replace(F.regexp_replace(t, "---+", EM_DASH), "--", EM_DASH)
    return F.translate(t, DASHES[1:], EM_DASH * 2)


def without_page_numbers(text: Column | str) -> Column:
    return F.regexp_replace(c(text), r"(?Udm)^\s*\d{1,4}\s*$", "")


def strip(text: Column | str) -> Column:
    """Without blanks at both ends; the pattern reads only texts that begin or end with one."""
    t = c(text)
    ends = F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return F.when(F.regexp_like(ends, F.lit(r"(?U)\s")), F.regexp_replace(t, r"(?U)^\s+|\s+\z", "")).otherwise(t)


def word_list(text: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(c(text), F.lit("")), BLANK), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(word_list(text))


def without_headers(text: Column | str) -> Column:
    """Drop short lines in capitals (or without letters) of at most five words that don't open with a quote.

    Nearly all lines have a small letter, which is tested first; blanks have no case, so they needn't be stripped for it.
    """

    def stays(line: Column) -> Column:
        s = strip(line)
        return F.regexp_like(line, F.lit("[a-z]")) | (line != F.upper(line)) | (s == "") | (F.length(s) >= 60) | F.startswith(s, F.lit('"')) | (F.size(F.split(s, BLANK)) > 5)

    return F.array_join(F.filter(F.split(c(text), "\n", -1), stays), "\n")


def tidy_blanks(text: Column | str) -> Column:
    """One kind of line break, lines without blanks at their ends, single blanks, at most one empty line in a row.

    A pass is made only over texts that hold what it looks for.
    """
    t = F.replace(F.replace(c(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    ends = lambda x: F.concat(F.lit("\n"), F.substring(x, 1, 1), F.lit("."), F.substring(x, -1, 1), F.lit("\n"))
    has = lambda x, *parts: reduce(lambda a, b: a | b, (F.contains(x, F.lit(p)) for p in parts))
    beside = "\n ", "\n\t", " \n", "\t\n"
    trimmed = lambda x: F.when(has(x, *beside) | has(ends(x), *beside), F.regexp_replace(x, r"(?dm)^[ \t]+|[ \t]+$", "")).otherwise(x)
    single = lambda x: F.when(has(x, "  ", "\t\t", " \t", "\t "), F.regexp_replace(x, r"[ \t]{2,}", " ")).otherwise(x)
    short = lambda x: F.when(has(x, "\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x)
    return _let(_let(_let(t, trimmed), single), short)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is found once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cleaned(text: Column | str, normalize: bool = True) -> Column:
    """The whole cleaning chain in its fixed order; null and blank texts become empty."""
    t = F.coalesce(c(text), F.lit(""))
    t = composed(t) if normalize else t
    t = em_dashes(plain_quotes(plain_spaces(ligatures(t))))
    return _let(tidy_blanks(without_headers(without_page_numbers(t))), strip)


def normalized_for_wer(text: Column | str) -> Column:
    t = F.regexp_replace(F.lower(c(text)), r"(?U)[^\w\s']", " ")
    return strip(F.regexp_replace(t, BLANK, " "))


def word_distance(a: list, b: list) -> int:
    """Edit distance of two lists, a column of the table held in the bits of two numbers."""
    if not len(a):
        return len(b)
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, distance = every, 0, len(a)  # where the column goes up or down by one
    for w in b:
        match = places.get(w, 0)
        across = (((match & rises) + rises) ^ rises) | match
        more, less = falls | (every & ~(across | rises)), rises & across
        distance += bool(more & top) - bool(less & top)
        more, less, match = (more << 1 | 1) & every, less << 1 & every, match | falls
        rises, falls = less | (every & ~(match | more)), more & match
    return distance


@F.pandas_udf(LongType())
def word_distances(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else word_distance(a, b) for a, b in zip(reference, hypothesis)], dtype="Int64")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance over reference words, at most 1; an empty reference gives 1.

    ``reference`` and ``hypothesis`` are arrays of words, of any number and vocabulary.
    """
    rate = word_distances(reference, hypothesis) / F.size(reference)
    return F.when(F.size(reference) == 0, 1.0).otherwise(F.least(F.lit(1.0), rate))


def fragments(text: Column | str) -> Column:
    """Sentences and quoted spans in order: paragraphs by newline, quotes whole, the rest cut after ``.!?``.

    A quote may hold any character but a newline, carriage returns and other line separators included.
    """
    mark = '["\u201c\u201d]'
    parts = lambda p: F.regexp_extract_all(p, F.lit(f"(?s){mark}.*?{mark}|(?:(?!{mark}.*?{mark}).)+"), F.lit(0))
    sentence = r"(?s).*?(?:[.!?]+(?=(?U:\s)|\z)|\z)"

    def cut(part: Column) -> Column:
        s = strip(part)
        return F.when(F.regexp_like(s, F.lit(f"(?s)^{mark}.*{mark}$")), F.array(s)).otherwise(F.transform(F.regexp_extract_all(part, F.lit(sentence), F.lit(0)), strip))

    paragraphs = F.filter(F.transform(F.split(c(text), "\n"), strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.flatten(F.transform(parts(p), cut))))
    return F.filter(pieces, lambda s: s != "")


def slug(title: Column | str) -> Column:
    t = F.regexp_replace(strip(F.lower(c(title))), r"(?U)[^\w\s-]", "")
    return F.substring(F.regexp_replace(t, r"(?U)[-\s]+", "-"), 1, 64)


def speaker_id(name: Column | str, hyphens: bool = False) -> Column:
    return F.translate(F.lower(c(name)), " -" if hyphens else " ", "__" if hyphens else "_")


def display_name(ident: Column | str) -> Column:
    """An identifier as a name: each run of letters with a capital initial, also after an apostrophe or digit."""
    runs = F.regexp_extract_all(F.replace(c(ident), F.lit("_"), F.lit(" ")), F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def to_last_stop(text: Column | str, chars: int = 500) -> Column:
    """The first ``chars`` characters up to the last full stop, with a full stop."""
    t = F.substring(c(text), 1, chars)
    return F.concat(F.when(F.contains(t, F.lit(".")), F.regexp_extract(t, r"(?s)^(.*)\.", 1)).otherwise(t), F.lit("."))


def json_object(text: Column | str) -> Column:
    """The JSON object in a model's answer, without thinking: the answer or what is from the first brace to the last.

    What is no valid JSON by the letter is repaired; null if there is no object.
    """
    t = strip(F.regexp_replace(c(text), r"(?s)<think>.*?</think>", ""))
    whole = F.when(F.regexp_like(t, F.lit(r"(?s)^\{.*\}$")), t).otherwise(F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")), t))
    return repair(whole)  # Spark's own parser takes what is no JSON, such as more closing brackets than open ones


def rewrite_words(text: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Replace whole words in the order of ``rules``, whatever their case; both sides are taken literally."""
    quoted = lambda s: "".join("\\" + x if not x.isalnum() and x not in " _" else x for x in s)
    literal = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return reduce(lambda t, r: F.regexp_replace(t, rf"(?iU)\b{quoted(r[0])}\b", literal(r[1])), rules, c(text))


def escape_html(text: Column | str) -> Column:
    """Text for HTML; null becomes empty."""
    return replaced(F.coalesce(c(text), F.lit("")), {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#039;"})


def escape_concat_path(path: Column | str) -> Column:
    return F.replace(F.replace(c(path), F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("'\\''"))


def human_bytes(n: Column | str) -> Column:
    """A size with up to two decimals in the largest unit that it reaches; nothing and null are ``0 Bytes``."""
    n = c(n).cast("double")
    digits = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.00$|(?<=\.\d)0$", "")
    out = F.concat(digits(n / 1024.0 ** (len(UNITS) - 1)), F.lit(f" {UNITS[-1]}"))
    for power in range(len(UNITS) - 2, -1, -1):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(digits(n / 1024.0**power), F.lit(f" {UNITS[power]}"))).otherwise(out)
    return F.when(F.coalesce(n, F.lit(0.0)) == 0, f"0 {UNITS[0]}").otherwise(out)


def hms(seconds: Column | str) -> Column:
    s = F.floor(c(seconds)).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
