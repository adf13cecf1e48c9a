"""Views that give the driver's tables the shapes of the data model, in SQL that both engines read alike.

``{name}`` stands for a table or another view; the same text makes the Spark view and the oracle's CTE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # documents with what real books hold: curly quotes, page numbers, running titles, dashes, blanks
    "dirty": """SELECT doc_id, source, lang, CASE
        WHEN doc_id % 4 = 1 THEN concat('“', substr(text, 1, 40), '” «q»', '\n12\n', 'RUNNING TITLE\n', '  ', substr(text, 41))
        WHEN doc_id % 4 = 2 THEN concat(replace(text, ' the ', ' –the-- '), '\n\n\n\n', 'ﬁn \u00a0 x\u200b --- y’s', '\n* * *\nend')
        WHEN doc_id % 4 = 3 THEN concat('"KEEP THIS"\n', replace(text, '. ', '.\r\n'), ' z')
        ELSE text END AS text FROM {documents}""",
    "raw_chapters": """SELECT source AS book_id, doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Title ', doc_id) END AS title, text FROM {dirty}""",
    "script_lines": """SELECT concat('b', conv_id % 7) AS book_id, conv_id AS chapter_number, turn AS line_ord, concat('c', conv_id, '_', turn) AS line_id, role AS speaker, text,
        CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (turn % 5) AS speed, CAST(turn % 3 * 100 AS INT) AS pause_before_ms, CAST(CASE WHEN turn % 4 = 0 THEN 0 ELSE 300 + turn END AS INT) AS pause_after_ms FROM {conversations}""",
    "quality_logs": """SELECT event_id AS id, concat('p', user_id % 5) AS project_id, concat('u', user_id, '_', day(ts)) AS line_id, CAST(day(ts) AS INT) AS chapter_number,
        CAST(row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS INT) AS attempt,
        CASE WHEN event_type = 'error' THEN NULL ELSE least(value / 500, CAST(1 AS DOUBLE)) END AS wer, CAST(1 AS DOUBLE) - least(value / 500, CAST(1 AS DOUBLE)) AS quality_score,
        CASE WHEN value > 60 THEN 'fail' WHEN value > 30 THEN 'flagged' ELSE 'pass' END AS status,
        CASE WHEN event_id % 3 = 0 THEN '{{"silence_issues": true}}' WHEN event_id % 7 = 0 THEN '{{"clipping_issues": true, "silence_issues": false}}' ELSE props END AS details, ts AS created_at FROM {events}""",
    "segments": """SELECT vec_id, concat('p', label) AS project_id, embedding AS pcm, 160 AS sample_rate, vec_id % 40 AS item FROM {embeddings}""",
    "ref_hyp": """SELECT conv_id, turn, text AS ref, CASE WHEN turn % 3 = 0 THEN replace(text, ' de ', ' of the ') WHEN turn % 3 = 1 THEN replace(replace(text, ' the ', ' '), '.', ' x') ELSE concat('y ', text) END AS hyp FROM {conversations}""",
    "registry_raw": """SELECT source AS book_id, CAST(doc_id AS INT) AS chapter, CASE WHEN doc_id % 5 = 0 THEN 'Old-Man Tom' WHEN doc_id % 5 = 1 THEN 'old_man tom' WHEN doc_id % 5 = 2 THEN concat('Voice ', doc_id % 37) WHEN doc_id % 5 = 3 THEN 'narrator' ELSE concat('V-', lang) END AS raw_id,
        substr(text, 1, CAST(doc_id % 90 AS INT)) AS voice_description, CASE WHEN doc_id % 4 = 0 THEN 'MALE' WHEN doc_id % 4 = 1 THEN 'female' WHEN doc_id % 4 = 2 THEN 'robot' ELSE NULL END AS gender, CASE WHEN doc_id % 6 = 0 THEN '' ELSE lang END AS tone FROM {documents}""",
    "chapter_durations": """SELECT concat('book', l_orderkey % 4) AS book_id, CAST(l_orderkey % 50 AS INT) AS number, CAST(sum(l_quantity) AS DOUBLE) / 64 AS seconds FROM {lineitem} GROUP BY concat('book', l_orderkey % 4), CAST(l_orderkey % 50 AS INT)""",
    "jobs": """SELECT concat('job', c_custkey) AS project_id, c_custkey, concat('{{"status": "', CASE WHEN c_custkey % 5 = 0 THEN 'paused' WHEN c_custkey % 5 = 1 THEN 'error' WHEN c_custkey % 5 = 2 THEN 'complete' WHEN c_custkey % 5 = 3 THEN 'generating' ELSE 'created' END,
        '", "total_chapters": ', c_custkey % 9 + 1, ', "chapters_generated": ', c_custkey % 4, '}}') AS state, date_add(DATE '2024-01-01', INTERVAL (c_custkey % 300) DAY) AS created_at, date_add(DATE '2024-02-01', INTERVAL (c_custkey * 7 % 300) DAY) AS updated_at FROM {customer}""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")
#: Where the engines spell things differently: Spark's text for the oracle's.
_SPARK = [(re.compile(r"date_add\((DATE '[^']+'), INTERVAL \(([^)]+)\) DAY\)"), r"date_add(\1, CAST(\2 AS INT))")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    for pattern, put in _SPARK:
        text = pattern.sub(put, text)
    return query(spark, sf_dir, text)


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over ``{names}``."""
    names = sorted(set(_NAME.findall(text)))
    text = text.replace("\\", "\\\\").replace("\n", "\\n") if "'" in text and "\n" in text.split("'", 1)[1] else text
    return spark.sql(_in_strings(text), **{n: view(spark, sf_dir, n) for n in names})


def _in_strings(text: str) -> str:
    """Newlines that were escaped outside of string literals are blanks."""
    return re.sub(r"('(?:[^']|'')*')|\\n", lambda m: m[1] or " ", text)


def oracle(text: str) -> str:
    """The oracle's text: views as CTEs, each once, in order of need."""
    need: list[str] = []

    def visit(t: str) -> None:
        for n in _NAME.findall(t):
            if n in VIEWS and n not in need:
                visit(VIEWS[n])
                need.append(n)

    visit(text)
    plain = lambda t: _NAME.sub(r"\1", t).replace("{{", "{").replace("}}", "}")
    ctes = [f"{n} AS ({plain(VIEWS[n])})" for n in need]
    body = plain(text).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    return "WITH " + ",\n".join(ctes) + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
