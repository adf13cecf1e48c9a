"""Queries of the quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio as au
from ..functions import text as tx
from ..operators import quality as ql
from ..operators import timeline as tl
from ..runtime import totals_before
from .registry import query
from .views import query as sql
from .views import view

F2 = """SELECT project_id, chapter_number, count(*) AS total_segments, CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS passed,
CAST(sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN status = 'flagged' THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
round(coalesce(avg(wer), 0), 9) AS average_wer, coalesce(max(wer), 0) AS worst_wer, round(coalesce(avg(quality_score), 0), 9) AS average_quality_score,
CAST(sum(CASE WHEN attempt > 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_retries
FROM {quality_logs} q WHERE attempt = (SELECT max(attempt) FROM {quality_logs} r WHERE r.project_id = q.project_id AND r.line_id = q.line_id) GROUP BY project_id, chapter_number"""
LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, line_id ORDER BY attempt DESC, id) AS n FROM {quality_logs}) WHERE n = 1)"


@query("f2_chapter_quality", F2)
def f2_chapter_quality(spark, d):
    return ql.chapter_summary(view(spark, d, "quality_logs"))


@query("e8_latest_attempt_subquery", F2)
def e8_latest_attempt_subquery(spark, d):
    return sql(spark, d, F2)


@query("g3_latest_attempts", f"WITH {LAST} SELECT project_id, line_id, attempt, status, wer FROM last")
def g3_latest_attempts(spark, d):
    return ql.latest_attempts(view(spark, d, "quality_logs")).select("project_id", "line_id", "attempt", "status", "wer")


F3 = f"""WITH {LAST}, r AS (SELECT project_id, CAST(sum(CASE WHEN attempt > 1 THEN 1 ELSE 0 END) AS BIGINT) AS retries_triggered FROM {{quality_logs}} GROUP BY 1)
SELECT l.project_id, count(*) AS total_segments, CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS passed_segments, round(avg(coalesce(wer, 0)), 9) AS average_wer,
CAST(sum(CASE WHEN json_extract_string(details, '$.silence_issues') = 'true' THEN 1 ELSE 0 END) AS BIGINT) AS failed_silence,
CAST(sum(CASE WHEN json_extract_string(details, '$.clipping_issues') = 'true' THEN 1 ELSE 0 END) AS BIGINT) AS failed_clipping, any_value(retries_triggered) AS retries_triggered
FROM last l JOIN r ON r.project_id = l.project_id GROUP BY l.project_id"""


@query("f3_project_quality", F3)
def f3_project_quality(spark, d):
    return ql.project_summary(view(spark, d, "quality_logs"))


@query(
    "f4_chapter_report",
    f"""WITH {LAST}, req AS (SELECT DISTINCT project_id, line_id, chapter_number FROM {{quality_logs}}),
first AS (SELECT DISTINCT project_id, line_id, 1 AS was FROM {{quality_logs}} WHERE attempt = 1 AND status = 'flagged')
SELECT req.project_id, req.chapter_number, count(*) AS total_segments, CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
count(was) AS flagged, round(coalesce(avg(CASE WHEN wer >= 0 THEN wer END), 0), 9) AS average_wer, coalesce(max(wer), 0) AS worst_wer, coalesce(string_agg(CASE WHEN was = 1 THEN req.line_id END, ',' ORDER BY req.line_id), '') AS flagged_lines
FROM req LEFT JOIN last USING (project_id, line_id) LEFT JOIN first USING (project_id, line_id) GROUP BY req.project_id, req.chapter_number""",
)
def f4_chapter_report(spark, d):
    logs = view(spark, d, "quality_logs")
    return ql.chapter_report(logs.select("project_id", "line_id", "chapter_number").distinct(), logs)


@query("f5_run_counters", "SELECT chapter_number, count(*) AS generated, CAST(sum(CASE WHEN attempt > 1 THEN 1 ELSE 0 END) AS BIGINT) AS retried, round(sum(quality_score), 6) AS seconds FROM {quality_logs} GROUP BY 1")
def f5_run_counters(spark, d):
    rows = view(spark, d, "quality_logs")
    return rows.groupBy("chapter_number").agg(F.count(F.lit(1)).alias("generated"), F.sum(F.when(F.col("attempt") > 1, 1).otherwise(0)).alias("retried"), F.round(F.sum("quality_score"), 6).alias("seconds"))


@query(
    "f12_traffic_lights",
    f"""WITH f AS ({F3.replace('WITH ', 'WITH ', 1)}), p AS (SELECT project_id, average_wer, CAST(round(passed_segments / total_segments * 100) AS BIGINT) AS pass_rate FROM f)
SELECT project_id, pass_rate, CASE WHEN pass_rate > 95 THEN 'good' WHEN pass_rate > 85 THEN 'warn' ELSE 'bad' END AS rate_light, CASE WHEN average_wer < 0.02 THEN 'good' WHEN average_wer < 0.05 THEN 'warn' ELSE 'bad' END AS wer_light FROM p""",
)
def f12_traffic_lights(spark, d):
    return ql.traffic_lights(ql.project_summary(view(spark, d, "quality_logs")))


@query(
    "doc_p1_book_report",
    f"""WITH {LAST}, l AS (SELECT * FROM last WHERE wer IS NOT NULL), t AS (SELECT project_id, string_agg(line_id, ',' ORDER BY k) AS worst_lines FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY wer DESC, line_id) AS k FROM l) WHERE k <= 3 GROUP BY 1)
SELECT l.project_id, round(avg(wer), 9) AS average_wer, round(median(wer), 9) AS median_wer, max(wer) AS worst_wer, any_value(worst_lines) AS worst_lines FROM l JOIN t ON t.project_id = l.project_id GROUP BY 1""",
)
def doc_p1_book_report(spark, d):
    return ql.book_report(view(spark, d, "quality_logs"))


@query("doc_p2_best_attempt", "SELECT project_id, line_id, arg_min(attempt, {{'w': wer, 'a': attempt}}) AS attempt, min(wer) AS wer FROM {quality_logs} WHERE wer IS NOT NULL GROUP BY 1, 2")
def doc_p2_best_attempt(spark, d):
    return ql.best_attempts(view(spark, d, "quality_logs"))


@query(
    "doc_p1_character_quality",
    "SELECT book_id, speaker, count(*) AS n_lines, round(avg(wer), 9) AS average_wer, max(wer) AS worst_wer FROM {script_lines} JOIN (SELECT concat('c', attempt, '_', chapter_number % 4) AS line_id, avg(wer) AS wer FROM {quality_logs} GROUP BY 1) r USING (line_id) GROUP BY 1, 2",
)
def doc_p1_character_quality(spark, d):
    results = view(spark, d, "quality_logs").groupBy(F.concat(F.lit("c"), "attempt", F.lit("_"), F.col("chapter_number") % 4).alias("line_id")).agg(F.avg("wer").alias("wer"))
    return ql.character_quality(view(spark, d, "script_lines"), results)


@query(
    "doc_p5_bands",
    "SELECT id, CASE WHEN quality_score IS NULL THEN NULL WHEN quality_score < 0.5 THEN 'poor' WHEN quality_score < 0.7 THEN 'fair' WHEN quality_score < 0.85 THEN 'good' WHEN quality_score < 0.95 THEN 'very good' ELSE 'excellent' END AS band FROM {quality_logs}",
)
def doc_p5_bands(spark, d):
    return view(spark, d, "quality_logs").select("id", ql.bands("quality_score", [(0.5, "poor"), (0.7, "fair"), (0.85, "good"), (0.95, "very good")], "excellent").alias("band"))


@query(
    "j11_score_status",
    """WITH s AS (SELECT id, least(coalesce(wer, 1), 1) / 4 AS wer, CASE WHEN id % 4 = 0 THEN 0.3 ELSE 1.0 END AS art, CASE WHEN id % 3 = 0 THEN 0.0 ELSE 0.9 END AS dur FROM {quality_logs}),
t AS (SELECT *, (1 - wer) * 0.6::double + art::double * 0.3::double + dur::double * 0.1::double AS score FROM s)
SELECT id, round(score, 9) AS score, CASE WHEN wer > 0.05 THEN 'fail' WHEN score < 0.7::double THEN 'flagged' ELSE 'pass' END AS status FROM t""",
)
def j11_score_status(spark, d):
    rows = view(spark, d, "quality_logs").select("id", (F.least(F.coalesce("wer", F.lit(1.0)), F.lit(1.0)) / 4).alias("wer"), F.when(F.col("id") % 4 == 0, 0.3).otherwise(1.0).alias("art"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(0.9).alias("dur"))
    rows = rows.withColumn("score", au.quality_score(F.col("wer"), F.col("art"), F.col("dur")))
    return rows.select("id", F.round("score", 9).alias("score"), au.status(F.col("wer"), F.col("score")).alias("status"))


@query("h3_quality_log_order", "SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY chapter_number, line_id, attempt, id) AS place FROM {quality_logs}")
def h3_quality_log_order(spark, d):
    """The order by chapter, line and attempt, as a place that comparison can see."""
    rows = view(spark, d, "quality_logs").select("project_id", "chapter_number", "line_id", "attempt", "id", F.lit(1).alias("_one"))
    rows = totals_before(rows, "project_id", ["chapter_number", "line_id", "attempt", "id"], {"_before": "_one"})
    return rows.select("project_id", "id", (F.col("_before") + 1).alias("place"))


@query("g8_chapter_markers", "SELECT book_id, number, CAST(sum(ms) OVER w - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms FROM (SELECT book_id, number, CAST(floor(seconds * 1000) AS BIGINT) AS ms FROM {chapter_durations}) WINDOW w AS (PARTITION BY book_id ORDER BY number)")
def g8_chapter_markers(spark, d):
    return tl.chapter_markers(view(spark, d, "chapter_durations"))


@query(
    "f11_book_length",
    "SELECT book_id, round(sum(seconds), 6) AS seconds, concat(CAST(floor(sum(seconds)) AS BIGINT) // 3600, ':', lpad(CAST(CAST(floor(sum(seconds)) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(CAST(floor(sum(seconds)) AS BIGINT) % 60 AS VARCHAR), 2, '0')) AS duration FROM {chapter_durations} GROUP BY 1",
)
def f11_book_length(spark, d):
    return tl.book_length(view(spark, d, "chapter_durations"))


@query("e9_chapters_durations", "SELECT book_id, number, concat('Title ', number) AS title, round(seconds, 6) AS seconds FROM {chapter_durations}")
def e9_chapters_durations(spark, d):
    rows = view(spark, d, "chapter_durations")
    titles = rows.select("book_id", "number", F.concat(F.lit("Title "), "number").alias("title"))
    return titles.join(rows, ["book_id", "number"]).select("book_id", "number", "title", F.round("seconds", 6).alias("seconds"))


@query("f14_max_chapter", "SELECT book_id, max(number) AS last_chapter FROM {chapter_durations} GROUP BY 1")
def f14_max_chapter(spark, d):
    return view(spark, d, "chapter_durations").groupBy("book_id").agg(F.max("number").alias("last_chapter"))


SEGMENTS = "SELECT chapter_number, line_ord, CAST(length(text) AS INT) * 60 AS audio_ms, pause_before_ms, pause_after_ms FROM {script_lines}"


@query(
    "g9_segment_timeline",
    f"""WITH s AS ({SEGMENTS}), p AS (SELECT *, lag(pause_after_ms) OVER w AS pa, lag(audio_ms) OVER w AS la FROM s WINDOW w AS (PARTITION BY chapter_number ORDER BY line_ord)),
f AS (SELECT *, least(30, audio_ms, coalesce(CASE WHEN pause_before_ms > 0 THEN pause_before_ms END, CASE WHEN pa > 0 THEN pa END, la, 1000)) AS fade FROM p),
e AS (SELECT *, 1000 + sum(pause_before_ms + audio_ms - fade + pause_after_ms) OVER (PARTITION BY chapter_number ORDER BY line_ord) - pause_after_ms AS e FROM f)
SELECT chapter_number, line_ord, CAST(e - audio_ms + fade AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms FROM e""",
)
def g9_segment_timeline(spark, d):
    return tl.segment_timeline(sql(spark, d, SEGMENTS), ["chapter_number"])


@query("doc_p10_estimates", "SELECT book_id, total_words, round(total_words / 150.0 / 60, 6) AS estimated_audio_hours FROM (SELECT source AS book_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS total_words FROM {documents} GROUP BY 1)")
def doc_p10_estimates(spark, d):
    words = view(spark, d, "documents").groupBy(F.col("source").alias("book_id")).agg(F.sum(tx.word_count("text")).alias("total_words"))
    return tl.estimates(words)


@query(
    "m8_retry_rounds",
    """WITH a AS (SELECT concat(project_id, line_id) AS line_id, attempt, status FROM {quality_logs}), f AS (SELECT line_id, min(attempt) AS ok FROM a WHERE status <> 'fail' GROUP BY 1)
SELECT a.line_id, a.attempt, a.status FROM a LEFT JOIN f ON f.line_id = a.line_id WHERE a.attempt <= 3 AND a.attempt <= coalesce(f.ok, 3)""",
)
def m8_retry_rounds(spark, d):
    attempts = view(spark, d, "quality_logs").select(F.concat("project_id", "line_id").alias("line_id"), "attempt", "status")
    return ql.retry_rounds(attempts, attempts)


@query(
    "a14_export_lists",
    """WITH m AS (SELECT book_id, number, ms, CAST(sum(ms) OVER (PARTITION BY book_id ORDER BY number) AS BIGINT) AS e FROM (SELECT book_id, number, CAST(CASE WHEN number % 9 = 0 THEN 0 ELSE floor(seconds * 1000) END AS BIGINT) AS ms FROM {chapter_durations}))
SELECT book_id, md5(string_agg(concat('file ''/a/it''\\''''s ', number, '.wav'''), chr(10) ORDER BY number)) AS files,
md5(concat(';FFMETADATA1', chr(10), chr(10), string_agg(concat('[CHAPTER]', chr(10), 'TIMEBASE=1/1000', chr(10), 'START=', e - ms, chr(10), 'END=', e, chr(10), 'title=T', number, chr(10)), chr(10) ORDER BY number))) AS metadata FROM m GROUP BY book_id""",
)
def a14_export_lists(spark, d):
    rows = view(spark, d, "chapter_durations")
    chapters = rows.select("book_id", "number", F.concat(F.lit("T"), "number").alias("title"), F.concat(F.lit("\\a\\it's "), "number", F.lit(".wav")).alias("path"))
    out = tl.export_lists(chapters, rows.where("number % 9 <> 0"))
    return out.select("book_id", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("files", "metadata")])


@query(
    "a14_export_results",
    """WITH l AS (SELECT book_id, count(*) AS total_chapters, CAST(floor(sum(CASE WHEN number % 9 = 0 THEN 0 ELSE seconds END)) AS BIGINT) AS s FROM {chapter_durations} GROUP BY 1),
f AS (SELECT concat('book', l_orderkey % 3) AS book_id, CAST(sum(l_orderkey) AS DOUBLE) / 1048576 AS mb FROM {lineitem} GROUP BY 1)
SELECT l.book_id, total_chapters, concat(s // 3600, ':', lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(s % 60 AS VARCHAR), 2, '0')) AS total_duration, round(coalesce(mb, 0), 6) AS file_size_mb FROM l LEFT JOIN f ON f.book_id = l.book_id""",
)
def a14_export_results(spark, d):
    """Every ninth chapter has no length, and one book in four no files."""
    rows = view(spark, d, "chapter_durations").select("book_id", "number", F.when(F.col("number") % 9 != 0, F.col("seconds")).alias("seconds"))
    files = view(spark, d, "lineitem").select(F.concat(F.lit("book"), F.col("l_orderkey") % 3).alias("book_id"), F.col("l_orderkey").alias("bytes"))
    return tl.export_results(rows, files).withColumn("file_size_mb", F.round("file_size_mb", 6))


@query(
    "doc_p1_generation_ratio",
    """WITH s AS (SELECT concat('book', user_id % 6) AS book_id, sum(value)::double AS g FROM {events} WHERE value IS NOT NULL GROUP BY 1), a AS (SELECT book_id, sum(seconds) AS t FROM {chapter_durations} GROUP BY 1)
SELECT coalesce(s.book_id, a.book_id) AS book_id, round(g, 4) AS generation_seconds, round(t, 4) AS audio_seconds, round(CASE WHEN t > 0 THEN coalesce(g, 0) / t END, 9) AS ratio FROM s FULL JOIN a ON s.book_id = a.book_id""",
)
def doc_p1_generation_ratio(spark, d):
    spent = view(spark, d, "events").select(F.concat(F.lit("book"), F.col("user_id") % 6).alias("book_id"), F.col("value").alias("seconds"))
    out = ql.generation_ratio(spent, view(spark, d, "chapter_durations"), ["book_id"])
    return out.select("book_id", F.round("generation_seconds", 4).alias("generation_seconds"), F.round("audio_seconds", 4).alias("audio_seconds"), F.round("ratio", 9).alias("ratio"))


@query(
    "doc_p10_remaining",
    """SELECT project_id, CASE WHEN d > 0 THEN round(greatest(0, c_custkey * 10.0 / d * (t - d)), 6) END::double AS eta_seconds FROM (SELECT project_id, c_custkey, CAST(json_extract_string(state, '$.total_chapters') AS DOUBLE) AS t, CAST(json_extract_string(state, '$.chapters_generated') AS DOUBLE) AS d FROM {jobs})""",
)
def doc_p10_remaining(spark, d):
    part = lambda k: F.get_json_object("state", f"$.{k}").cast("double")
    eta = tl.remaining_seconds(F.col("c_custkey") * 10.0, part("chapters_generated"), part("total_chapters"))
    return view(spark, d, "jobs").select("project_id", F.round(eta, 6).alias("eta_seconds"))


@query("doc_p5_noise_bands", "SELECT id, CASE WHEN v IS NULL THEN NULL WHEN v < -60 THEN 'excellent' WHEN v < -50 THEN 'good' WHEN v < -40 THEN 'acceptable' ELSE 'poor' END AS band FROM (SELECT id, wer * -90 AS v FROM {quality_logs})")
def doc_p5_noise_bands(spark, d):
    """Noise floors in decibel, here made from the rates."""
    return view(spark, d, "quality_logs").select("id", ql.bands(F.col("wer") * -90, ql.NOISE_BANDS, "poor").alias("band"))
