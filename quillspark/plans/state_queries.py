"""Queries of job state, schedules, selections and progress."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import state as stt
from ..runtime import gapless_rank, shared_dir
from ..streaming.sinks import OnceTable
from ..streaming.stateful import last_lines
from .registry import query
from .views import query as sql
from .views import view

STATUS = "json_extract_string(state, '$.status')"


def jobs(spark, d):
    rows = view(spark, d, "jobs")
    part = lambda k: F.get_json_object("state", f"$.{k}")
    return rows.withColumns({"status": part("status"), "total": part("total_chapters").cast("int"), "done": part("chapters_generated").cast("int")})


@query("a9_upsert_jobs", "SELECT project_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE md5(state) END AS digest FROM {jobs} UNION ALL SELECT concat('extra', c_custkey), 'new' FROM {jobs} WHERE c_custkey % 3 = 0")
def a9_upsert_jobs(spark, d):
    old = view(spark, d, "jobs").select("project_id", "c_custkey", F.md5(F.col("state").cast("binary")).alias("digest"))
    hit = old.where("c_custkey % 3 = 0")
    new = hit.select("project_id", "c_custkey", F.lit("new").alias("digest")).union(hit.select(F.concat(F.lit("extra"), "c_custkey"), "c_custkey", F.lit("new")))
    return stt.upsert(old, new, "project_id").select("project_id", "digest")


@query("a10_append_once", "SELECT project_id, count(*) AS n, max(id) AS last_id FROM (SELECT project_id, id FROM {quality_logs} UNION ALL SELECT project_id, id + 1000000 FROM {quality_logs} WHERE attempt = 1) GROUP BY 1")
def a10_append_once(spark, d):
    """Two batches are appended, each of them twice."""
    table = OnceTable(spark, f"{shared_dir(spark)}/once-{uuid.uuid4().hex}", "project_id string, id long, attempt int")
    logs = view(spark, d, "quality_logs").select("project_id", "id", "attempt")
    more = logs.where("attempt = 1").withColumn("id", F.col("id") + 1_000_000)
    for _ in range(2):
        table.append(logs, "logs", 0)
        table.append(more, "logs", 1)
    return table.rows().groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


@query("a11_delete_cascade", "SELECT project_id, count(*) AS n FROM {quality_logs} WHERE project_id NOT IN ('p1', 'p3', 'unknown') GROUP BY 1")
def a11_delete_cascade(spark, d):
    gone = sql(spark, d, "SELECT DISTINCT project_id FROM {quality_logs} WHERE project_id IN ('p1', 'p3')")
    return stt.delete(view(spark, d, "quality_logs"), gone, "project_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("d7_job_lookup", f"SELECT project_id, {STATUS} AS status FROM {{jobs}} WHERE project_id = 'job42'")
def d7_job_lookup(spark, d):
    return jobs(spark, d).where("project_id = 'job42'").select("project_id", "status")


def placed(rows, time):
    """Places from 1 by falling time, then by project, with no task that holds all rows."""
    late = F.format_string("%012d", F.lit(10**11) - F.unix_seconds(F.col(time).cast("timestamp")))
    keyed = rows.select("project_id", F.lit(0).alias("all"), late.alias("day"), F.concat(late, "project_id").alias("key"))
    return gapless_rank(keyed, "all", ["day"], "key", "place").select("project_id", (F.col("place") + 1).cast("int").alias("place"))


@query("h1_jobs_by_update", "SELECT project_id, row_number() OVER (ORDER BY updated_at DESC, project_id) AS place FROM {jobs}")
def h1_jobs_by_update(spark, d):
    """Places of all jobs, those updated last first."""
    return placed(view(spark, d, "jobs"), "updated_at")


@query("h2_projects_by_creation", "SELECT project_id, row_number() OVER (ORDER BY created_at DESC, project_id) AS place FROM {jobs}")
def h2_projects_by_creation(spark, d):
    return placed(view(spark, d, "jobs"), "created_at")


@query("i7_merge_state", "SELECT project_id, 'exporting' AS status, CAST(json_extract_string(state, '$.total_chapters') AS INT) AS total_chapters, 7 AS chapters_mastered, '[1,2]' AS done FROM {jobs}")
def i7_merge_state(spark, d):
    merged = stt.merged_state("state", F.lit('{"status": "exporting", "chapters_mastered": 7, "done": [1, 2]}'))
    rows = view(spark, d, "jobs").select("project_id", F.from_json(merged, "status string, total_chapters int, chapters_mastered int, done array<int>").alias("m"))
    return rows.select("project_id", "m.status", "m.total_chapters", "m.chapters_mastered", F.to_json("m.done").alias("done"))


@query("d14_coarse_status", f"SELECT project_id, CASE WHEN {STATUS} IN ('error', 'paused', 'complete') THEN {STATUS} ELSE 'running' END AS status FROM {{jobs}}")
def d14_coarse_status(spark, d):
    return jobs(spark, d).select("project_id", stt.coarse_status("status").alias("status"))


@query("d13_stages_to_run", f"SELECT project_id, CASE {STATUS} WHEN 'complete' THEN '' WHEN 'generating' THEN 'generating,mastering,exporting' ELSE 'scripting,bootstrapping,generating,mastering,exporting' END AS stages FROM {{jobs}}")
def d13_stages_to_run(spark, d):
    return jobs(spark, d).select("project_id", F.array_join(stt.stages_to_run("status"), ",").alias("stages"))


_DAY = "CASE event_id % 7 WHEN 0 THEN 'mon' WHEN 1 THEN 'tue' WHEN 2 THEN 'wed' WHEN 3 THEN 'thu' WHEN 4 THEN 'fri' WHEN 5 THEN 'sat' ELSE 'sun' END"
_TIME = "concat(substr(concat('0', hour(ts)), -2), ':', substr(concat('0', minute(ts)), -2))"
TIMES = f"SELECT event_id AS id, {_DAY} AS day, {_TIME} AS time FROM {{events}}"


@query("d6_schedule_window", f"SELECT id, (day IN ('sat', 'sun') AND time BETWEEN '08:00' AND '12:30') OR time >= '22:00' OR time <= '06:00' OR (day = 'wed' AND time >= '18:15') OR (day = 'mon' AND time <= '09:30') AS allowed FROM ({TIMES.replace('substr(concat', 'right(concat').replace(', -2)', ', 2)')})")
def d6_schedule_window(spark, d):
    schedule = [(["sat", "sun"], "08:00", "12:30"), ([], "22:00", "06:00"), (["wed"], "18:15", None), (["mon"], None, "09:30")]
    windows = spark.createDataFrame(schedule, "days array<string>, start string, end string")
    return stt.may_run(sql(spark, d, TIMES), windows).select("id", "allowed")


PICK = "SELECT book_id, number FROM {chapter_durations} WHERE number % 3 = 0"


@query("d3_selected_chapters", "SELECT book_id, number FROM {chapter_durations} WHERE number % 3 = 0")
def d3_selected_chapters(spark, d):
    rows = view(spark, d, "chapter_durations")
    return stt.selected(rows, rows.where("number % 3 = 0").select("number")).select("book_id", "number")


@query("d4_d11_remaining_chapters", "SELECT book_id, number FROM {chapter_durations} WHERE NOT (number % 3 = 0 AND book_id <> 'book1')")
def d4_d11_remaining_chapters(spark, d):
    rows = view(spark, d, "chapter_durations").select("book_id", "number")
    return stt.remaining(rows, rows.where("number % 3 = 0 AND book_id <> 'book1'"), ["book_id", "number"])


@query("d5_partial_export", "SELECT book_id, count(*) AS n, round(sum(seconds), 6) AS seconds FROM {chapter_durations} WHERE number % 2 = 1 GROUP BY 1")
def d5_partial_export(spark, d):
    rows = view(spark, d, "chapter_durations")
    out = stt.selected(rows, rows.where("number % 2 = 1"))
    return out.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 6).alias("seconds"))


@query(
    "e10_chapter_grid",
    f"""WITH j AS (SELECT project_id, {STATUS} AS status, CAST(json_extract_string(state, '$.total_chapters') AS INT) - 2 AS total, CAST(json_extract_string(state, '$.chapters_generated') AS INT) AS done FROM {{jobs}}), e AS (SELECT *, CAST(unnest(range(1, total + 1)) AS INT) AS chapter FROM j)
SELECT project_id, chapter, CASE WHEN chapter <= done - 1 THEN 'Done' WHEN chapter <= done THEN 'Master' WHEN chapter = done + 1 THEN 'Gen' WHEN chapter <= done + 2 THEN 'Scripted' WHEN chapter = done + 3 AND status = 'created' THEN 'Script' ELSE 'Pending' END AS state FROM e""",
)
def e10_chapter_grid(spark, d):
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    rows = jobs(spark, d).withColumns({"total": F.col("total") - 2, "mastered": upto(F.col("done") - 1), "generated": upto(F.col("done")), "scripted": upto(F.col("done") + 2), "generating": F.col("done") + 1, "scripting": F.when(F.col("status") == "created", F.col("done") + 3)})
    return stt.chapter_grid(rows)


@query(
    "f13_stage_percent",
    f"SELECT project_id, least(100, floor(0.5 + CASE {STATUS} WHEN 'complete' THEN 100 WHEN 'generating' THEN (d + CASE WHEN d < t THEN 0.5 ELSE 0 END) / t * 100 ELSE d / t * 100 END))::double AS pct FROM (SELECT *, CAST(json_extract_string(state, '$.total_chapters') AS DOUBLE) AS t, CAST(json_extract_string(state, '$.chapters_generated') AS DOUBLE) AS d FROM {{jobs}})",
)
def f13_stage_percent(spark, d):
    return jobs(spark, d).select("project_id", stt.stage_percent(F.col("status"), F.col("done"), F.col("total")).alias("pct"))


@query("j15_percent", "SELECT project_id, round_even(d / t * 100, 1) AS pct FROM (SELECT project_id, CAST(json_extract_string(state, '$.total_chapters') AS DOUBLE) AS t, CAST(json_extract_string(state, '$.chapters_generated') AS DOUBLE) AS d FROM {jobs})")
def j15_percent(spark, d):
    return jobs(spark, d).select("project_id", stt.percent(F.col("done"), F.col("total")).alias("pct"))


@query("i1_i2_i3_state_lists", "SELECT project_id, CASE WHEN c_custkey % 4 IN (1, 2) THEN '1,2' ELSE concat('1,2,', c_custkey % 4) END AS scripted FROM {jobs}")
def i1_i2_i3_state_lists(spark, d):
    rows = view(spark, d, "jobs").withColumn("k", (F.col("c_custkey") % 4).cast("int"))
    return rows.select("project_id", F.array_join(stt.add_if_absent(F.array(F.lit(1), F.lit(2)), "k"), ",").alias("scripted"))


@query("i6_all_selected", "SELECT project_id, CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 1 THEN '1,2' ELSE '1' END AS selection FROM {jobs}")
def i6_all_selected(spark, d):
    n = (F.col("c_custkey") % 3 + 1).cast("int")
    return view(spark, d, "jobs").select("project_id", F.array_join(stt.all_or_list(F.concat(F.sequence(F.lit(1), n), F.array(F.lit(1))), F.lit(3)), ",").alias("selection"))


@query("doc_p11_chapter_ranges", "SELECT project_id, concat(array_to_string(range(1, c_custkey % 4 + 2), ','), ',9') AS chapters FROM {jobs}")
def doc_p11_chapter_ranges(spark, d):
    spec = F.concat(F.lit("9, 1-"), F.col("c_custkey") % 4 + 1, F.lit(",x,3-2,1"))
    return view(spark, d, "jobs").select("project_id", F.array_join(stt.chapter_ranges(spec), ",").alias("chapters"))


@query("a22_newest_file", "SELECT project_id, arg_max(path, {{'m': m, 'p': path}}) AS path FROM (SELECT project_id, concat(line_id, '_', attempt, '.m4b') AS path, created_at AS m FROM {quality_logs}) GROUP BY 1")
def a22_newest_file(spark, d):
    files = view(spark, d, "quality_logs").select("project_id", F.concat("line_id", F.lit("_"), "attempt", F.lit(".m4b")).alias("path"), F.col("created_at").alias("modified"))
    return stt.newest(files, ["project_id"])


@query("g11_ring_buffer", "SELECT user_id % 5 AS project, event_id FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id DESC) <= 500")
def g11_ring_buffer(spark, d):
    """The last 500 lines of each project (the buffer's size is the feature)."""
    rows = view(spark, d, "events").select((F.col("user_id") % 5).alias("project_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("line"))
    return last_lines(rows).select(F.col("project_id").alias("project"), F.col("seq").alias("event_id"))


LOG = "SELECT event_id, concat('12:00:00 | ', CASE WHEN event_id % 11 = 3 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'click' THEN 'INFO' WHEN event_type = 'view' THEN 'WARNING' ELSE 'DEBUG' END, ' | ', CASE WHEN event_id % 5 = 0 THEN 'uvicorn.access' WHEN event_id % 5 = 1 THEN 'uvicorn.error' WHEN event_id % 5 = 2 THEN 'httpx' ELSE 'engine.run' END, ' | m') AS raw FROM {events}"


@query("d8_j24_log_lines", f"SELECT event_id, CASE WHEN contains(raw, '| CRITICAL |') THEN 'other' WHEN contains(raw, '| ERROR |') THEN 'error' WHEN contains(raw, '| WARNING |') THEN 'warn' ELSE 'info' END AS level FROM ({LOG}) WHERE NOT contains(raw, '| DEBUG |') AND NOT contains(raw, '| uvicorn.')")
def d8_j24_log_lines(spark, d):
    from ..streaming.events import classified_logs

    return classified_logs(sql(spark, d, LOG)).select("event_id", "level")


_LINES = "SELECT event_id, CASE WHEN event_id % 13 = 5 THEN '[PIPELINE ENDED]' WHEN event_id % 13 = 6 THEN concat('plain | ', event_id) WHEN event_id % 13 = 7 THEN concat('a |INFO | b | ERROR | ', event_id) ELSE raw END AS raw FROM (" + LOG + ")"


@query(
    "j24_line_classes",
    f"""SELECT event_id, CASE WHEN regexp_matches(raw, '\\|\\s*ERROR\\s*\\|') THEN 'error' WHEN regexp_matches(raw, '\\|\\s*WARNING\\s*\\|') THEN 'warn' WHEN regexp_matches(raw, '\\|\\s*INFO\\s*\\|') THEN 'info'
WHEN regexp_matches(raw, '\\|\\s*DEBUG\\s*\\|') THEN 'debug' WHEN starts_with(raw, '[PIPELINE ENDED]') THEN 'sentinel' ELSE 'other' END AS shown FROM ({_LINES})""",
)
def j24_line_classes(spark, d):
    from ..streaming.events import line_class

    return sql(spark, d, _LINES).select("event_id", line_class("raw").alias("shown"))


# Sizes of all units: the powers of 1024 and what lies about them.
_SIZE = "CASE WHEN doc_id % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(n_chars AS DOUBLE) * power(CAST(32 AS DOUBLE), doc_id % 8) END"


@query(
    "j25_bytes",
    f"""WITH n AS (SELECT doc_id, {_SIZE} AS n FROM {{documents}}), i AS (SELECT doc_id, n, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS i FROM n)
SELECT doc_id, CASE WHEN n = 0 THEN '0 Bytes' ELSE concat(rtrim(rtrim(CAST(CAST(floor(n / power(1024, i) * 100 + 0.5) / 100 AS DECIMAL(18, 2)) AS VARCHAR), '0'), '.'), ' ', ['Bytes', 'KB', 'MB', 'GB', 'TB'][i + 1]) END AS size FROM i""",
)
def j25_bytes(spark, d):
    return sql(spark, d, f"SELECT doc_id, {_SIZE} AS n FROM {{documents}}").select("doc_id", tx.human_bytes("n").alias("size"))


@query("j26_retry_wait", "SELECT id, CAST(least(30, power(2, attempt)) AS DOUBLE) AS wait FROM {quality_logs}")
def j26_retry_wait(spark, d):
    return view(spark, d, "quality_logs").select("id", F.least(F.lit(30.0), F.pow(F.lit(2.0), F.col("attempt"))).alias("wait"))


@query("m5_bootstrap_skip", "SELECT DISTINCT book_id, lower(speaker) AS id FROM {script_lines} WHERE NOT (speaker = 'user' AND book_id = 'b1')")
def m5_bootstrap_skip(spark, d):
    """Voices still to design: speakers without one."""
    speakers = view(spark, d, "script_lines").select("book_id", F.lower("speaker").alias("id")).distinct()
    return stt.remaining(speakers, speakers.where("id = 'user' AND book_id = 'b1'"), ["book_id", "id"])


@query("h8_top_traits", "SELECT doc_id, array_to_string(w[1:4], ',') AS traits FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x0b]+'), lambda x: x <> '') AS w FROM {documents})")
def h8_top_traits(spark, d):
    return view(spark, d, "documents").select("doc_id", F.array_join(F.slice(tx.word_list("text"), 1, 4), ",").alias("traits"))


@query("h9_truncations", "SELECT doc_id, substr(text, 1, 80) AS head, length(substr(text, 1, 12000)) AS n FROM {documents}")
def h9_truncations(spark, d):
    return view(spark, d, "documents").select("doc_id", F.substring("text", 1, 80).alias("head"), F.length(F.substring("text", 1, 12_000)).cast("long").alias("n"))


def _link(size: str, every: int) -> str:
    return f"CASE WHEN page_id % {every} = 0 THEN concat('http://{size}/', page_id, '?zoom=1&u=http://y') ELSE '' END"


IMAGE_SIZES = {"extraLarge": 7, "large": 5, "medium": 4, "small": 1, "thumbnail": 3, "smallThumbnail": 2}
_IMAGE = "CASE " + " ".join(f"WHEN page_id % {n} = 0 THEN concat('https://{s}/', page_id, '?zoom=3&u=https://y')" for s, n in IMAGE_SIZES.items() if s != "small") + " END"


@query("j23_image_chain", f"SELECT page_id, {_IMAGE} AS image FROM {{pages}}")
def j23_image_chain(spark, d):
    """All five sizes, of which a page has some; ``small`` isn't one of them."""
    from ..sources.catalogue import best_image

    links = ", ".join(f"'{s}', {_link(s, n)}" for s, n in IMAGE_SIZES.items())
    return sql(spark, d, f"SELECT page_id, map({links}) AS links FROM {{pages}}").select("page_id", best_image(F.col("links")).alias("image"))


def _books() -> str:
    """Answers with other numbers listed before or between the ISBNs, sizes that don't count, and some without items."""
    o, c = "{{", "}}"
    number = lambda kind, start: f"concat('{o}\"type\": \"{kind}\", \"identifier\": \"{start}', page_id, '\"{c}')"
    numbers = f"CASE WHEN page_id % 4 = 0 THEN concat({number('OTHER', 'o-')}, ',') ELSE '' END, CASE WHEN page_id % 3 < 2 THEN concat({number('ISBN_10', '10-')}, ',') ELSE '' END, {number('ISBN_13', '13-')}"
    links = f"'{o}\"small\": \"http://no\", \"large\": \"', {_link('large', 2)}, '\", \"thumbnail\": \"', {_link('thumbnail', 1)}, '\"{c}'"
    item = f"'{o}\"items\": [{o}\"volumeInfo\": {o}\"title\": \"T', page_id, '\", \"industryIdentifiers\": [', {numbers}, '], \"imageLinks\": ', {links}, '{c}{c}]{c}'"
    return f"SELECT page_id, CASE WHEN page_id % 10 = 9 THEN '{o}\"items\": []{c}' ELSE concat({item}) END AS body FROM {{pages}}"


@query(
    "a19_catalogue_lookup",
    """SELECT page_id, CASE WHEN page_id % 10 < 9 THEN concat('T', page_id) END AS title, CASE WHEN page_id % 10 < 9 THEN concat(CASE WHEN page_id % 3 < 2 THEN '10-' ELSE '13-' END, page_id) END AS isbn, CASE WHEN page_id % 10 < 9 THEN '' END AS description,
CASE WHEN page_id % 10 < 9 THEN concat('https://', CASE WHEN page_id % 2 = 0 THEN 'large' ELSE 'thumbnail' END, '/', page_id, '?zoom=3&u=https://y') END AS image FROM {pages}""",
)
def a19_catalogue_lookup(spark, d):
    from ..sources.catalogue import book_metadata

    return book_metadata(sql(spark, d, _books()), "body").select("page_id", "title", "isbn", "description", "image")
