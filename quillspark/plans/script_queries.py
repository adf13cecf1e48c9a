"""Queries of script lines, registries and word error rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import registry as rg
from ..operators import script as sc
from ..operators import state as stt
from ..runtime import totals_before
from .registry import query
from .text_queries import whole_words
from .views import query as sql
from .views import view

# Dialogue for the fragmenter: conversations with quotes, decimals, and marks in a row.
DIALOGUE = """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('He said "', substr(text, 1, 30), '" and "No!?" then 3.14 left... ', text) WHEN turn % 3 = 1 THEN concat(text, ' "open quote. stays') ELSE text END AS text FROM {conversations}"""
FRAGMENTS = (
    """d AS ("""
    + DIALOGUE
    + """), p AS (SELECT conv_id, turn, p, pi FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS pi FROM d) WHERE trim(p) <> ''),
q AS (SELECT *, unnest(regexp_extract_all(p, '"[^"]*"|[^"]+|"')) AS part, unnest(range(len(regexp_extract_all(p, '"[^"]*"|[^"]+|"')))) AS qi FROM p),
g AS (SELECT *, length(part) > 1 AND starts_with(part, '"') AND ends_with(part, '"') AS quoted FROM q),
m AS (SELECT *, sum(CASE WHEN quoted OR prior THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, pi ORDER BY qi) AS grp FROM (SELECT *, coalesce(lag(quoted) OVER (PARTITION BY conv_id, turn, pi ORDER BY qi), true) AS prior FROM g)),
j AS (SELECT conv_id, turn, pi, grp, bool_or(quoted) AS quoted, string_agg(part, '' ORDER BY qi) AS part FROM m GROUP BY 1, 2, 3, 4),
s AS (SELECT *, CASE WHEN quoted THEN [part] ELSE regexp_extract_all(part, '(?s).+?(?:[.!?]+(\\s|$)|$)') END AS cuts FROM j),
u AS (SELECT conv_id, turn, pi, grp, unnest(cuts) AS f, unnest(range(len(cuts))) AS fi FROM s),
frag AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pi, grp, fi) - 1 AS INT) AS idx, trim(f) AS fragment FROM u WHERE trim(f) <> '')"""
)


@query("j5_fragments", f"WITH {FRAGMENTS} SELECT conv_id, turn, idx, md5(fragment) AS digest FROM frag")
def j5_fragments(spark, d):
    out = sc.fragment_lines(sql(spark, d, DIALOGUE), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "idx", F.md5(F.col("fragment").cast("binary")).alias("digest"))


LINES = "SELECT conv_id, CAST(turn AS INT) AS idx, text AS fragment FROM {conversations}"
META = """SELECT conv_id, CAST(turn AS INT) AS pos, CASE WHEN turn % 4 = 3 THEN 'x' WHEN turn % 4 = 2 THEN CAST(turn - 1 AS VARCHAR(9)) ELSE CAST(turn AS VARCHAR(9)) END AS id, CASE WHEN turn % 2 = 0 THEN 'Old Tom' END AS speaker, CASE WHEN turn % 3 = 0 THEN 'joy' END AS emotion,
CASE WHEN turn % 4 = 1 THEN 'normal' ELSE '0.9' END AS speed, CASE WHEN turn % 3 = 1 THEN '120' END AS pause_before_ms, CASE WHEN turn % 2 = 0 THEN '0' ELSE '250' END AS pause_after_ms FROM {conversations}"""


@query(
    "e1_align_metadata",
    f"""WITH l AS ({LINES}), m AS ({META}), k AS (SELECT *, try_cast(id AS INT) AS idx, row_number() OVER (PARTITION BY conv_id, try_cast(id AS INT) ORDER BY pos DESC) AS n FROM m WHERE try_cast(id AS INT) IS NOT NULL)
SELECT l.conv_id, l.idx, md5(fragment) AS digest, lower(coalesce(speaker, 'narrator')) AS speaker, coalesce(emotion, 'neutral') AS emotion, coalesce(try_cast(speed AS DOUBLE), 1.0) AS speed,
coalesce(nullif(try_cast(pause_before_ms AS INT), 0), 0) AS pause_before_ms, coalesce(nullif(try_cast(pause_after_ms AS INT), 0), 500) AS pause_after_ms
FROM l LEFT JOIN k ON k.conv_id = l.conv_id AND k.idx = l.idx AND k.n = 1""",
)
def e1_align_metadata(spark, d):
    out = sc.align(sql(spark, d, LINES), sql(spark, d, META), ["conv_id"])
    return out.select("conv_id", "idx", F.md5(F.col("fragment").cast("binary")).alias("digest"), "speaker", "emotion", "speed", "pause_before_ms", "pause_after_ms")


@query("j19_lenient_casts", f"WITH m AS ({META}) SELECT conv_id, pos, try_cast(id AS INT) AS id, coalesce(try_cast(speed AS DOUBLE), 1.0) AS speed, coalesce(nullif(try_cast(pause_after_ms AS INT), 0), 500) AS pause FROM m")
def j19_lenient_casts(spark, d):
    m = sql(spark, d, META)
    return m.select("conv_id", "pos", F.col("id").try_cast("int").alias("id"), F.coalesce(F.col("speed").try_cast("double"), F.lit(1.0)).alias("speed"), sc.lenient_pause(F.col("pause_after_ms"), 500).alias("pause"))


@query("g6_line_ids", "SELECT book_id, chapter_number, line_ord, concat('ch', lpad(CAST(chapter_number AS VARCHAR), CAST(greatest(2, length(CAST(chapter_number AS VARCHAR))) AS INT), '0'), '_', lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0')) AS line_id FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_number ORDER BY line_ord) AS n FROM {script_lines})")
def g6_line_ids(spark, d):
    return sc.line_ids(view(spark, d, "script_lines"), "chapter_number", ["book_id", "chapter_number"], ["line_ord"]).select("book_id", "chapter_number", "line_ord", "line_id")


CHAPTERS = "SELECT book_id, chapter_number AS number, md5(CAST(min(text) AS VARCHAR(9999999))) AS summary FROM {script_lines} GROUP BY book_id, chapter_number"


@query("g7_previous_summary", f"SELECT book_id, number, coalesce(lag(summary) OVER (PARTITION BY book_id ORDER BY number), '') AS previous_summary FROM ({CHAPTERS})")
def g7_previous_summary(spark, d):
    return sc.previous_summary(sql(spark, d, CHAPTERS)).select("book_id", "number", "previous_summary")


@query("g5_drop_overlap", "SELECT book_id, chapter_number, CAST(greatest(0, (line_ord - 2) // 3) AS INT) AS chunk, CAST(line_ord AS INT) AS idx FROM {script_lines}")
def g5_drop_overlap(spark, d):
    """Chunks that overlap by two lines: what remains is each line once."""
    lines = view(spark, d, "script_lines").select("book_id", "chapter_number", F.col("line_ord").cast("int").alias("idx"), "text")
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - 2) / 3)).cast("int")
    both = lines.withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col("idx") / 3).cast("int"))))
    out = sc.drop_overlap(both.select("book_id", "chapter_number", "chunk", "idx", "text"), ["book_id", "chapter_number"])
    return out.select("book_id", "chapter_number", "chunk", "idx")


@query(
    "g5_e13_repeated_starts",
    """WITH RECURSIVE l AS (SELECT book_id, chapter_number, line_ord, substr(lower(trim(text)), 1, 1) AS head FROM {script_lines}),
c AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number) AS i, chapter_number AS chunk, list(head ORDER BY line_ord) AS h, list(line_ord ORDER BY line_ord) AS o FROM l GROUP BY book_id, chapter_number),
s AS (SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS tail, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS chunk FROM c
  UNION ALL SELECT book_id, i, list_concat(tail, h[k + 1:])[-3:], CAST(o[k + 1:] AS BIGINT[]), chunk FROM (
    SELECT c.*, s.tail, coalesce(list_position(list_transform(h, lambda x: list_contains(s.tail, x)), false) - 1, len(h)) AS k FROM s JOIN c ON c.book_id = s.book_id AND c.i = s.i + 1))
SELECT book_id, CAST(chunk AS BIGINT) AS chunk, unnest(kept) AS idx FROM s""",
)
def g5_e13_repeated_starts(spark, d):
    """A conversation as a chunk of its book: lines at its start go whose first character starts one of the last three kept."""
    rows = view(spark, d, "script_lines").select("book_id", F.col("chapter_number").cast("long").alias("chunk"), F.col("line_ord").cast("long").alias("idx"), "text")
    return sc.drop_overlap(rows, ["book_id"], last=3, prefix=1).select("book_id", "chunk", "idx")


KNOWN = "SELECT DISTINCT book_id, 'user' AS id FROM {script_lines}"
ORDERED = "SELECT book_id, speaker, chapter_number * 1000 + line_ord AS ord FROM {script_lines}"


@query(
    "e4_unknown_speakers",
    f"SELECT book_id, id, min(ord) AS first_ord, concat(upper(id[1]), id[2:]) AS name, 'other' AS gender, concat('A neutral voice for the character ', replace(id, '_', ' '), '.') AS voice_description FROM (SELECT book_id, ord, replace(lower(speaker), ' ', '_') AS id FROM ({ORDERED})) WHERE (book_id, id) NOT IN (SELECT (book_id, id) FROM ({KNOWN})) GROUP BY book_id, id",
)
def e4_unknown_speakers(spark, d):
    return sc.unknown_speakers(sql(spark, d, ORDERED), sql(spark, d, KNOWN))


VOICES = "SELECT DISTINCT book_id, CASE WHEN book_id = 'b1' THEN 'narrator' ELSE 'user' END AS character_id, concat(book_id, '.wav') AS file FROM {script_lines} WHERE book_id < 'b5'"


@query(
    "e3_voice_with_fallback",
    f"WITH v AS ({VOICES}) SELECT l.book_id, line_id, coalesce(a.file, n.file) AS voice_file FROM {{script_lines}} l LEFT JOIN v a ON a.book_id = l.book_id AND a.character_id = l.speaker LEFT JOIN v n ON n.book_id = l.book_id AND n.character_id = 'narrator'",
)
def e3_voice_with_fallback(spark, d):
    return sc.with_voice(view(spark, d, "script_lines"), sql(spark, d, VOICES)).select("book_id", "line_id", "voice_file")


EFFECTS = "SELECT DISTINCT book_id, 'user' AS id, length(book_id) - 4 AS voice_fx FROM {script_lines} WHERE book_id <> 'b2'"


@query("e2_voice_effects", f"SELECT l.book_id, line_id, voice_fx FROM {{script_lines}} l LEFT JOIN ({EFFECTS}) c ON c.book_id = l.book_id AND c.id = l.speaker")
def e2_voice_effects(spark, d):
    return sc.with_voice_effects(view(spark, d, "script_lines"), sql(spark, d, EFFECTS)).select("book_id", "line_id", "voice_fx")


@query("e6_results_by_line", "SELECT line_id, speaker, attempt FROM {script_lines} JOIN (SELECT concat('c', chapter_number, '_', attempt) AS line_id, max(attempt) AS attempt FROM {quality_logs} GROUP BY 1) USING (line_id)")
def e6_results_by_line(spark, d):
    results = view(spark, d, "quality_logs").groupBy(F.concat(F.lit("c"), "chapter_number", F.lit("_"), "attempt").alias("line_id")).agg(F.max("attempt").alias("attempt"))
    return view(spark, d, "script_lines").join(results, "line_id").select("line_id", "speaker", "attempt")


@query(
    "e12_test_sentences",
    """SELECT book_id, chapter, CASE g WHEN 'male' THEN 'The ancient tower stood against the darkening sky, its stones weathered by centuries of wind and rain.'
WHEN 'female' THEN 'She walked through the moonlit garden, her footsteps barely disturbing the fallen leaves.' ELSE 'The library was vast and silent, filled with the scent of old paper and forgotten memories.' END AS sentence
FROM (SELECT book_id, chapter, lower(gender) AS g FROM {registry_raw})""",
)
def e12_test_sentences(spark, d):
    return view(spark, d, "registry_raw").select("book_id", "chapter", rg.test_sentence(F.lower("gender")).alias("sentence"))


@query("e11_speaker_colours", "SELECT book_id, id, CASE WHEN id = 'narrator' THEN 'narrator' ELSE CAST((n - 1) % 10 + 1 AS VARCHAR) END AS colour FROM (SELECT book_id, id, row_number() OVER (PARTITION BY book_id ORDER BY ord) AS n FROM (SELECT book_id, lower(speaker) AS id, min(chapter_number * 1000 + line_ord) AS ord FROM {script_lines} GROUP BY 1, 2))")
def e11_speaker_colours(spark, d):
    first = view(spark, d, "script_lines").groupBy("book_id", F.lower("speaker").alias("id")).agg(F.min(F.col("chapter_number") * 1000 + F.col("line_ord")).alias("ord"))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    return first.select("book_id", "id", F.when(F.col("id") == "narrator", "narrator").otherwise(((n - 1) % 10 + 1).cast("string")).alias("colour"))


@query("h4_speaker_order", "SELECT book_id, line_id, row_number() OVER (PARTITION BY book_id ORDER BY speaker, chapter_number, line_ord) AS place FROM {script_lines}")
def h4_speaker_order(spark, d):
    rows = view(spark, d, "script_lines").select("book_id", "line_id", "speaker", "chapter_number", "line_ord", F.lit(1).alias("_one"))
    rows = totals_before(rows, "book_id", ["speaker", "chapter_number", "line_ord"], {"_before": "_one"})
    return rows.select("book_id", "line_id", (F.col("_before") + 1).alias("place"))


@query("g10_batches", "SELECT line_id, CAST((row_number() OVER (PARTITION BY book_id, chapter_number ORDER BY speaker, line_ord) - 1) // 5 AS INT) AS batch FROM {script_lines}")
def g10_batches(spark, d):
    return sc.voice_batches(view(spark, d, "script_lines"), ["book_id", "chapter_number"]).select("line_id", "batch")


_ID = "replace(replace(lower(raw_id), ' ', '_'), '-', '_')"


# Two records a chapter, of which the second is placed first where the chapter is odd.
RECORDS = "SELECT book_id, chapter, raw_id, CASE WHEN chapter % 2 = 1 THEN 9 ELSE 1 END AS place, voice_description, gender, concat('Name ', chapter) AS name, tone AS speaking_style FROM {registry_raw} UNION ALL SELECT book_id, chapter, raw_id, 5 AS place, concat('other', substr(voice_description, 6)) AS voice_description, 'male' AS gender, concat('Second ', chapter) AS name, 'x' AS speaking_style FROM {registry_raw} WHERE length(voice_description) > 5"


@query(
    "f6_accumulate_registry",
    f"""WITH r AS (SELECT *, {_ID} AS id FROM ({RECORDS})), n AS (SELECT *, row_number() OVER (PARTITION BY book_id, id ORDER BY length(coalesce(voice_description, '')) DESC, chapter, place) AS best,
row_number() OVER (PARTITION BY book_id, id ORDER BY chapter, place) AS nth, count(*) OVER (PARTITION BY book_id, id) AS mentions FROM r)
SELECT b.book_id, b.id, f.chapter AS first_chapter, f.place AS first_place, b.voice_description, b.gender, b.name, b.speaking_style, b.mentions FROM n b JOIN n f ON f.book_id = b.book_id AND f.id = b.id WHERE b.best = 1 AND f.nth = 1""",
)
def f6_accumulate_registry(spark, d):
    return rg.accumulate(sql(spark, d, RECORDS))


PARSED = f"""p AS (SELECT book_id, id, ord, coalesce(nm, list_reduce(list_transform(string_split(replace(id, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b)) AS name, CASE WHEN g IN ('male', 'female', 'other') THEN g ELSE 'other' END AS gender, coalesce(age, 'unknown') AS age_range, coalesce(style, '') AS speaking_style FROM (
SELECT book_id, {_ID} AS id, min(chapter) AS ord, lower(arg_max(coalesce(gender, 'other'), chapter)) AS g, nullif(arg_max(CASE WHEN chapter % 7 < 3 THEN concat('Name ', chapter) ELSE '' END, chapter), '') AS nm,
nullif(arg_max(CASE WHEN chapter % 2 = 0 THEN 'adult' ELSE '' END, chapter), '') AS age, arg_max(coalesce(tone, ''), chapter) AS style FROM {{registry_raw}} GROUP BY 1, 2))"""


def given(spark, d):
    """Raw registry rows, of which some give a name or an age."""
    n = F.col("chapter")
    return view(spark, d, "registry_raw").withColumns({"name": F.when(n % 7 < 3, F.concat(F.lit("Name "), n)), "age_range": F.when(n % 2 == 0, "adult"), "speaking_style": F.col("tone")})


@query("f7_parse_registry", f"WITH {PARSED} SELECT * FROM p")
def f7_parse_registry(spark, d):
    return rg.parsed(given(spark, d)).drop("voice_description", "personality_traits")


NARRATED = (
    PARSED.replace("coalesce(style, '') AS speaking_style FROM", "coalesce(style, '') AS speaking_style, vd AS voice_description FROM").replace("arg_max(coalesce(tone, ''), chapter) AS style FROM", "arg_max(coalesce(tone, ''), chapter) AS style, arg_max(coalesce(voice_description, ''), chapter) AS vd FROM")
    + """, w AS (SELECT book_id, id, ord, name, gender, age_range, speaking_style, voice_description, '' AS traits FROM p UNION ALL SELECT book_id, 'narrator', max(ord) + 1, 'Narrator', 'male', '40s', 'Flowing descriptive prose, unhurried',
'A warm, mature male baritone, early 40s, with a measured storytelling cadence. Rich and clear with natural gravitas. Thoughtful pauses between phrases.', 'measured,warm,authoritative' FROM p GROUP BY 1 HAVING count(*) FILTER (id = 'narrator') = 0)"""
)
# Books whose narrator has another name, so that half of them lack one.
RENAMED = "SELECT * REPLACE (CASE WHEN raw_id = 'narrator' AND book_id IN ('src1', 'src3', 'src5', 'src7') THEN 'teller' ELSE raw_id END AS raw_id) FROM {registry_raw}"


@query("f8_cap_voices", f"WITH {NARRATED.replace('FROM {registry_raw} GROUP', f'FROM ({RENAMED}) GROUP')}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, id = 'narrator' ORDER BY ord, id) AS n FROM w) SELECT * EXCLUDE (n) FROM r WHERE id = 'narrator' OR n <= 5")
def f8_cap_voices(spark, d):
    other = (F.col("raw_id") == "narrator") & F.col("book_id").isin("src1", "src3", "src5", "src7")
    raw = given(spark, d).withColumn("raw_id", F.when(other, "teller").otherwise(F.col("raw_id")))
    out = rg.capped(rg.with_narrator(rg.parsed(raw)), most=6)
    return out.withColumn("traits", F.array_join("personality_traits", ",")).drop("personality_traits")


@query("j20_format_registry", f"WITH {PARSED} SELECT book_id, md5(string_agg(concat('- **', name, '** (id: `', id, '`, ', gender, ', ', age_range, '): ', speaking_style), chr(10) ORDER BY ord, id)) AS digest FROM p GROUP BY 1")
def j20_format_registry(spark, d):
    return rg.formatted(rg.parsed(given(spark, d))).select("book_id", F.md5(F.col("listing").cast("binary")).alias("digest"))


@query("f6_first_tone", "SELECT book_id, arg_min(tone, chapter) AS tone FROM {registry_raw} WHERE tone <> '' GROUP BY 1")
def f6_first_tone(spark, d):
    return rg.first_tone(view(spark, d, "registry_raw"))


@query("j3_speaker_ids", f"SELECT book_id, chapter, {_ID} AS analyzer_id, replace(lower(raw_id), ' ', '_') AS script_id FROM {{registry_raw}}")
def j3_speaker_ids(spark, d):
    return view(spark, d, "registry_raw").select("book_id", "chapter", tx.speaker_id("raw_id", hyphens=True).alias("analyzer_id"), tx.speaker_id("raw_id").alias("script_id"))


@query(
    "j14_instructions",
    """WITH l AS (SELECT line_id, speed, CASE WHEN line_ord % 3 = 0 THEN 'neutral' WHEN line_ord % 3 = 1 THEN 'joy' ELSE '' END AS e FROM {script_lines}),
p AS (SELECT line_id, CASE WHEN e <> '' THEN 'Speak with ' || e END AS f, CASE WHEN speed = 1 THEN NULL WHEN speed < 0.9::double THEN 'at a slow, measured pace' WHEN speed < 1 THEN 'at a slightly slower pace' WHEN speed > 1.1::double THEN 'at a quick, energetic pace' ELSE 'at a slightly faster pace' END AS s FROM l)
SELECT line_id, CASE WHEN f IS NULL AND s IS NULL THEN '' ELSE concat_ws('. ', f, s) || '.' END AS instruction FROM p""",
)
def j14_instructions(spark, d):
    n = F.col("line_ord") % 3
    return view(spark, d, "script_lines").select("line_id", sc.instruction(F.when(n == 0, "neutral").when(n == 1, "joy").otherwise(""), "speed").alias("instruction"))


@query("f9_line_counts", "SELECT book_id, chapter_number, count(*) AS total_lines, sum(CASE WHEN pause_before_ms BETWEEN 0 AND 5000 AND speed BETWEEN 0.5 AND 2 THEN 0 ELSE 1 END)::bigint AS out_of_range FROM {script_lines} GROUP BY 1, 2")
def f9_line_counts(spark, d):
    bad = F.when(F.col("pause_before_ms").between(0, 5000) & F.col("speed").between(0.5, 2), 0).otherwise(1)
    return view(spark, d, "script_lines").groupBy("book_id", "chapter_number").agg(F.count(F.lit(1)).alias("total_lines"), F.sum(bad).alias("out_of_range"))


@query("doc_p6_character_tiers", "SELECT book_id, speaker, count(*) AS n_lines, CASE WHEN count(*) > 10 THEN 'major' WHEN count(*) >= 2 THEN 'supporting' ELSE 'minor' END AS tier FROM {script_lines} GROUP BY 1, 2")
def doc_p6_character_tiers(spark, d):
    return sc.character_tiers(view(spark, d, "script_lines"))


@query(
    "doc_p6_voice_groups",
    "SELECT book_id, concat(speaker, chapter_number % 29) AS speaker, count(*) AS n_lines, CASE WHEN count(*) <= 5 THEN CASE WHEN chapter_number % 29 < 9 THEN 'generic_female' ELSE 'generic_other' END ELSE concat(speaker, chapter_number % 29) END AS voice FROM {script_lines} GROUP BY book_id, speaker, chapter_number % 29",
)
def doc_p6_voice_groups(spark, d):
    """Speakers by role and conversation; those of the first nine have a gender."""
    who = F.concat("speaker", F.col("chapter_number") % 29)
    lines = view(spark, d, "script_lines").select("book_id", who.alias("speaker"), (F.col("chapter_number") % 29).alias("n"))
    characters = lines.where("n < 9").select("book_id", F.col("speaker").alias("id"), F.lit("female").alias("gender")).distinct()
    return sc.voice_groups(lines, characters, threshold=5)


@query(
    "doc_p7_pauses_by_breaks",
    "SELECT book_id, chapter_number, line_ord, CASE WHEN lag(line_ord) OVER w IS NULL THEN 1000 ELSE 0 END AS pause_before, CASE WHEN lead(line_ord) OVER w IS NULL THEN 2000 WHEN length(text) % 5 = 0 THEN 1500 WHEN speaker <> 'user' AND length(text) % 2 = 0 THEN 600 WHEN speaker <> 'user' THEN 500 ELSE 300 END AS pause_after FROM {script_lines} WINDOW w AS (PARTITION BY book_id, chapter_number ORDER BY line_ord)",
)
def doc_p7_pauses_by_breaks(spark, d):
    """The assistant narrates; lengths of texts say where paragraphs and scenes end."""
    lines = view(spark, d, "script_lines").withColumn("speaker", F.when(F.col("speaker") == "user", "user").otherwise("narrator"))
    n = F.length("text")
    return sc.pauses_by_breaks(lines.withColumns({"scene": n % 5 == 0, "para": n % 2 == 0}), "scene", "para")


@query("doc_p7_positional_pauses", "SELECT book_id, chapter_number, line_ord, CASE WHEN lag(line_ord) OVER w IS NULL THEN 1000 ELSE 0 END AS pause_before, CASE WHEN lead(line_ord) OVER w IS NULL THEN 2000 WHEN speaker = 'narrator' THEN 500 ELSE 300 END AS pause_after FROM {script_lines} WINDOW w AS (PARTITION BY book_id, chapter_number ORDER BY line_ord)")
def doc_p7_positional_pauses(spark, d):
    return sc.positional_pauses(view(spark, d, "script_lines"))


@query("doc_p8_context_window", "SELECT book_id, chapter_number, line_ord, md5(string_agg(text, chr(10)) OVER (PARTITION BY book_id, chapter_number ORDER BY line_ord ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) AS digest FROM {script_lines}")
def doc_p8_context_window(spark, d):
    out = sc.context_window(view(spark, d, "script_lines"))
    return out.select("book_id", "chapter_number", "line_ord", F.md5(F.col("context").cast("binary")).alias("digest"))


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}_\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("j6_wer_normalise", f"SELECT conv_id, turn, md5({_NORM.format('hyp')}) AS digest FROM {{ref_hyp}}")
def j6_wer_normalise(spark, d):
    return view(spark, d, "ref_hyp").select("conv_id", "turn", F.md5(tx.normalized_for_wer("hyp").cast("binary")).alias("digest"))


@query(
    "j7_word_error_rate",
    f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split({_NORM.format('ref')}, ' '), lambda x: x <> '') AS r, list_filter(string_split({_NORM.format('hyp')}, ' '), lambda x: x <> '') AS h FROM {{ref_hyp}}),
e AS (SELECT conv_id, turn, len(r) AS n, list_reduce(range(1, len(r) + 1), lambda prev, i: list_reduce(range(1, len(h) + 1), lambda cur, j: list_append(cur, least(prev[j + 1] + 1, cur[j] + 1, prev[j] + CASE WHEN h[j] = r[i] THEN 0 ELSE 1 END)), [prev[1] + 1]), range(0, len(h) + 1))[-1] AS k FROM w WHERE len(r) > 0)
SELECT conv_id, turn, round(least(1.0, k / n), 9) AS wer FROM e UNION ALL SELECT conv_id, turn, 1.0 FROM w WHERE len(r) = 0""",
)
def j7_word_error_rate(spark, d):
    words = view(spark, d, "ref_hyp").select("conv_id", "turn", tx.word_list(tx.normalized_for_wer("ref")).alias("r"), tx.word_list(tx.normalized_for_wer("hyp")).alias("h"))
    return words.select("conv_id", "turn", F.round(tx.word_error_rate(F.col("r"), F.col("h")), 9).alias("wer"))


@query("i4_dictionary_overlay", "SELECT word, arg_max(replacement, p) AS replacement FROM (SELECT substr(text, 1, 4) AS word, min(concat('g', item_id)) AS replacement, 0 AS p FROM {benchmark} WHERE item_id % 3 > 0 GROUP BY 1 UNION ALL SELECT substr(text, 1, 4), min(concat('p', item_id)), 1 FROM {benchmark} WHERE item_id % 3 < 2 GROUP BY 1) GROUP BY 1")
def i4_dictionary_overlay(spark, d):
    b = view(spark, d, "benchmark")
    part = lambda c, p: b.where(c).groupBy(F.substring("text", 1, 4).alias("word")).agg(F.min(F.concat(F.lit(p), "item_id")).alias("replacement"))
    return stt.overlaid(part("item_id % 3 > 0", "g"), part("item_id % 3 < 2", "p"))


@query(
    "doc_p9_packed_segments",
    f"""WITH {FRAGMENTS}, w AS (SELECT *, idx // 4 AS g, len(list_filter(regexp_split_to_array(fragment, '\\s+'), lambda x: x <> '')) AS n FROM frag), t AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn, g) AS s FROM w),
mm AS (SELECT *, CASE WHEN s < 3 AND g > 0 THEN g - 1 ELSE g END AS segment FROM t)
SELECT conv_id, turn, CAST(segment AS INT) AS segment, count(*) AS n_fragments, CAST(sum(n) AS BIGINT) AS n_words, md5(string_agg(fragment, ' ' ORDER BY idx)) AS digest FROM mm GROUP BY conv_id, turn, segment""",
)
def doc_p9_packed_segments(spark, d):
    out = sc.packed_segments(sc.fragment_lines(sql(spark, d, DIALOGUE), ["conv_id", "turn"]), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "segment", "n_fragments", "n_words", F.md5(F.col("text").cast("binary")).alias("digest"))


_EXPAND = whole_words(whole_words("{0}", "the", "a thee"), "x", "")


@query(
    "doc_p3_p4_expanded_wer",
    f"""WITH e AS (SELECT conv_id, turn, {_EXPAND.replace('{0}', 'ref')} AS ref, {_EXPAND.replace('{0}', 'hyp')} AS hyp FROM {{ref_hyp}}),
w AS (SELECT conv_id, turn, list_filter(string_split({_NORM.format('ref')}, ' '), lambda x: x <> '') AS r, list_filter(string_split({_NORM.format('hyp')}, ' '), lambda x: x <> '') AS h FROM e),
k AS (SELECT conv_id, turn, len(r) AS n, list_reduce(range(1, len(r) + 1), lambda prev, i: list_reduce(range(1, len(h) + 1), lambda cur, j: list_append(cur, least(prev[j + 1] + 1, cur[j] + 1, prev[j] + CASE WHEN h[j] = r[i] THEN 0 ELSE 1 END)), [prev[1] + 1]), range(0, len(h) + 1))[-1] AS k FROM w WHERE len(r) > 0)
SELECT conv_id, turn, round(least(1.0, k / n), 9) AS wer FROM k UNION ALL SELECT conv_id, turn, 1.0 FROM w WHERE len(r) = 0""",
)
def doc_p3_p4_expanded_wer(spark, d):
    """Dictionary rewriting of both sides before the error rate."""
    rows = view(spark, d, "ref_hyp")
    side = lambda c: tx.word_list(tx.normalized_for_wer(tx.rewrite_words(c, [("the", "a thee"), ("x", "")])))
    return rows.select("conv_id", "turn", side("ref").alias("r"), side("hyp").alias("h")).select("conv_id", "turn", F.round(tx.word_error_rate(F.col("r"), F.col("h")), 9).alias("wer"))
