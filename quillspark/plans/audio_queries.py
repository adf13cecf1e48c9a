"""Queries over audio segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import audio as au
from ..functions import text as tx
from ..operators import audio as op
from ..operators.loudness import integrated_loudness
from .registry import query
from .views import view

# Segments as doubles; some are clipped, some silent for long.
_S = "(SELECT vec_id, sample_rate, item, list_transform(pcm, lambda x: CASE WHEN vec_id % 5 = 0 THEN x::double * 20 WHEN vec_id % 5 = 1 THEN x::double * 0.001::double ELSE x::double END) AS pcm FROM {segments} WHERE pcm IS NOT NULL)"


def segments(spark, d):
    rows, x = view(spark, d, "segments").where("pcm is not null"), F.col("vec_id") % 5
    return rows.withColumn("pcm", F.transform("pcm", lambda v: v.cast("double") * F.when(x == 0, 20.0).when(x == 1, 0.001).otherwise(1.0)))


_PEAK = "list_max(list_transform(pcm, lambda x: abs(x)))"
_DB = f"CASE WHEN {_PEAK} > 0 THEN 20 * log10({_PEAK}) ELSE -100 END"
_FRAMES = "list_transform(range(0, len(pcm) - 8, 8), lambda i: sqrt(list_sum(list_transform(pcm[i + 1:i + 8], lambda x: x * x)) / 8))"
_LEVELS = f"list_sort(list_transform(list_filter({_FRAMES}, lambda r: r > 0), lambda r: 20 * log10(r)))"
_RUN = "list_max(list_prepend(0, list_transform(string_split(array_to_string(list_transform(pcm, lambda x: CASE WHEN abs(x) < 0.01::double THEN '1' ELSE '0' END), ''), '0'), lambda s: length(s))))"
_WORDS = "(SELECT item_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM {benchmark})"


@query("j12_peak", f"SELECT vec_id, round({_DB}, 6) AS peak_dbfs, {_DB} > -0.5 AS clipped FROM {_S}")
def j12_peak(spark, d):
    return segments(spark, d).select("vec_id", F.round(au.peak_dbfs("pcm"), 6).alias("peak_dbfs"), (au.peak_dbfs("pcm") > -0.5).alias("clipped"))


@query("g13_frames", "SELECT vec_id, len(range(0, len(pcm) - 8, 8)) AS n_frames FROM " + _S)
def g13_frames(spark, d):
    return segments(spark, d).select("vec_id", F.size(au.frames("pcm", F.lit(8))).cast("long").alias("n_frames"))


@query("j13_noise_floor", f"SELECT vec_id, round(CASE WHEN len(l) = 0 THEN -100 ELSE list_avg(l[1:greatest(1, len(l) // 10)]) END, 6) AS noise_floor FROM (SELECT vec_id, {_LEVELS} AS l FROM {_S})")
def j13_noise_floor(spark, d):
    return segments(spark, d).select("vec_id", F.round(au.noise_floor_db("pcm", F.col("sample_rate")), 6).alias("noise_floor"))


@query("h6_quietest_mean", f"SELECT vec_id, round(list_avg(l[1:greatest(1, len(l) // 10)]), 6) AS quietest FROM (SELECT vec_id, list_sort(list_transform(pcm, lambda x: abs(x))) AS l FROM {_S})")
def h6_quietest_mean(spark, d):
    rows = segments(spark, d).select("vec_id", F.array_sort(F.transform("pcm", F.abs)).alias("l"))
    low = F.slice("l", 1, F.greatest(F.lit(1), F.floor(F.size("l") / 10).cast("int")))
    return rows.select("vec_id", F.round(F.aggregate(low, F.lit(0.0), lambda a, x: a + x) / F.size(low), 6).alias("quietest"))


@query("g12_longest_silence", f"SELECT vec_id, CAST({_RUN} AS INT) AS longest, {_RUN} > 24 AS too_long FROM {_S}")
def g12_longest_silence(spark, d):
    """As a fold over the samples; too long is more than 0.15 s."""
    rows = segments(spark, d).withColumn("longest", au.longest_silence("pcm"))
    return rows.select("vec_id", "longest", (F.col("longest") > F.floor(F.col("sample_rate") * 0.15)).alias("too_long"))


@query("g12_silence_islands", f"SELECT vec_id, CAST({_RUN} AS INT) AS longest FROM {_S}")
def g12_silence_islands(spark, d):
    """The same by gaps and islands over exploded samples, for segments too long for one row."""
    return op.longest_silence_by_islands(segments(spark, d), ["vec_id"]).select("vec_id", "longest")


@query(
    "j8_j9_durations",
    f"""WITH s AS (SELECT vec_id, len(pcm) / 160.0::double * 20 AS sec, n / (150.0::double * 0.9::double) * 60 AS exp FROM {_S} JOIN {_WORDS} ON item_id = item)
SELECT vec_id, round(exp, 6) AS expected, round(abs(sec - exp) / exp, 6) AS deviation, abs(sec - exp) / exp <= 0.3::double AS ok, round(greatest(0, 1 - abs(sec - exp) / exp), 6) AS score FROM s WHERE exp > 0""",
)
def j8_j9_durations(spark, d):
    texts = view(spark, d, "benchmark").select(F.col("item_id").alias("item"), tx.word_count("text").alias("n"))
    rows = segments(spark, d).join(texts, "item").select("vec_id", (F.size("pcm") / 160.0 * 20).alias("sec"), au.expected_seconds(F.col("n"), F.lit(0.9)).alias("exp")).where("exp > 0")
    dev = au.duration_deviation(F.col("sec"), F.col("exp"))
    return rows.select("vec_id", F.round("exp", 6).alias("expected"), F.round(dev, 6).alias("deviation"), (dev <= 0.3).alias("ok"), F.round(au.duration_score(F.col("sec"), F.col("exp")), 6).alias("score"))


@query(
    "j10_artifacts",
    f"""WITH s AS (SELECT vec_id, {_DB} > -0.5 AS c, {_RUN} > 24 AS q, {_LEVELS} AS l FROM {_S}), t AS (SELECT *, CASE WHEN len(l) = 0 THEN -100 ELSE list_avg(l[1:greatest(1, len(l) // 10)]) END > -20 AS n FROM s)
SELECT vec_id, round(greatest(0, 1 - CASE WHEN c THEN 0.3 ELSE 0 END - CASE WHEN n THEN 0.2 ELSE 0 END - CASE WHEN q THEN 0.2 ELSE 0 END), 6)::double AS artifact_score FROM t""",
)
def j10_artifacts(spark, d):
    rows = op.analysed(segments(spark, d), noise_limit=-20.0, max_silence_seconds=0.15)
    return rows.select("vec_id", F.round("artifact_score", 6).alias("artifact_score"))


@query(
    "k1_segment_analysis",
    f"""WITH s AS (SELECT vec_id, project, {_DB} AS p, {_RUN} > 24 AS q, {_LEVELS} AS l, len(pcm) / 160.0::double AS sec FROM (SELECT *, vec_id % 3 AS project FROM {_S})),
t AS (SELECT *, CASE WHEN len(l) = 0 THEN -100 ELSE list_avg(l[1:greatest(1, len(l) // 10)]) END AS n FROM s)
SELECT project, count(*) AS segments, round(sum(sec), 6) AS seconds, round(avg(p), 6) AS mean_peak, round(avg(n), 6) AS mean_noise, CAST(sum(CASE WHEN p > -0.5 THEN 1 ELSE 0 END) AS BIGINT) AS clipped, CAST(sum(CASE WHEN q THEN 1 ELSE 0 END) AS BIGINT) AS silent FROM t GROUP BY 1""",
)
def k1_segment_analysis(spark, d):
    rows = op.analysed(segments(spark, d), noise_limit=-20.0, max_silence_seconds=0.15).withColumn("project", F.col("vec_id") % 3)
    flag = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    return rows.groupBy("project").agg(
        F.count(F.lit(1)).alias("segments"), F.round(F.sum("duration_seconds"), 6).alias("seconds"), F.round(F.avg("peak_dbfs"), 6).alias("mean_peak"), F.round(F.avg("noise_floor_db"), 6).alias("mean_noise"), flag("clipping_detected").alias("clipped"), flag("has_long_silence").alias("silent")
    )


@query("k2_silence", "SELECT vec_id, len(list_transform(range(0, CAST(floor(160 * (vec_id % 700) / 1000) AS BIGINT)), lambda x: 0)) AS n FROM {segments}")
def k2_silence(spark, d):
    return view(spark, d, "segments").select("vec_id", F.size(au.silence(F.col("sample_rate"), F.col("vec_id") % 700)).cast("long").alias("n"))


_RMS = "sqrt(list_sum(list_transform(pcm, lambda x: x * x)) / len(pcm))"


@query("k6_loudness", f"SELECT vec_id, round(20 * log10({_RMS}) - 0.691, 6) AS lufs FROM {_S} WHERE len(pcm) / 160.0 >= 0.4 AND {_PEAK} > 0")
def k6_loudness(spark, d):
    return segments(spark, d).where(F.size("pcm") / F.col("sample_rate") >= 0.4).select("vec_id", F.round(au.loudness("pcm", F.col("sample_rate")), 6).alias("lufs"))


@query("k7_loudness_gain", f"WITH s AS (SELECT vec_id, pcm, 20 * log10({_RMS}) - 0.691 AS l FROM {_S}), g AS (SELECT vec_id, list_transform(pcm, lambda x: x * CASE WHEN l > -70 THEN power(10, (-19 - l) / 20) ELSE 1 END) AS pcm FROM s) SELECT vec_id, round(20 * log10({_RMS}) - 0.691, 6) AS lufs, round({_PEAK}, 6) AS peak FROM g")
def k7_loudness_gain(spark, d):
    rows = segments(spark, d).withColumn("pcm", au.to_loudness("pcm", F.col("sample_rate")))
    return rows.select("vec_id", F.round(au.loudness("pcm", F.col("sample_rate")), 6).alias("lufs"), F.round(au.peak("pcm"), 6).alias("peak"))


@query("k8_peak_limit", f"SELECT vec_id, round(least({_PEAK}, power(10, -1 / 20.0::double)), 9) AS peak, round(list_sum(pcm) * CASE WHEN {_PEAK} > power(10, -1 / 20.0::double) THEN power(10, -1 / 20.0::double) / {_PEAK} ELSE 1 END, 6) AS total FROM {_S}")
def k8_peak_limit(spark, d):
    rows = segments(spark, d).withColumn("pcm", au.limited("pcm"))
    return rows.select("vec_id", F.round(au.peak("pcm"), 9).alias("peak"), F.round(F.aggregate("pcm", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("k11_mono", "SELECT vec_id, round(list_sum(list_transform(range(1, len(pcm) + 1), lambda i: (pcm[i] + pcm[len(pcm) + 1 - i]) / 2)), 6) AS total FROM " + _S)
def k11_mono(spark, d):
    rows = segments(spark, d).withColumn("m", au.mono("pcm", F.reverse("pcm")))
    return rows.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_SEV = "least(1.0::double, least(1.0::double, abs(p) / 3) + CASE WHEN abs(s - 1) > 0.1::double THEN 0.1::double ELSE 0 END + CASE WHEN tone <> 'neutral' THEN 0.15::double ELSE 0 END)"
_FX = "SELECT vec_id, pcm, CAST(vec_id % 9 - 4 AS DOUBLE) / 2 AS p, CASE WHEN vec_id % 4 = 0 THEN 1.0::double WHEN vec_id % 4 = 2 THEN 0.95::double ELSE 0.8::double END AS s, CASE WHEN vec_id % 3 = 0 THEN 'neutral' WHEN vec_id % 3 = 1 THEN 'warm' ELSE 'bright' END AS tone FROM " + _S


def effects(rows):
    """Pitch, speed and tone of an effect by vec_id."""
    n = F.col("vec_id")
    speed = F.when(n % 4 == 0, 1.0).when(n % 4 == 2, 0.95).otherwise(0.8)
    return rows.select("vec_id", "sample_rate", "pcm", ((n % 9 - 4).cast("double") / 2).alias("p"), speed.alias("s"), F.when(n % 3 == 0, "neutral").when(n % 3 == 1, "warm").otherwise("bright").alias("tone"))


@query("j16_k14_blend", f"SELECT vec_id, round(0.2 * (1 - {_SEV}), 9) AS share, round(list_sum(list_transform(pcm, lambda x: x * least(0.4, greatest(0, 0.2 * (1 - {_SEV}))) + x * 3 * (1 - least(0.4, greatest(0, 0.2 * (1 - {_SEV})))))), 6) AS total FROM ({_FX})")
def j16_k14_blend(spark, d):
    rows = effects(segments(spark, d))
    mixed = au.blended("pcm", au.gained("pcm", F.lit(3.0)), au.blend_share("p", "s", "tone"))
    return rows.select("vec_id", F.round(au.blend_share("p", "s", "tone"), 9).alias("share"), F.round(F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# The tilt of a spectrum of 64 samples as a circular convolution, by the sum of its cosines.
_TILT = "(SELECT list_transform(range(64), lambda d: list_sum(list_transform(range(33), lambda k: CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END * (k / 32.0::double) * cos(2 * pi() * k * d / 64))) / 64) AS h)"


@query(
    "k12_effects",
    f"""WITH e AS (SELECT vec_id, pcm, 0.2 * (1 - {_SEV}) AS m, CASE tone WHEN 'warm' THEN -0.18 WHEN 'bright' THEN 0.18 ELSE 0 END::double AS a FROM ({_FX}))
SELECT vec_id, round(list_sum(list_transform(range(64), lambda n: least(1, greatest(-1, pcm[n + 1] * m + (1 - m) * 3 * (pcm[n + 1] + a * list_sum(list_transform(range(64), lambda j: pcm[j + 1] * h[(n - j + 64) % 64 + 1]))))))), 6) AS total FROM e, {_TILT}""",
)
def k12_effects(spark, d):
    """The chain over all segments and tones; the stretched samples are thrice as loud."""
    rows = effects(segments(spark, d)).withColumn("loud", au.gained("pcm", F.lit(3.0)))
    out = op.with_effects(rows, "p", "s", "tone", stretched="loud")
    return out.select("vec_id", F.round(F.aggregate("pcm", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("d9_d10_effect_predicates", f"SELECT vec_id, abs(p) < 0.001 AND abs(s - 1) < 0.001 AND tone = 'neutral' AS is_identity, NOT (abs(p) < 0.001 AND abs(s - 1) < 0.001) AS needs_tool FROM ({_FX})")
def d9_d10_effect_predicates(spark, d):
    rows = effects(view(spark, d, "segments").where("pcm is not null"))
    return rows.select("vec_id", op.is_identity("p", "s", F.col("tone")).alias("is_identity"), op.needs_tool("p", "s").alias("needs_tool"))


@query("m4_fallback_silence", "SELECT vec_id, CASE WHEN pcm IS NULL OR vec_id % 50 = 0 THEN 80 ELSE len(pcm) END AS n FROM {segments}")
def m4_fallback_silence(spark, d):
    """Failed segments become half a second of silence."""
    rows = view(spark, d, "segments").withColumn("made", F.when(F.col("vec_id") % 50 != 0, F.col("pcm")))
    return rows.select("vec_id", F.size(F.coalesce("made", F.array_repeat(F.lit(0.0).cast("float"), F.floor(F.col("sample_rate") / 2).cast("int")))).cast("long").alias("n"))


@query("k9_noise_gate")
def k9_noise_gate(spark, d):
    return op.filtered(segments(spark, d), "gate").select("vec_id", F.round(au.peak("pcm"), 9).alias("peak"), F.size("pcm").alias("n"))


@query("k10_resample")
def k10_resample(spark, d):
    return op.filtered(segments(spark, d), "resample", 320).select("vec_id", F.size("pcm").alias("n"), F.round(au.peak("pcm"), 9).alias("peak"))


@query("k13_tone")
def k13_tone(spark, d):
    return op.filtered(segments(spark, d), "warm").select("vec_id", F.round(au.peak("pcm"), 6).alias("peak"), F.size("pcm").alias("n"))


#: 300 segments in a row make a chapter, whatever the number of rows.
CHAPTER = "CAST(floor(vec_id / 300) AS INT) AS chapter"


# 16 samples of pause before, 64 of sound and 48 of pause after each line; four of them fade in.
@query(
    "k3_k4_assemble_chapters",
    f"""WITH s AS (SELECT CAST(floor(vec_id / 300) AS INT) AS chapter, len(pcm) AS l, list_max(list_transform(range(len(pcm)), lambda k: abs(pcm[k + 1]) * CASE WHEN k < 4 THEN sin(k * pi() / 6) ELSE 1 END)) AS p FROM {_S})
SELECT chapter, CAST(160 + 320 + sum(16 + l + 48 - least(4, l)) AS BIGINT) AS n, round(max(p), 6) AS peak FROM s GROUP BY 1""",
)
def k3_k4_assemble_chapters(spark, d):
    rows = segments(spark, d).select(F.expr(CHAPTER), F.col("vec_id").alias("line_ord"), "sample_rate", "pcm", F.lit(100).alias("pause_before_ms"), F.lit(300).alias("pause_after_ms"))
    parts = op.assembled_parts(rows, ["chapter"], 160)
    return parts.groupBy("chapter").agg(F.sum(F.size("pcm")).cast("long").alias("n"), F.round(F.max(au.peak("pcm")), 6).alias("peak"))


# Lines of which some have no pause on either side, so that sound fades into sound; part by part, by one sum over samples.
_LINES = f"(SELECT vec_id, CAST(floor(vec_id / 300) AS INT) AS chapter, pcm, vec_id % 3 * 25 AS pb, CASE WHEN vec_id % 4 < 2 THEN 0 ELSE 40 END AS pa FROM {_S})"


@query(
    "k4_crossfaded_parts",
    f"""WITH a AS (SELECT *, pb * 160 // 1000 AS b, pa * 160 // 1000 AS e, len(pcm) AS l, row_number() OVER w AS part, lag(pa * 160 // 1000) OVER w AS pe FROM {_LINES} WINDOW w AS (PARTITION BY chapter ORDER BY vec_id)),
n AS (SELECT *, least(8, CASE WHEN b > 0 THEN b WHEN part = 1 THEN 160 WHEN pe > 0 THEN pe ELSE 8 END) AS f FROM a),
o AS (SELECT *, b + l - f + e AS own, CASE WHEN lead(b) OVER w = 0 THEN lead(f) OVER w ELSE 0 END AS m, lead(pcm) OVER w AS nx FROM n WINDOW w AS (PARTITION BY chapter ORDER BY vec_id)),
p AS (SELECT chapter, part, 160 + coalesce(sum(own) OVER (PARTITION BY chapter ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_sample, own AS n,
  list_sum(list_transform(range(CASE WHEN b > 0 THEN 0 ELSE f END, l), lambda k: pcm[k + 1] * CASE WHEN k < f THEN sin(k * pi() / 2 / (f - 1)) ELSE 1 END * CASE WHEN e = 0 AND k >= l - m THEN cos((k - l + m) * pi() / 2 / (m - 1)) ELSE 1 END))
  + coalesce(list_sum(list_transform(range(m), lambda k: nx[k + 1] * sin(k * pi() / 2 / (m - 1)))), 0) AS total FROM o)
SELECT chapter, CAST(part AS BIGINT) AS part, CAST(start_sample AS BIGINT) AS start_sample, CAST(n AS BIGINT) AS n, round(total, 6) AS total FROM p""",
)
def k4_crossfaded_parts(spark, d):
    v = F.col("vec_id")
    rows = segments(spark, d).select(F.expr(CHAPTER), v.alias("line_ord"), "pcm", (v % 3 * 25).alias("pause_before_ms"), F.when(v % 4 < 2, 0).otherwise(40).alias("pause_after_ms"))
    parts = op.assembled_parts(rows, ["chapter"], 160, fade_ms=50)
    size, last = F.size("pcm").cast("long"), F.max("part").over(Window.partitionBy("chapter"))
    out = parts.select("chapter", "part", "start_sample", size.alias("n"), F.round(F.aggregate("pcm", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
    return out.withColumn("_last", last).where("part > 0 and part < _last").drop("_last")


@query("k5_mastering_chain")
def k5_mastering_chain(spark, d):
    rows = segments(spark, d).select(F.expr(CHAPTER), F.col("vec_id").alias("line_ord"), "sample_rate", "pcm", F.lit(0).alias("pause_before_ms"), F.lit(300).alias("pause_after_ms"))
    return op.mastered(op.assembled(rows, ["chapter"]), to_rate=320).select("chapter", "n", F.round("lufs", 6).alias("lufs"), F.round("peak_dbfs", 6).alias("peak_dbfs"))


_LOUD = """WITH RECURSIVE k AS (SELECT 4000.0::double AS rate, 2 * pi() * 1500 / 4000 AS w, 2 * pi() * 38 / 4000 AS v, power(10, 0.1)::double AS a),
f AS (SELECT rate, cos(v) AS q, sin(v) AS p, a, cos(w) AS c, sqrt(2.0) * sqrt(a) * sin(w) AS r FROM k),
g AS (SELECT rate, (a + 1) - (a - 1) * c + r AS n, a * ((a + 1) + (a - 1) * c + r) AS b0, -2 * a * ((a - 1) + (a + 1) * c) AS b1, a * ((a + 1) + (a - 1) * c - r) AS b2, 2 * ((a - 1) - (a + 1) * c) AS a1, (a + 1) - (a - 1) * c - r AS a2, q, p FROM f),
x AS (SELECT label, flatten(list(embedding::double[] ORDER BY vec_id)) AS x FROM {embeddings} WHERE embedding IS NOT NULL GROUP BY label),
y AS (SELECT label, 0::bigint AS i, 0.0::double AS x1, 0.0::double AS x2, 0.0::double AS u1, 0.0::double AS u2, 0.0::double AS y1, 0.0::double AS y2 FROM x
  UNION ALL SELECT label, i + 1, now, x1, u, u1, ((1 + q) / 2 * u - (1 + q) * u1 + (1 + q) / 2 * u2 + 2 * q * y1 - (1 - p) * y2) / (1 + p), y1 FROM (
    SELECT y.*, x.x[i + 1] AS now, (b0 * x.x[i + 1] + b1 * x1 + b2 * x2 - a1 * u1 - a2 * u2) / n AS u, q, p FROM y JOIN x ON x.label IS NOT DISTINCT FROM y.label, g WHERE i < len(x.x))),
b AS (SELECT label, len(x) AS n, unnest(range(CASE WHEN len(x) >= 1600 THEN CAST(round((len(x) / 4000.0 - 0.4) / 0.1) AS BIGINT) + 1 ELSE 0 END)) AS j FROM x),
z AS (SELECT b.label, j, sum(y1 * y1) / 1600 AS z FROM b JOIN y ON y.label IS NOT DISTINCT FROM b.label AND i > j * 400 AND i <= least(j * 400 + 1600, n) GROUP BY 1, 2),
l AS (SELECT label, z, CASE WHEN z > 0 THEN -0.691 + 10 * log10(z) END AS l FROM z),
h AS (SELECT label, -10.691 + 10 * log10(avg(z)) AS gate FROM l WHERE l >= -70 GROUP BY label),
o AS (SELECT l.label, -0.691 + 10 * log10(avg(z)) AS lufs FROM l JOIN h ON h.label IS NOT DISTINCT FROM l.label WHERE l > gate AND l > -70 GROUP BY l.label)
SELECT x.label, round(coalesce(lufs, -70), 6) AS lufs FROM x LEFT JOIN o ON o.label IS NOT DISTINCT FROM x.label"""


@query("k6_integrated_loudness", _LOUD)
def k6_integrated_loudness(spark, d):
    """The vectors of a label in a row as one recording; the SQL filters sample by sample."""
    rows = view(spark, d, "embeddings").where("embedding is not null")
    pieces = rows.select(F.col("label").alias("audio"), F.col("vec_id").alias("piece"), F.lit(4000).alias("sample_rate"), F.col("embedding").alias("pcm"))
    return integrated_loudness(pieces).select(F.col("audio").alias("label"), F.round("lufs", 6).alias("lufs"))
