"""Operator 2, mixing sources to target weights by Pfair scheduling, in DataFrame functions.

Each source is a task whose weight is its share; block ``b`` (from 0) of a source with share ``a`` out of
``H`` may be placed from slot floor(b * H / a) on and must be placed before slot ceil((b + 1) * H / a). Slots
take the released block with the earliest deadline; of equal deadlines that of the larger share goes first,
then that of the lesser name. On one processor with total weight 1 this meets every deadline, so after any
number of slots every source is less than one block away from its target.

The schedule repeats after ``H`` slots (the sum of the integer shares). Sources of equal share have equal
windows and take turns in the order of their names, so a pool of them is one queue and the state of the
schedule is one number for each share that occurs. A first fold over the period keeps that state alone, at
every few slots; from there on the pieces are planned side by side, one row each. Blocks then find their slot
by a join on share and place in the queue. Rows never meet in one place: they are ranked within their source
leaf by leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Tables, columns_of, gapless_rank

#: Plans and lists of sources of up to so many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
ADDED = ["_block", "_release", "_deadline", "_slot", "_position"]

#: The pool that takes slot t, given the blocks placed of each pool: that of the released block due first.
_PICK = """array_min(transform(sequence(0, size(s) - 1), i -> if(done[i] < s[i].share * s[i].n and ((done[i] div s[i].n) * h) div s[i].share <= t,
    named_struct('deadline', ((done[i] div s[i].n + 1) * h + s[i].share - 1) div s[i].share, 'i', i), null))).i"""
_STEP = "transform(done, (d, i) -> d + if(i = pick, 1L, 0L))"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _period(sources: DataFrame, stage: Tables, piece: int | None) -> DataFrame:
    """``(share, n)`` -> ``(share, turn, period, at)``: the slot of each turn of each pool in one period."""
    pools = sources.groupBy("share").agg(F.count(F.lit(1)).alias("n"))
    row = pools.agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("o"), "share", "n"))).alias("s")).where(F.size("s") > 0)
    row = row.withColumn("h", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["share"] * x["n"]))
    row = row.withColumn("w", F.lit(piece).cast("long") if piece else F.greatest(F.lit(256), F.ceil(F.sqrt("h"))).cast("long"))
    slots = "sequence(c * w, least((c + 1) * w, h) - 1)"
    on = f"aggregate({slots}, st.done, (done, t) -> {_let('pick', _PICK, _STEP)})"
    states = f"""aggregate(sequence(0L, (h - 1) div w), named_struct('done', array_repeat(0L, size(s)), 'at', cast(array() as array<struct<c:bigint,done:array<bigint>>>)),
        (st, c) -> named_struct('done', {on}, 'at', concat(st.at, array(named_struct('c', c, 'done', st.done)))), st -> st.at)"""
    states = stage(row.select("s", "h", "w", F.explode(F.expr(states)).alias("x")), "states")
    states = states.select("s", "h", "w", "x.c", F.col("x.done").alias("start")).repartition("c")
    taken = _let("done", "st.done", _let("pick", _PICK, f"named_struct('done', {_STEP}, 'plan', concat(st.plan, array(named_struct('i', pick, 'turn', done[pick]))))"))
    plan = f"aggregate({slots}, named_struct('done', start, 'plan', cast(array() as array<struct<i:int,turn:bigint>>)), (st, t) -> {taken}, st -> st.plan)"
    out = states.select("s", "h", (F.col("c") * F.col("w")).alias("first"), F.posexplode(F.expr(plan)).alias("k", "x"))
    return stage(out.select(F.expr("s[x.i].share").alias("_share"), F.col("x.turn").alias("_turn"), F.col("h").alias("_period"), (F.col("first") + F.col("k")).alias("_at")), "period")


def mix(docs: DataFrame, shares: dict[str | None, int], source_col: str = "source", id_col: str = "doc_id", default_share: int = 1, block_rows: int = 64, piece: int | None = None) -> DataFrame:
    """Place every row of ``docs`` in one sequence that keeps the sources to their target shares.

    Adds ``_block`` (number in its source), ``_release``, ``_deadline``, ``_slot`` and ``_position`` (sorts
    the rows; unique, with gaps only where a source's last block is short or a source has run out). Blocks
    are ``block_rows`` rows of a source in the order of md5(id), ids that tie in any order. No row is dropped
    or repeated: when a source has run out its slots stay empty and the others keep their proportions.
    ``shares`` are whole numbers above 0 by source (None: rows with a null source, which are a source of
    their own); sources not named have ``default_share``. Null ids sort as the empty string. An empty table
    gives an empty table; all columns are kept, but for one with the name of an added one, which that
    replaces; texts, however long, play no part. ``piece`` is the number of slots that one row plans (default: the root of the period).
    """
    if default_share < 1 or any(int(v) != v or v < 1 for v in shares.values()):
        raise ValueError("shares are whole numbers above 0")
    stage = Tables()
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    share: Column = F.lit(default_share)
    for name, value in shares.items():
        share = F.when(F.col("_key") == ("" if name is None else f"s{name}"), value).otherwise(share)
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(F.struct(*columns_of(docs)).alias("_row"), key.alias("_key"), md5.alias("_md5"), F.substring(md5, 1, 2).alias("_b1"), F.substring(md5, 3, 2).alias("_b2"))
    sources = stage(keyed.select("_key").distinct().withColumn("share", share.cast("long")), "sources")
    count = sources.count()
    plan = _period(sources, stage, piece)
    named = sources.withColumns({"_b1": F.substring("_key", 1, 8), "_b2": F.substring("_key", 1, 16)})
    named = gapless_rank(named, "share", ["_b1", "_b2"], "_key", "_member")
    named = named.join(sources.groupBy("share").agg(F.count(F.lit(1)).alias("_n")), "share")
    named = stage(named.select("_key", F.col("share").alias("_share"), "_member", "_n"), "named")
    known = F.broadcast(named) if count <= BROADCAST_ROWS else named
    slots = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    ranked = gapless_rank(keyed, "_key", ["_b1", "_b2"], "_md5", "_rank").withColumn("_block", F.floor(F.col("_rank") / block_rows))
    rows = ranked.join(known, "_key").withColumn("_turn", F.expr("(_block % _share) * _n + _member")).join(slots, ["_share", "_turn"])
    slot = F.expr("(_block div _share) * _period + _at")
    stage.close(plan, named)
    return rows.select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED],
        "_block",
        F.expr("(_block * _period) div _share").alias("_release"),
        F.expr("((_block + 1) * _period + _share - 1) div _share").alias("_deadline"),
        slot.alias("_slot"),
        (slot * block_rows + F.expr(f"_rank % {block_rows}")).alias("_position"),
    )


#: Production shares: the large source counts five times each of the others.
SHARES = {"src0": 5}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    out = mix(docs, SHARES)
    return out.select("doc_id", "source", *[F.col(f"_{c}").cast("long").alias(c) for c in ("block", "release", "deadline", "slot", "position")])


OP2_SQL = """
WITH RECURSIVE src AS (SELECT s AS source, CASE WHEN s = 'src0' THEN 5 ELSE 1 END AS a, row_number() OVER (ORDER BY s) AS i FROM (SELECT DISTINCT source AS s FROM documents)),
p AS (SELECT list(a ORDER BY i) AS a, sum(a)::bigint AS h, count(*)::bigint AS k FROM src),
run AS (SELECT 0::bigint AS t, list_transform(range(k), lambda x: 0::bigint) AS done, 0::bigint AS pick FROM p
  UNION ALL
  SELECT t + 1, list_transform(range(1, k + 1), lambda x: done[x] + CASE WHEN x = c THEN 1 ELSE 0 END), c FROM (
    SELECT t, done, k, list_min(list_transform(list_filter(range(1, k + 1), lambda x: done[x] < a[x] AND (done[x] * h) // a[x] <= t), lambda x: (((done[x] + 1) * h + a[x] - 1) // a[x]) * 100000 + x)) % 100000 AS c
    FROM run, p WHERE t < h)),
plan AS (SELECT pick AS i, t - 1 AS tick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM run WHERE t > 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::varchar), doc_id) - 1 AS rk FROM documents),
b AS (SELECT r.*, rk // 64 AS block, src.i, src.a, p.h FROM r JOIN src USING (source), p)
SELECT doc_id, source, block::bigint AS block, ((block * h) // a)::bigint AS release, (((block + 1) * h + a - 1) // a)::bigint AS deadline,
((block // a) * h + tick)::bigint AS slot, (((block // a) * h + tick) * 64 + rk % 64)::bigint AS position
FROM b JOIN plan ON plan.i = b.i AND plan.nth = b.block % b.a
"""
