"""Operator 1, suffix-array dedup by prefix-free parsing.

Every text is parsed at content-defined triggers: a start position belongs to the 16-byte window with
the least rolling (Karp-Rabin) hash among the ``window`` windows that follow it. Positions that share a
trigger form one phrase, so equal text is parsed alike wherever it stands. All strings of ``length``
bytes that start in a phrase hold the ``length - window + 1`` bytes from its trigger on; that part of the
parse is the key ``k``, and ``c`` identifies the phrase with all bytes that its strings reach (dictionary
entry plus bounded parse suffix).

The corpus order of suffixes is needed only to depth ``length``: a string of ``length`` bytes is repeated
exactly if its suffix shares that many bytes with a neighbour in corpus order. Most suffixes are decided by
their phrase and don't enter the order:

1. phrases whose key occurs once in the corpus hold no repeated string (most of ordinary text ends here);
2. phrases whose dictionary entry occurs twice or more are repeated as a whole;
3. of the remaining entries, the dictionary to be sorted, one copy each is cut into blocks of a few suffixes,
   aligned to the trigger, to which 1 and 2 apply again with the bytes that all or any of the block's strings hold;
4. the suffixes of blocks still undecided are extended along the parse to depth ``length`` and put into
   corpus order by a range sort, and neighbours are compared byte by byte.

Nothing is collected; hot entries are counted with map-side combine and joined as staged tables, and equal
suffixes spread over many ranges of the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import null_safe, release, staged

GRAM = 16
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def _triggers(data: np.ndarray, starts: int, window: int) -> np.ndarray:
    """For each of ``starts`` positions the offset of its trigger."""
    h, base, width = _BYTE[data], _BASE, 1
    with np.errstate(over="ignore"):
        while width < GRAM:  # Karp-Rabin hash of all windows, doubling their width
            h = h[:-width] * base + h[width:]
            base, width = base * base, width * 2
        h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    key = (h[: starts + window - 1] << np.uint64(32)) | np.arange(starts + window - 1, dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < window:
        key = np.minimum(key[: starts], key[window - width : window - width + starts])
    return (key[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def parse(text: bytes, length: int, window: int):
    """Yield arrays ``lo, hi, a, k, c`` of the phrases of ``text``: first and last start, trigger, key, entry."""
    n = len(text)
    for at in range(0, max(0, n - length + 1), BLOCK):
        starts = min(BLOCK, n - length + 1 - at)
        data = np.frombuffer(text, np.uint8, min(n - at, starts + length), at)
        trig = _triggers(data, starts, window)
        lo = np.flatnonzero(np.concatenate(([True], trig[1:] != trig[:-1])))
        hi = np.concatenate((lo[1:], [starts])) - 1
        right = length - window + 1
        ks = [xxhash.xxh3_64_intdigest(text[i : i + right]) for i in (trig[lo] + at).tolist()]
        cs = [xxhash.xxh3_64_intdigest(text[i:j], 7) for i, j in zip((lo + at).tolist(), (hi + at + length).tolist())]
        yield lo + at, hi + at, trig[lo] + at, np.array(ks, np.uint64).view(np.int64), np.array(cs, np.uint64).view(np.int64)


def _phrases(length: int, window: int):
    def run(batches):
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2)
            rows, cols, held = [], [[], [], [], [], []], 0

            def out():
                take = pa.array(np.concatenate(rows))
                arrays = [ids.take(take), hashes.take(take), *(pa.array(np.concatenate(c)) for c in cols)]
                return pa.RecordBatch.from_arrays(arrays, names=["_id", "_h", "lo", "hi", "a", "k", "c"])

            for i, text in enumerate(texts):
                for part in parse(text.as_py() or b"", length, window):
                    rows.append(np.full(len(part[0]), i))
                    held += len(part[0])
                    for c, p in zip(cols, part):
                        c.append(p)
                    if held > 200_000:
                        yield out()
                        rows, cols, held = [], [[], [], [], [], []], 0
            if held:
                yield out()

    return run


def _contexts(length: int):
    """Rows (_id, _h, lo, hi, a, n, ctx): the bytes that the strings of the given phrases reach."""

    def run(batches):
        for batch in batches:
            ids, hashes, texts, spans = (batch.column(i) for i in range(4))
            rows, cols = [], [[], [], [], [], []]
            for i, (text, own) in enumerate(zip(texts, spans)):
                text = text.as_py()
                for s in own.as_py():
                    rows.append(i)
                    for c, v in zip(cols, (s["lo"], s["hi"], s["a"], s["n"], text[s["lo"] : s["hi"] + length])):
                        c.append(v)
            take = pa.array(rows, pa.int64())
            arrays = [ids.take(take), hashes.take(take), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_h", "lo", "hi", "a", "n", "ctx"])

    return run


def _blocks(length: int, block: int):
    """Rows (_id, _h, at, lo, hi, n, k, c): phrases cut at each ``block`` positions before the trigger."""

    def run(batches):
        for batch in batches:
            ids, hashes, los, his, tr, ns, texts = (batch.column(i) for i in range(7))
            rows, out, keys = [], [[], [], [], []], [[], []]
            for i, (lo, hi, a, n, ctx) in enumerate(zip(los.to_pylist(), his.to_pylist(), tr.to_pylist(), ns.to_pylist(), texts.to_pylist())):
                for j in range((a - hi) // block, (a - lo) // block + 1):
                    last, first = min(hi, a - j * block), max(lo, a - (j + 1) * block + 1)
                    core = ctx[a - j * block - lo : a - (j + 1) * block + 1 + length - lo]
                    rows.append(i)
                    for c, v in zip(out, (lo, first, last, n)):
                        c.append(v)
                    keys[0].append(xxhash.xxh3_64_intdigest(core, j))
                    keys[1].append(xxhash.xxh3_64_intdigest(ctx[first - lo : last + length - lo], j + 1000))
            take = pa.array(rows, pa.int64())
            arrays = [ids.take(take), hashes.take(take), *(pa.array(c, pa.int64()) for c in out), *(pa.array(np.array(k, np.uint64).view(np.int64)) for k in keys)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_h", "at", "lo", "hi", "n", "k", "c"])

    return run


def _suffixes(length: int, held: int = 50_000):
    """Rows (_id, _h, p, n, s): the suffixes of the given blocks, extended along the parse to depth ``length``."""

    def run(batches):
        for batch in batches:
            ids, hashes, los, ns, texts, spans = (batch.column(i) for i in range(6))
            rows, cols = [], [[], [], []]

            def out():
                take = pa.array(rows, pa.int64())
                arrays = [ids.take(take), hashes.take(take), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary())))]
                return pa.RecordBatch.from_arrays(arrays, names=["_id", "_h", "p", "n", "s"])

            for i, (lo, n, ctx, own) in enumerate(zip(los.to_pylist(), ns.to_pylist(), texts.to_pylist(), spans.to_pylist())):
                for s in own:
                    for p in range(s["lo"], s["hi"] + 1):
                        rows.append(i)
                        for c, v in zip(cols, (p, n, ctx[p - lo : p - lo + length])):
                            c.append(v)
                if len(rows) >= held:
                    yield out()
                    rows, cols = [], [[], [], []]
            if rows:
                yield out()

    return run


def _neighbours(length: int):
    """Of suffixes in order, rows (_id, _h, p, n, at, same, s): whether a neighbour in the same task is equal.

    The first and the last row of a task keep their string ``s``, since their neighbour is in another task.
    """

    def run(batches):
        at = TaskContext.get().partitionId()
        last = None  # the row before, which has yet to see its next one

        def out(rows, same, edge):
            s = [rows.column(4)[i].as_py() if e else None for i, e in enumerate(edge)] if any(edge) else [None] * len(edge)
            arrays = [*rows.columns[:4], pa.array([at] * len(edge), pa.int32()), pa.array(same), pa.array(s, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["_id", "_h", "p", "n", "at", "same", "s"])

        for batch in batches:
            if not len(batch):
                continue
            start = last is None
            rows = batch if start else pa.Table.from_batches([last[0], batch]).combine_chunks().to_batches()[0]
            text = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(-1, length)
            equal = (text[1:] == text[:-1]).all(axis=1)
            same = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
            same[0] |= not start and last[1]
            done = len(rows) - 1
            first = start or last[2]
            if done:
                yield out(rows.slice(0, done), same[:done], [first] + [False] * (done - 1))
            last = rows.slice(done), bool(same[done]), first and not done
        if last:
            yield out(last[0], np.array([last[1]]), [True])

    return run


def _in_order(suffixes: DataFrame, length: int) -> DataFrame:
    """Corpus order of ``suffixes(_id, _h, p, n, s)``: those that share ``length`` bytes with a neighbour, as (_id, _h, p, n).

    Ranges of the order are sorted in tasks of their own; equal strings are told apart by place, so that many of
    them fill many ranges. What meets across ranges is the first and last row of each.
    """
    ranges = suffixes.repartitionByRange("s", "_id", "_h", "p").sortWithinPartitions("s", "_id", "_h", "p")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema.fields[:4])
    ranges = staged(ranges.mapInArrow(_neighbours(length), schema + ", at int, same boolean, s binary"), "order")
    edges = ranges.where("s is not null").groupBy("at").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    w = Window.orderBy("at")  # a row for each range
    edges = edges.select("at", "low", "high", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))
    met = edges.where("low = before").select("at", F.col("low").alias("s")).union(edges.where("high = after").select("at", F.col("high").alias("s"))).distinct()
    across = ranges.where("s is not null and not same").join(met, ["at", "s"]).select("_id", "_h", "p", "n")
    out = staged(ranges.where("same").select("_id", "_h", "p", "n").union(across), "shared")
    release(ranges)
    return out


def _repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key ``k`` occurs at two or more places, with ``mixed``; and how often each (k, c) occurs."""
    keys = rows.groupBy("k").agg(F.sum("n").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    keys = staged(keys.where("n > 1").select("k", (F.col("c0") != F.col("c1")).alias("mixed")), "keys")
    found = staged(rows.join(keys, "k"), "repeats")
    release(keys)
    at = F.min(F.struct(*[c for c in found.columns if c not in ("k", "c", "n", "mixed")])).alias("at")
    return found, staged(found.groupBy("k", "c", "mixed").agg(F.sum("n").alias("n"), at), "entries")


def _runs(places: DataFrame, length: int) -> DataFrame:
    """Places of suffixes ``(_id, _h, p)`` as spans ``(_id, _h, start, end)``, neighbours within 32 places as one.

    A document's places are bits of whole numbers, set by tasks before the shuffle, so that a text of repeats from end to end
    has a span for each 32 bytes at least, not one for each byte.
    """
    words = places.groupBy("_id", "_h", F.floor(F.col("p") / 32).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("m"))
    # Lengths of runs of bits, from the lowest: the places where a run begins and those after which it ends.
    begins = F.expr("filter(sequence(0, 31), i -> (m & shiftleft(1L, i)) <> 0 and (i = 0 or (m & shiftleft(1L, i - 1)) = 0))")
    ends = F.expr("filter(sequence(0, 31), i -> (m & shiftleft(1L, i)) <> 0 and (i = 31 or (m & shiftleft(1L, i + 1)) = 0))")
    runs = words.select("_id", "_h", "w", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("r"))
    return runs.select("_id", "_h", (F.col("w") * 32 + F.col("r.a")).alias("start"), (F.col("w") * 32 + F.col("r.b") + length).alias("end"))


def _cut(batches):
    """Union the spans of each text and cut them out."""
    for batch in batches:
        ids, texts, spans = batch.column(0), batch.column(1), batch.column(2)
        size, runs, kept = [], [], []
        for text, own in zip(texts, spans):
            text = text.as_py() or b""
            merged: list[list[int]] = []
            if own.is_valid and len(own):
                flat = np.asarray(own.values.flatten()[0]), np.asarray(own.values.flatten()[1])
                order = np.argsort(flat[0], kind="stable")
                lo, hi = flat[0][order], np.maximum.accumulate(flat[1][order])
                first = np.concatenate(([True], lo[1:] > hi[:-1]))
                ends = hi[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(lo) - 1]))]
                merged = [[int(a), int(b)] for a, b in zip(lo[first], ends)]
            at, parts = 0, []
            for a, b in merged:
                parts.append(text[at:a])
                at = b
            parts.append(text[at:])
            size.append(len(text))
            runs.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b"".join(parts))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], names=["_id", "n_bytes", "spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, window: int = 120, block: int = 12) -> DataFrame:
    """Cut every byte that lies in a ``length``-byte string occurring at two or more places of the corpus.

    Returns ``(id, n_bytes, spans array<struct<start,end>>, kept binary)``, a row for each input row.
    Texts are their UTF-8 bytes and strings never cross rows. Null text counts as empty; a text shorter
    than ``length`` is kept whole, and one of any length is read whole, in blocks of 1 MB. Rows are told apart by (id, hash of text): repeated rows and rows with
    null or shared ids are judged as separate places and each gets its result. An empty table gives an
    empty table; columns other than the two named are ignored.
    """
    assert 0 < window <= length - GRAM + 1
    key = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).cast("binary").alias("_t"))
    kind = key.schema["_id"].dataType.simpleString()
    head, end = f"_id {kind}, _h long, ", (F.col("hi") + length).alias("end")
    phrases = staged(key.where(F.octet_length("_t") >= length).mapInArrow(_phrases(length, window), head + "lo long, hi long, a long, k long, c long"), "phrases")
    found, entries = _repeated(phrases.withColumn("n", F.lit(1).cast("long")))
    release(phrases)
    whole = found.join(entries.where("n > 1").select("k", "c"), ["k", "c"]).select("_id", "_h", F.col("lo").alias("start"), end)

    lone = entries.where("mixed").select("at.*", "n").groupBy("_id", "_h").agg(F.collect_set(F.struct("lo", "hi", "a", "n")).alias("spans"))
    reach = key.join(lone, null_safe(key, lone, "_id", "_h")).select(key["_id"], key["_h"], key["_t"], lone["spans"])
    if key.groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").head(1):  # rows that repeat id and text
        reach = reach.groupBy("_id", "_h").agg(F.first("_t").alias("_t"), F.first("spans").alias("spans")).select("_id", "_h", "_t", "spans")
    reach = staged(reach.mapInArrow(_contexts(length), head + "lo long, hi long, a long, n long, ctx binary"), "contexts")
    cuts, entries = _repeated(reach.mapInArrow(_blocks(length, block), head + "at long, lo long, hi long, n long, k long, c long"))
    blocks = cuts.where("n = 1").join(entries.where("n > 1").select("k", "c"), ["k", "c"]).select("_id", "_h", F.col("lo").alias("start"), end)

    left = cuts.where("mixed").groupBy("_id", "_h", "at").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).withColumnRenamed("at", "lo")
    left = reach.join(left, null_safe(reach, left, "_id", "_h", "lo")).select(reach["_id"], reach["_h"], reach["lo"], "n", "ctx", "spans")
    suffixes = staged(left.mapInArrow(_suffixes(length), head + "p long, n long, s binary"), "suffixes")
    shared = _in_order(suffixes, length)
    single = _runs(shared.where("n = 1").select("_id", "_h", "p"), length)
    spans = whole.union(blocks).union(single).groupBy("_id", "_h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = staged(spans, "spans")
    release(found, reach, cuts, suffixes, shared)
    out = key.join(spans, null_safe(key, spans, "_id", "_h"), "left").select(key["_id"], key["_t"], spans["spans"])
    out = out.mapInArrow(_cut, f"_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("_id", id_col)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP1_SQL = """
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(len(x) // 2 - 199)) AS p FROM x WHERE len(x) >= 400),
w AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 400)) AS h FROM p),
d AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
s AS (SELECT doc_id, k, min(p) AS s, max(p) + 200 AS e FROM r GROUP BY doc_id, k),
t AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM s GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, n_spans + 1),
lambda i: substr(x, 2 * CASE WHEN i = 0 THEN 0 ELSE es[i] END + 1, 2 * (CASE WHEN i = n_spans THEN len(x) // 2 ELSE ss[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE es[i] END))), '') END)) AS kept_sha256
FROM x LEFT JOIN t USING (doc_id)
"""
