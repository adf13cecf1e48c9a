"""Operator 6, n-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Sets are sorted arrays of 64-bit shingle hashes. Sizes fall into bands such that linked sets lie in the
same or in neighbouring bands; a pair is judged in the band of the larger set, and a set visits its own
band and the next. Within a band, linked sets differ in at most H elements, so when the hash range is cut
into H + 1 + E parts at least E + 1 parts of both sets are equal. A tile is (band, part, content of the
part): every linked pair shares a tile whose part isn't empty (a set with more than E empty parts also visits
the tiles of those; E follows from the sizes of the band, so that such sets are rare at any threshold). Tiles
are therefore exact, need no corpus-wide frequencies, and unrelated sets rarely meet.

Candidates from the tiles pass a size bound, then a bitmap bound: each set has a hashed bitmap, and every
bit set in one bitmap but not in the other is an element that isn't shared, which bounds the overlap from
above. What remains is decided by intersecting the sorted arrays.

Equal sets are one class. To lose no link and yet not write out all pairs of a large group, candidates are
judged in rounds. The leader of a tile is the class that meets most others over all its tiles, e.g. the
original of many near copies. First each class is compared with the leader it shares most tiles with, then
with all its leaders of other components. At last all pairs of different components are compared that share
a tile: in small tiles by a join, in large ones block by block, where only pairs that pass the bounds leave
the task, nearly always from one tile that both name.

Texts are read from the input where pairs are decided, in portions of the pairs, so that no copy of the texts is written
and what a portion shuffles is bounded, however many pairs there are.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Tables, null_safe
from .components import connected_components, merged_components

BITS = 1024
#: Tiles of up to SMALL classes are compared by a join, larger ones in blocks of about BLOCK classes.
SMALL, BLOCK = 32, 512
#: Tiles that a class names to each of its tiles, so that a pair comes out of one tile only.
NAMED = 16
#: Text bytes whose visits one task sorts. A word and a blank take two bytes and a set visits two bands, of a fifth of
#: its size in tiles each at 80 percent, so that visits of 16 bytes take at most three times as much; a seventh is usual.
TASK_BYTES = 64 << 20
#: Pairs are decided in portions whose texts are at most half of all texts, or so many bytes if that is more, and of at most
#: so many pairs, as these are broadcast.
PORTION_BYTES, PORTION_PAIRS = 256 << 20, 100_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    """Hashes of words seen so far in this task; emptied when it gets large, which changes no hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, cache: _Words, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of ``text`` (fewer words: the whole sequence)."""
    words = (text or b"").lower().split()  # A-Z and the six ASCII blanks, as bytes know them
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = _mix(out * _A + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def bands(num: int, den: int, top: int = 1 << 40) -> list[int]:
    """First sizes of the bands: sets that can link lie in the same or in neighbouring ones."""
    out = [1]
    while out[-1] < top:
        out.append(-(-out[-1] * den // num))
        out[-1] = max(out[-1], out[-2] + 1)
    return out


@lru_cache(maxsize=None)
def _spare(least: int, most: int) -> int:
    """E of a band whose sets hold ``least`` elements or more: above it by three deviations lies what chance leaves empty."""
    for spare in range(1, most + 1):
        empty = (most + 1 + spare) * np.exp(-least / (most + 1 + spare))
        if empty + 3 * np.sqrt(empty) <= spare:
            return spare
    return most + 1


def tiles(s: np.ndarray, starts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the tiles that the set ``s`` visits."""
    k0 = int(np.searchsorted(starts, len(s), "right")) - 1
    out = []
    with np.errstate(over="ignore"):
        mixed = _mix(s * _C + _A)
        for k in (k0, k0 + 1):
            if len(s) * den < num * int(starts[k]) and k > k0:
                continue
            most = 2 * (int(starts[k + 1]) - 1) * (den - num) // (den + num)
            if not most:
                continue  # only equal sets link
            spare = _spare(int(starts[k]) * num // den, most)
            m = most + 1 + spare
            part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            key = np.add.reduceat(mixed, first)
            part = part[first]
            if m - len(part) > spare:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part, assume_unique=True)
                part, key = np.concatenate((part, empty)), np.concatenate((key, np.zeros(len(empty), np.uint64)))
            out.append(_mix(_mix(key + np.uint64(k)) * _A + part))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


#: A task deals out its visits to tiles whenever it holds so many.
VISITS = 1_000_000
_ROW = ["part", "_id", "_h", "n", "bytes", "node", "bits", "tile", "ones", "firsts"]


def _signatures(n: int, num: int, den: int, parts: int):
    """Rows of two or three kinds, each with the partition where it goes.

    A signature (_id, _h, n, bytes, node, bits) for each text; visits (tile, node) to tiles that two sets of this
    task share; and for each partition one row of the tiles that it is to judge, packed: ``ones`` holds tiles
    and nodes of single visits, ``firsts`` the tiles already known to be shared. Packed visits take 16 bytes
    each, and a tile goes out once from a task however many sets there visit it.
    """

    def run(batches):
        cache, starts = _Words(), np.array(bands(num, den), np.int64)
        held, nodes, keys = 0, [], []

        def row(count: int, **columns):
            kinds = {"part": pa.int32(), "n": pa.int64(), "bytes": pa.int64(), "node": pa.int64(), "_h": pa.int64(), "bits": pa.list_(pa.int64()), "tile": pa.int64(), "ones": pa.binary(), "firsts": pa.binary(), "_id": kind}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(count, kinds[c]) for c in _ROW], names=_ROW)

        def dealt():
            tile = np.concatenate(keys)
            node = np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
            order = np.argsort(tile, kind="stable")
            tile, node = tile[order], node[order]
            new = np.concatenate(([True], tile[1:] != tile[:-1]))
            alone = new & np.concatenate((new[1:], [True]))
            some = np.flatnonzero(~alone)
            to = (tile.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            if len(some):
                yield row(len(some), part=pa.array((np.arange(len(some)) % parts).astype(np.int32)), node=pa.array(node[some]), tile=pa.array(tile[some]))
            firsts, ones = np.flatnonzero(new & ~alone), np.flatnonzero(alone)
            firsts, ones = firsts[np.argsort(to[firsts], kind="stable")], ones[np.argsort(to[ones], kind="stable")]
            at = np.arange(parts + 1)
            f, o = np.searchsorted(to[firsts], at), np.searchsorted(to[ones], at)
            used = np.flatnonzero((f[1:] > f[:-1]) | (o[1:] > o[:-1]))
            for lo in range(0, len(used), 256):
                now = used[lo : lo + 256]
                ones_ = [tile[ones[o[i] : o[i + 1]]].tobytes() + node[ones[o[i] : o[i + 1]]].tobytes() for i in now]
                yield row(len(now), part=pa.array(now.astype(np.int32)), ones=pa.array(ones_, pa.binary()), firsts=pa.array([tile[firsts[f[i] : f[i + 1]]].tobytes() for i in now], pa.binary()))

        seen: set[int] = set()
        for batch in batches:
            kind, sizes, sets, bits = batch.schema.field(0).type, [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), cache, n)
                sizes.append(len(s))
                bits.append(_bitmap(s))
                x = xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else None
                sets.append(None if x is None else x - (1 << 64) if x >> 63 else x)
                if x is not None and sets[-1] not in seen:
                    seen.add(sets[-1])
                    nodes.append(sets[-1])
                    keys.append(tiles(s, starts, num, den))
                    held += len(keys[-1])
                    if held > VISITS:
                        yield from dealt()
                        held, nodes, keys = 0, [], []
                        seen.clear()
            part = pa.array((np.arange(batch.num_rows) % parts).astype(np.int32))
            yield row(batch.num_rows, part=part, _id=batch.column(0), _h=batch.column(1), n=pa.array(sizes, pa.int64()), bytes=pa.compute.binary_length(batch.column(2)).cast(pa.int64()), node=pa.array(sets, pa.int64()), bits=pa.array(bits, pa.list_(pa.int64())))
        if held:
            yield from dealt()

    return run


def _shared(batches):
    """Pass signatures and visits on; of the packed visits of this partition keep those to shared tiles."""
    names = [c for c in _ROW[1:] if c not in ("ones", "firsts")]
    tile, node, known, last = [], [], [], None
    for batch in batches:
        last = batch
        plain = batch.filter(batch.column(_ROW.index("node")).is_valid())
        nothing = batch.filter(pa.compute.and_(batch.column(_ROW.index("n")).is_valid(), batch.column(_ROW.index("node")).is_null()))
        for rows in (plain, nothing):
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column(_ROW.index(c)) for c in names], names=names)
        for ones, firsts in zip(batch.column(_ROW.index("ones")), batch.column(_ROW.index("firsts"))):
            if ones.is_valid:
                own = np.frombuffer(ones.as_buffer(), np.int64)
                tile.append(own[: len(own) // 2].copy())
                node.append(own[len(own) // 2 :].copy())
                known.append(np.frombuffer(firsts.as_buffer(), np.int64).copy())
    if not tile:
        return
    t, x, k = np.concatenate(tile), np.concatenate(node), np.unique(np.concatenate(known))
    order = np.lexsort((x, t))
    t, x = t[order], x[order]
    new = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((new, [len(t)])))
    several = x[new] != x[new + size - 1]
    if len(k):
        at = np.minimum(np.searchsorted(k, t[new]), len(k) - 1)
        several |= k[at] == t[new]
    keep = np.flatnonzero(np.repeat(several, size))
    for lo in range(0, len(keep), 100_000):
        i = keep[lo : lo + 100_000]
        columns = {"tile": pa.array(t[i]), "node": pa.array(x[i])}
        yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(len(i), last.column(_ROW.index(c)).type) for c in names], names=names)


def _bitmap(s: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, np.uint8)
    out[(s & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def _decide(n: int, num: int, den: int):
    """Keep the pairs whose sets link, by intersecting the sorted arrays; rows (a, b, node, t) of a pair come together."""

    def run(batches):
        cache, pair, sets = _Words(), None, {}
        for batch in batches:
            a, b, node = (batch.column(i).to_pylist() for i in range(3))
            keep = []
            for i, text in enumerate(batch.column(3)):
                if pair != (a[i], b[i]):
                    pair, open_ = (a[i], b[i]), {a[i], b[i]}
                    sets = {k: v for k, v in sets.items() if k in open_}  # the next pair often has one of the last
                if node[i] not in open_:
                    continue  # the same id and text in several rows
                open_.discard(node[i])
                if node[i] not in sets:
                    sets[node[i]] = shingles(text.as_py(), cache, n)
                if not open_:
                    x, y = sets[a[i]], sets[b[i]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * den >= num * (len(x) + len(y) - both):
                        keep.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keep], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return run


def _across(num: int, den: int):
    """Pairs of a block pair of one tile that are of different components and pass both bounds.

    Each class comes with the least NAMED of its large tiles. A pair that has some of these in common comes from the
    least of those alone, where it meets too; other pairs, whose sets of tiles differ much, from each tile they share.
    """

    def run(key, table):
        tile, own = key[0].as_py(), table["least"].combine_chunks()
        starts, listed = np.asarray(own.offsets), np.asarray(own.values)
        sets: dict[int, set[int]] = {}

        def least(i: int) -> set[int]:
            if i not in sets:
                sets[i] = set(listed[starts[i] : starts[i + 1]].tolist())
            return sets[i]

        node, n, comp = (np.asarray(table[c]) for c in ("node", "n", "comp"))
        bits = np.asarray(table["bits"].combine_chunks().flatten()).reshape(len(node), -1).view(np.uint64)
        other = np.asarray(table["other"])
        left = np.flatnonzero(~other)
        right = left if key[1] == key[2] else np.flatnonzero(other)
        out = [np.empty((0, 2), np.int64)]
        for i in left:
            js = right[(comp[right] != comp[i]) & (np.minimum(n[right], n[i]) * den >= np.maximum(n[right], n[i]) * num)]
            less = np.bitwise_count(bits[i] & ~bits[js]).sum(1, dtype=np.int64), np.bitwise_count(bits[js] & ~bits[i]).sum(1, dtype=np.int64)
            most = np.minimum(n[i] - less[0], n[js] - less[1])
            js = js[most * (den + num) >= (n[i] + n[js]) * num]
            js = js[[min(least(i) & least(j), default=tile) == tile for j in js.tolist()]] if len(js) else js
            out.append(np.column_stack((np.minimum(node[i], node[js]), np.maximum(node[i], node[js]))))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})

    return run


def _unshared(x: str, y: str) -> Column:
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v)")


def _bounded(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Drop the pairs (a, b) that size or bitmaps show to be apart."""
    x = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    y = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    both = pairs.join(x, "a").join(y, "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    most = F.least(F.col("na") - _unshared("ba", "bb"), F.col("nb") - _unshared("bb", "ba"))
    return both.where(most * (den + num) >= (F.col("na") + F.col("nb")) * num).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, keep_group: bool = False) -> DataFrame:
    """Group the documents whose shingle sets link, directly or through others.

    Words are runs of bytes other than the six ASCII blanks, A-Z lower-cased; a set holds the distinct
    ``shingle``-word shingles of the whole text (with fewer words the sequence itself). Two sets link when
    100 * |intersection| >= ``percent`` * |union|. Returns ``(id, _h, n_shingles, component_id)`` with a row
    for each input row; ``_h`` is xxhash64 of the text, with which the id tells rows apart, and
    ``component_id`` is the least id of the component. Null, empty and blank texts have no set and stand
    alone. Repeated rows, rows with a null id and rows that share an id keep a row each; null ids count as
    greater than all others. An empty table gives an empty table; other columns are ignored.
    Texts of any length are read whole. Sets and shingles are known by 64-bit hashes. ``keep_group`` adds ``_group``, which names the component
    whatever its ids (null where there is no set). ``docs`` is read once more for each portion of pairs.
    """
    num, den, stage = percent, 100, Tables()
    key = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).cast("binary").alias("_t"))
    kind = key.schema["_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    row = f"_id {kind}, _h long, n long, bytes long, node long, bits array<long>, tile long"
    dealt = key.mapInArrow(_signatures(shingle, num, den, parts), f"part int, {row}, ones binary, firsts binary").repartitionById(parts, "part")
    found = stage(dealt.mapInArrow(_shared, row), "signatures")
    sig = stage(found.where("tile is null").select("_id", "_h", "n", "node"), "named")
    classes = found.where("tile is null and node is not null").groupBy("node", "n").agg(F.min(F.struct("_id", "_h", "bits", "bytes")).alias("m"))
    classes = stage(classes.select("node", "n", "m._id", "m._h", "m.bits", "m.bytes"), "classes")

    visits = stage(found.where("tile is not null").select("tile", "node").distinct(), "visits")
    stage.drop(found)
    widths = stage(visits.groupBy("tile").agg(F.count(F.lit(1)).alias("width")), "widths")
    known = stage(visits.join(widths, "tile").groupBy("node").agg(F.sum("width").alias("known")).join(classes.select("node", "n"), "node"), "known")
    met = stage(visits.join(widths, "tile").join(known, "node"), "met")
    stage.drop(visits, widths, known)

    def decided(pairs: DataFrame) -> DataFrame:
        near = stage(_bounded(pairs, classes, num, den), "pairs")
        stage.drop(pairs)
        place = classes.select("node", F.struct("node", "_id", "_h").alias("at"), "bytes")
        x, y = (place.select(F.col("node").alias(c), F.col("at").alias(f"at{c}"), F.col("bytes").alias(f"bytes{c}")) for c in "ab")
        sides = stage(near.join(x, "a").join(y, "b").select("a", "b", "ata", "atb", (F.col("bytesa") + F.col("bytesb")).alias("bytes")), "sides")
        stage.drop(near)
        count, total = sides.agg(F.count(F.lit(1)), F.sum("bytes")).first()
        portions, links = max(1, -(-(total or 0) // max(PORTION_BYTES, size // 2)), -(-count // PORTION_PAIRS)), []
        for p in range(portions):
            mine = sides.where(F.pmod(F.xxhash64("a", "b"), F.lit(portions)) == p).select("a", "b", F.explode(F.array("ata", "atb")).alias("at"))
            mine = F.broadcast(mine.select("a", "b", "at.node", "at._id", "at._h"))
            texts = key.join(mine, null_safe(key, mine, "_id", "_h")).select("a", "b", "node", "_t")
            texts = texts.repartition("a", "b").sortWithinPartitions("b", "a")
            links.append(stage(texts.mapInArrow(_decide(shingle, num, den), "a long, b long"), "links"))
        stage.drop(sides)
        return reduce(DataFrame.union, links)

    def led(rows: DataFrame, one: bool = False) -> DataFrame:
        """Pairs of a class and the leader of a tile, of different components: all, or that which shares most tiles."""
        leader = rows.groupBy("tile").agg(F.max_by(F.struct("node", "comp"), F.struct("known", -F.col("node"))).alias("l"))
        leader = stage(leader, "leaders")
        pairs = rows.join(leader, "tile").where(F.col("comp") != F.col("l.comp"))
        pairs = pairs.groupBy(F.col("node").alias("a"), F.col("l.node").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b")) if one else pairs.select("a", "b")
        pairs = stage(pairs, "pairs")
        stage.drop(leader)
        return pairs

    def unsettled(rows: DataFrame, comp: DataFrame) -> DataFrame:
        """Those of ``rows`` that are of tiles which hold more than one component; they take the place of ``rows``."""
        here = rows.drop("comp").join(comp.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("_n")
        here = stage(here, "here")
        stage.drop(rows)
        several = here.groupBy("tile").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("tile")
        several = stage(several, "several")
        out = stage(here.join(several, "tile"), "unsettled")
        stage.drop(here, several)
        return out

    comp = stage.hold(connected_components(decided(led(met.withColumn("comp", F.col("node")), one=True))))

    here = unsettled(met, comp)
    comp = stage.hold(merged_components(comp, decided(led(here))))

    here = unsettled(here, comp)
    small = here.where(F.col("width") <= SMALL)
    x = small.select("tile", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    y = small.select("tile", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    rest = x.join(y, "tile").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    large = here.where(F.col("width") > SMALL)
    named = large.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("tile")), 1, NAMED).alias("least"))
    named = stage(named.join(classes.select("node", "bits"), "node"), "named")
    large = large.join(named, "node")
    large = large.withColumn("blocks", F.ceil(F.col("width") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = large.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("bi"), F.greatest("mine", o).alias("bj")))))
    large = large.select("tile", "pair.bi", "pair.bj", "node", "n", "comp", "bits", "least", (F.col("mine") != F.col("pair.bi")).alias("other"))
    rest = rest.select("a", "b").union(large.groupBy("tile", "bi", "bj").applyInArrow(_across(num, den), "a long, b long")).distinct()
    rest = stage(rest, "pairs")
    stage.drop(here, named)
    comp = stage.hold(merged_components(comp, decided(rest)))

    named = sig.join(comp.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    named = stage(named.select("_id", "_h", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("comp")), "named")
    least = stage(named.where("comp is not null").groupBy("comp").agg(F.min("_id").alias("component_id")), "least")
    stage.close(named, least)
    out = named.join(least, "comp", "left").select("_id", "_h", "n_shingles", F.when(F.col("comp").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"), *(["comp"] if keep_group else []))
    return out.withColumnsRenamed({"_id": id_col, "comp": "_group"})


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_h")


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id
"""
