"""Operator 10, sharding by Karmarkar-Karp differencing.

Rows of equal text are one group, which stays together. A partial partition is a tuple of shard loads; the
two with the largest spread are joined, the heaviest part of one with the lightest of the other, until one
is left. That runs in cells of a few thousand groups (groups are dealt to cells by hash, so no cell is hot),
each of which leaves one partial partition; those are joined in the same way, a few hundred at a time, level
upon level. No task and no driver sees more than one cell.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Tables, gapless_rank


def difference(loads: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over tuples: ``loads[n, k]`` -> ``labels[n, k]``, the shard of each part of each tuple."""
    n, k = loads.shape
    order = np.argsort(-loads, axis=1, kind="stable")
    tuples = {i: row for i, row in enumerate(np.take_along_axis(loads, order, 1))}
    heap = [(-float(row[0] - row[-1]), i) for i, row in tuples.items()]
    heapq.heapify(heap)
    joins = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        load = tuples.pop(a) + tuples.pop(b)[::-1]
        turn = np.argsort(-load, kind="stable")
        new = n + len(joins)
        joins.append((a, b, turn))
        tuples[new] = load = load[turn]
        heapq.heappush(heap, (-float(load[0] - load[-1]), new))
    label = {heap[0][1]: np.arange(k)} if n else {}
    for new in range(n + len(joins) - 1, n - 1, -1):
        a, b, turn = joins[new - n]
        at = np.empty(k, np.int64)
        at[turn] = label.pop(new)
        label[a], label[b] = at, at[::-1]
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = label[i]
    return out


def _cell(shards: int):
    def run(table):
        table = table.sort_by([("load", "descending"), ("key", "ascending")])
        loads = np.zeros((table.num_rows, shards))
        loads[:, 0] = np.asarray(table["load"])
        return pa.table({"key": table["key"], "cell": table["cell"], "part": pa.array(difference(loads)[:, 0].astype(np.int32))})

    return run


def _join_cells(shards: int):
    def run(table):
        cells, at = np.unique(np.asarray(table["cell"]), return_inverse=True)
        loads = np.zeros((len(cells), shards))
        loads[at, np.asarray(table["part"])] = np.asarray(table["load"])
        part = difference(loads)
        up = np.asarray(table["up"])[0]
        return pa.table(
            {"cell": pa.array(np.repeat(cells, shards)), "part": pa.array(np.tile(np.arange(shards, dtype=np.int32), len(cells))), "up": pa.array(np.full(part.size, up)), "to": pa.array(part.ravel().astype(np.int32))}
        )

    return run


def assign_groups(groups: DataFrame, shards: int, cell_rows: int = 2048, fan_in: int = 256) -> DataFrame:
    """``groups(key string, load long)`` with distinct keys -> ``(key, shard)`` with near-equal loads."""
    stage = Tables()
    cells = max(1, math.ceil(groups.count() / cell_rows))
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("long"))
    parts = stage(dealt.groupBy("cell").applyInArrow(_cell(shards), "key string, cell long, part int"), "parts")
    loads = stage(parts.join(groups, "key").groupBy("cell", "part").agg(F.sum("load").alias("load")), "loads")
    while cells > 1:
        cells = math.ceil(cells / fan_in)
        step = loads.withColumn("up", F.floor(F.col("cell") / fan_in).cast("long")).groupBy("up").applyInArrow(_join_cells(shards), "cell long, part int, up long, to int")
        step = stage(step, "step")
        parts = stage(parts.join(step, ["cell", "part"]).select("key", F.col("up").alias("cell"), F.col("to").alias("part")), "parts")
        loads = stage(loads.join(step, ["cell", "part"]).groupBy(F.col("up").alias("cell"), F.col("to").alias("part")).agg(F.sum("load").alias("load")), "loads")
        stage.close(parts, loads)
    return parts.select("key", F.col("part").alias("shard"))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, levels: list[Column] | None = None, order: Column | None = None) -> DataFrame:
    """Deal all rows to ``shards`` shards of near-equal bytes, rows of equal text together.

    Returns ``(id, size, text_crc32, shard, slot)`` with a row for each input row: size is the UTF-8 length
    plus ``overhead``, slot counts from 0 without gaps within a shard. Slots follow ``order`` (default: md5
    of the id), of which ``levels`` are leading parts (neither holds nulls); rows that tie take any of their slots. A null
    text counts as empty and is grouped with empty texts. Repeated rows are rows of one group; ids may be
    null. Texts of any length count whole. A group larger than an even share fills a shard alone. An empty table gives an empty table; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    stage, order = Tables(), md5 if order is None else order
    levels = levels or [F.substring(md5, 1, 2), F.substring(md5, 3, 2)]
    names = [f"_l{i}" for i in range(len(levels))]
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("key"),
        *[c.alias(n) for c, n in zip(levels, names)],
        order.alias("_s"),
    )
    rows = stage(rows, "rows")
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("load")), "groups")
    placed = stage(rows.join(stage(assign_groups(groups, shards), "placed"), "key").drop("key"), "dealt")
    out = gapless_rank(placed, "shard", names, "_s", "slot")
    stage.close(placed)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def with_law(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of a shard table in the order that its readers expect; under the law of bytes no shard is grown."""
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_law(shard(spark.read.parquet(f"{sf_dir}/documents.parquet")))
