"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Tables


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> a staged table ``(node, comp)``: comp is the smallest node reachable.

    Nodes without edges do not appear. Each round is two aggregations and two joins over at most as many
    rows as there are edges; rounds grow with the logarithm of the longest chain. The least neighbour of
    each node is staged before it is joined, so a node with very many edges can be split; a round's tables
    are deleted when the next one is written.
    """
    stage = Tables()
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        now = _state(e)
        if now == before or now[0] == 0:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = stage(_least(both).select("u", F.least("u", "m").alias("m")), "cc")
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "cc")
        m = stage(_least(large), "cc")
        joined = large.join(m, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        e = stage(small.where("u <> v").distinct(), "cc")
        stage.close(e)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    out = stage(e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots), "comp")
    stage.close(out)
    return out


def merged_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp(node, comp)`` of staged tables after the further ``links(a, b)``: only components are joined anew."""
    if not links.head(1):
        return comp
    stage = Tables()
    x, y = (comp.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}")) for n in "ab")
    short = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    more = connected_components(short)
    top = more.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    moved = comp.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    out = stage(moved.union(more.join(comp.select("node"), "node", "left_anti")), "comp")
    Tables().drop(more)
    return out
