"""Operator 4, embedding near-dedup with a random-projection tree forest.

Vectors are compared within (label, number of components) only. Each tree splits the unit vectors again and
again at a quantile of a random direction; vectors within the spill of a cut go to both sides. Of a few
directions and quantiles a node takes that with the fewest vectors in its spill. Trees grow by rounds of a
few levels: each cell that is still too large sends a bounded sample of its vectors to one task, which fits
the next levels for that cell alone, and then all vectors of the cell are routed. So cuts fit the cell however
deep it lies, nothing is fitted on the driver, and no task holds a cell.

Depth and number of trees follow from the size of the label. Two unit vectors at the threshold differ along a
random direction by a normal deviate of variance 2 * (1 - threshold) / components; the spill is ``reach`` of
its standard deviations. In the worst case, a cluster whose vectors all lie at the threshold from each other,
a level parts such a pair with a probability that depends on ``reach`` alone, and there are as many trees as
keep the chance that all of them part it below ``miss``.

Equal vectors of a label are one class with a multiplicity, so copies cost nothing. A task compares up to
``block`` classes, all with all, so cells of no more are leaves. Larger leaves, e.g. clusters too tight to be
split, are compared block by block in separate tasks. A pair
met in several leaves counts in the first leaf that both visit (each row carries its list of leaves), so links
are counted exactly without writing out pairs; only a spanning forest of each block pair leaves the task.

Visits carry their vectors and are more than the vectors, by the number of trees and by the spill of each level. So they
are grown, compared and deleted in portions, one after the other: some trees, or of one tree the cells below its first
levels that a hash picks. What stays of a portion are the leaves of each vector, links and edges.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Tables
from .components import connected_components

SEED, CANDIDATES, QUANTILES = 11, 4, (0.4, 0.5, 0.6)
CELL = ["label", "dim", "tree", "path"]
#: Models of more cells than this are joined by sorting, so that the vectors of a cell come together.
FEW_CELLS = 256
#: A portion has about half as many bytes of visits as all vectors have, or so many if that is more.
PORTION_BYTES = 256 << 20
#: Visits of a level to those of the level above, as reckoned for portions; 1.2 is usual.
GROWTH = 1.25


def _unit(column, rows: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of the given rows of a list column, all of ``dim`` components, as unit vectors."""
    values, starts = np.asarray(column.values), np.asarray(column.offsets)[:-1]
    x = values[starts[rows][:, None] + np.arange(dim)].astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def parting(reach: float) -> float:
    """Chance that one level parts a pair at the threshold, in the worst case."""
    y = 2 * reach
    density, beyond = math.exp(-y * y / 2) / math.sqrt(2 * math.pi), math.erfc(y / math.sqrt(2)) / 2
    return 2 * (density - y * beyond) * math.sqrt(2) / math.sqrt(2 * math.pi)


def direction(tree: int, path: int, candidate: int, dim: int) -> np.ndarray:
    v = np.random.default_rng([SEED, tree, path, candidate]).standard_normal(dim)
    return v / np.linalg.norm(v)


def fit_levels(x: np.ndarray, size: int, tree: int, path: int, spill: float, leaf: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate and cut of each node below ``path``, from a sample ``x`` of its ``size`` vectors.

    A candidate of -1 ends the branch for now or because it is small enough, -2 because no cut splits it well.
    """
    nodes = (1 << levels) - 1
    chosen, cuts, at = np.full(nodes, -1, np.int8), np.zeros(nodes), {0: np.arange(len(x))}
    for node in range(nodes):
        rows = at.pop(node, None)
        if rows is None or len(rows) * size <= leaf * len(x):
            continue
        depth = (node + 1).bit_length() - 1
        here, best = (path << depth) + node + 1 - (1 << depth), (0.5, -2, 0.0)
        for c in range(CANDIDATES):
            shadow = x[rows] @ direction(tree, here, c, x.shape[1])
            for cut in np.quantile(shadow, QUANTILES):
                share = float((np.abs(shadow - cut) <= spill).mean())
                if share < best[0]:
                    best = (share, c, float(cut))
        chosen[node], cuts[node] = best[1], best[2]
        if best[1] >= 0:
            gap = x[rows] @ direction(tree, here, best[1], x.shape[1]) - best[2]
            at[2 * node + 1], at[2 * node + 2] = rows[gap <= spill], rows[gap > -spill]
    return chosen, cuts


def route(x: np.ndarray, tree: int, path: int, spill: float, chosen: np.ndarray, cuts: np.ndarray) -> list[tuple[np.ndarray, int, bool]]:
    """Where the vectors go: for each end of a branch its rows, its path, and whether it is never to be split."""
    out, at = [], [(0, np.arange(len(x)))]
    while at:
        node, rows = at.pop()
        depth = (node + 1).bit_length() - 1
        here = (path << depth) + node + 1 - (1 << depth)
        if node >= len(chosen) or chosen[node] < 0:
            out.append((rows, here, node < len(chosen) and chosen[node] == -2))
            continue
        gap = x[rows] @ direction(tree, here, int(chosen[node]), x.shape[1]) - cuts[node]
        for child, side in ((2 * node + 1, gap <= spill), (2 * node + 2, gap > -spill)):
            if side.any():
                at.append((child, rows[side]))
    return out


def _spill(threshold: float, dim: int, reach: float) -> float:
    return reach * math.sqrt(2 * (1 - threshold) / dim)


def _fit(threshold: float, reach: float, leaf: int, levels: int):
    def run(key, table):
        dim, tree, path = (k.as_py() for k in key[1:])
        x = _unit(table["v"].combine_chunks(), np.arange(table.num_rows), dim)
        chosen, cuts = fit_levels(x, table["size"][0].as_py(), tree, path, _spill(threshold, dim, reach), leaf, levels)
        return pa.table({"label": table["label"].slice(0, 1), "dim": pa.array([dim], pa.int32()), "tree": pa.array([tree], pa.int32()), "path": pa.array([path]), "chosen": pa.array([chosen.tobytes()], pa.binary()), "cuts": pa.array([cuts.tobytes()], pa.binary())})

    return run


def _route(threshold: float, reach: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            label, dim, tree, path, node, copies, v, last, chosen, cuts, cell = (batch.column(batch.schema.get_field_index(c)) for c in ("label", "dim", "tree", "path", "node", "copies", "v", "last", "chosen", "cuts", "cell"))
            _, first, of = np.unique(np.asarray(cell), return_index=True, return_inverse=True)
            order = np.argsort(of, kind="stable")
            groups = np.split(order, np.searchsorted(of[order], np.arange(1, len(first))))
            take, paths, ends = [], [], []
            for f, rows in zip(first.tolist(), groups):
                d, t = dim[f].as_py(), tree[f].as_py()
                to = route(_unit(v, rows, d), t, path[f].as_py(), _spill(threshold, d, reach), np.frombuffer(chosen[f].as_buffer(), np.int8), np.frombuffer(cuts[f].as_buffer()))
                for own, p, end in to:
                    take.append(rows[own])
                    paths.append(np.full(len(own), p))
                    ends.append(np.full(len(own), end))
            take, paths, ends = pa.array(np.concatenate(take)), np.concatenate(paths), np.concatenate(ends)
            yield pa.RecordBatch.from_arrays([label.take(take), dim.take(take), tree.take(take), pa.array(paths), node.take(take), copies.take(take), v.take(take), last.take(take), pa.array(ends)], names=[*CELL, "node", "copies", "v", "last", "ended"])

    return run


def _large(visits: DataFrame, leaf: int) -> DataFrame:
    """The cells that are to be split, with their sizes."""
    depth = F.floor(F.log2(F.col("path").cast("double")))
    sizes = visits.groupBy(*CELL).agg(F.count(F.lit(1)).alias("size"), F.max("last").alias("last"), F.max("ended").alias("ended"))
    return sizes.where(~F.col("ended") & (F.col("size") > 1.5 * leaf) & (depth < F.col("last"))).select(*CELL, "size")


def _fitted(visits: DataFrame, more: DataFrame, threshold: float, reach: float, leaf: int, fit_rows: int, levels: int) -> DataFrame:
    """The next levels of the cells ``more``, each fitted to a sample of its visits."""
    kind = visits.schema["label"].dataType.simpleString()
    chance = F.pmod(F.xxhash64("node", "tree", "path"), F.lit(1 << 30)) / float(1 << 30)
    sample = visits.join(more, CELL).where(chance < F.lit(float(fit_rows)) / F.col("size")).select(*CELL, "size", "v")
    return sample.groupBy(*CELL).applyInArrow(_fit(threshold, reach, leaf, levels), f"label {kind}, dim int, tree int, path long, chosen binary, cuts binary")


def _routed(visits: DataFrame, model: DataFrame, cells: int, threshold: float, reach: float) -> DataFrame:
    """The visits of the ``cells`` cells of ``model``, at the ends of its branches."""
    kind, v = (visits.schema[c].dataType.simpleString() for c in ("label", "v"))
    rows = visits.drop("ended").join(model.hint("merge") if cells > FEW_CELLS else model, CELL).withColumn("cell", F.xxhash64(*CELL))
    return rows.mapInArrow(_route(threshold, reach), f"label {kind}, dim int, tree int, path long, node long, copies long, v {v}, last int, ended boolean")


def _grown(visits: DataFrame, stage: Tables, threshold: float, reach: float, leaf: int, fit_rows: int, levels: int) -> DataFrame:
    """Route ``visits(label, dim, tree, path, node, copies, v, last, ended)`` down to leaves; ``last`` is the depth allowed."""
    columns, done = [*CELL, "node", "copies", "v"], []
    while True:
        more = stage(_large(visits, leaf), "cells")
        cells = more.count()
        if not cells:
            return reduce(DataFrame.union, [d.select(*columns) for d in [*done, visits]])
        done.append(stage(visits.join(more, CELL, "left_anti").select(*columns), "done"))
        model = stage(_fitted(visits, more, threshold, reach, leaf, fit_rows, levels), "model")
        before, visits = visits, stage(_routed(visits, model, cells, threshold, reach), "visits")
        stage.drop(model, more, *(t for t in stage.held if t is before))  # the visits of one round are held, not of all


def _earlier(leaf: int, offsets: np.ndarray, leaves: np.ndarray, some: np.ndarray) -> np.ndarray:
    """For each pair of the rows ``some`` whether they also share a leaf before ``leaf``; row ``i`` has the leaves between its offsets."""
    sizes = offsets[some + 1] - offsets[some]
    row = np.repeat(np.arange(len(some)), sizes)
    own = leaves[np.repeat(offsets[some] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(row))]
    row, own = row[own < leaf], own[own < leaf]
    order = np.argsort(own, kind="stable")
    row, own = row[order], own[order]
    out = np.zeros((len(some), len(some)), bool)
    for rows in np.split(row, np.flatnonzero(own[1:] != own[:-1]) + 1):
        if len(rows) > 1:
            out[np.ix_(rows, rows)] = True
    return out


def _judged(leaf: int, x: np.ndarray, side: np.ndarray, same: bool, node: np.ndarray, copies: np.ndarray, offsets: np.ndarray, leaves: np.ndarray, threshold: float):
    """Nodes and links of one leaf or block pair, and the edges of a spanning forest."""
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    if not same:
        close &= side[:, None] != side[None, :]
    some = np.flatnonzero(close.any(axis=1))
    if not len(some):
        return None
    close = close[np.ix_(some, some)] & ~_earlier(leaf, offsets, leaves, some)
    left = np.flatnonzero(close.any(axis=1))
    if not len(left):
        return None
    some, close = some[left], close[np.ix_(left, left)]
    node, links, comp = node[some], close @ copies[some], np.arange(len(some))
    while True:
        least = np.minimum(comp, np.where(close, comp[None, :], len(some)).min(axis=1))
        if (least == comp).all():
            break
        comp = least
    return node, links, node[comp]


def _compare(threshold: float):
    """Rows sorted by leaf and block pair -> (node, links, other): link counts, and edges of a spanning forest."""

    def judged(table):
        key, dim, bi, bj = (np.asarray(table[c]) for c in ("key", "dim", "bi", "bj"))
        node, copies, leaf, side = (np.asarray(table[c]) for c in ("node", "copies", "leaf", "side"))
        v, own = table["v"].combine_chunks(), table["leaves"].combine_chunks()
        offsets, leaves = np.asarray(own.offsets), np.asarray(own.values)
        new = (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        bounds = np.concatenate(([0], np.flatnonzero(new) + 1, [len(key)])).tolist()
        out = []
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                x = _unit(v, np.arange(a, b), int(dim[a]))
                out.append(_judged(int(leaf[a]), x, side[a:b], bi[a] == bj[a], node[a:b], copies[a:b], offsets[a : b + 1], leaves, threshold))
        out = [o for o in out if o]
        if out:
            n, links, other = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(links.astype(np.int64)), pa.array(other)], names=["node", "links", "other"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            last = [held[c][-1] for c in ("key", "bi", "bj")]
            more = np.logical_or.reduce([np.asarray(held[c]) != x.as_py() for c, x in zip(("key", "bi", "bj"), last)])
            cut = int(np.flatnonzero(more)[-1]) + 1 if more.any() else 0  # the last leaf may go on
            if cut:
                yield from judged(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None:
            yield from judged(held.combine_chunks())

    return run


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    leaf: int = 32,
    reach: float = 0.64,
    miss: float = 0.005,
    trees: int | None = None,
    block: int = 1024,
    fit_rows: int = 1024,
    levels: int = 4,
) -> DataFrame:
    """Link vectors of equal label and length whose cosine is at least ``threshold``, as far as they share a leaf.

    Returns ``(id, n_links, component_id)`` for each row. Vectors that are null, empty or zero, that hold null or
    non-finite components, and rows with a null label or id, link with nothing; such a row has itself as
    component. Equal vectors always link; rows that repeat an id count as further copies. An empty table gives
    an empty table; other columns are ignored. Cells are split down to ``leaf`` classes, or two thirds of ``block`` if that
    is more; a label of no more than 1.5 times that is compared whole. The number of trees is that for leaves of ``leaf``
    classes, so larger leaves only find more. ``reach`` is the spill and ``miss`` the chance, in the worst case, that a pair at
    the threshold shares no leaf; ``trees`` sets their number instead. ``fit_rows`` vectors of a cell fit its
    next ``levels`` levels. Classes are known by a 64-bit hash of label and vector.
    """
    stage = Tables()
    t = rows.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    wide = F.col("v").cast("array<double>")
    good = F.col("_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    good = good & ~F.exists(wide, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(wide, lambda e: e != 0)
    t = t.select("_id", "v", "label", F.coalesce(good, F.lit(False)).alias("good")).withColumn("node", F.xxhash64("label", "v"))
    if t.schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        t = t.withColumn("v", wide)
    classes = t.where("good").groupBy("label", "node").agg(F.min("v").alias("v"), F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("dim", F.size("v").cast("int")), "classes")
    groups, stop = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), max(leaf, 2 * block // 3)
    groups = groups.withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / float(leaf)))).cast("int"))
    needed: Column = F.lit(trees) if trees else F.ceil(math.log(miss) / F.log(1 - F.pow(F.lit(1 - parting(reach)), F.col("depth"))))
    groups = stage(groups.withColumn("trees", F.when(F.col("n") > 1.5 * stop, F.greatest(F.lit(2), needed)).otherwise(1).cast("int")), "groups")
    start = classes.join(groups, ["label", "dim"]).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    last = F.when(F.col("depth") > 0, F.col("depth") + 3).otherwise(0).cast("int").alias("last")
    start = start.select("label", "dim", "tree", F.lit(1).cast("long").alias("path"), "node", "copies", "v", last, F.lit(False).alias("ended"))

    vector = F.col("dim") * (4 if t.schema["v"].dataType.simpleString() == "array<float>" else 8)
    grown = F.pow(F.lit(GROWTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / float(stop)))))
    every = groups.agg(F.max("trees"), F.sum(F.col("n") * vector), F.sum(F.col("n") * F.col("trees") * grown * (vector + 16 * F.col("trees") + 48))).first()
    most, raw, total = every[0] or 1, every[1] or 0, every[2] or 0
    portions = max(1, math.ceil(total / max(PORTION_BYTES, raw // 2)))
    splits = -(-portions // most)  # portions of a tree
    cells = 0
    if splits > 1:
        portions = most * splits
        more = stage(_large(start, stop), "cells")
        cells = more.count()
        model = stage(_fitted(start, more, threshold, reach, stop, fit_rows, levels), "model")
    mets, seen = [], []
    for p in range(portions):
        part, split = Tables(), p % splits
        first, end = (-(-x * most * splits // portions) for x in (p, p + 1))  # of tree * splits + split
        visits = start.where(F.col("tree").between(first // splits, (end - 1) // splits))
        if splits > 1:
            whole = visits.join(more, CELL, "left_anti").select(*visits.columns)
            visits = whole.union(_routed(visits, model, cells, threshold, reach)) if cells else whole
            visits = part(visits.where(F.pmod(F.xxhash64(*CELL), F.lit(splits)) == split), "visits")
        visits = _grown(visits, part, threshold, reach, stop, fit_rows, levels)
        visits = visits.withColumn("leaf", (F.col("tree") * F.lit(splits) + F.lit(split)).cast("long") * F.lit(1 << 40) + F.col("path"))
        seen.append(stage(visits.groupBy("label", "node").agg(F.collect_set("leaf").alias("leaves")), "leaves"))
        own = reduce(DataFrame.union, seen).groupBy("label", "node").agg(F.flatten(F.collect_list("leaves")).alias("leaves")) if p else seen[0]
        sizes = visits.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("size"))
        sizes = part(sizes.where("size > 1").select("label", "dim", "leaf", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "sizes")
        here = visits.select("label", "dim", "leaf", "node", "copies", "v").join(own, ["label", "node"]).join(sizes, ["label", "dim", "leaf"])
        here = here.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        here = here.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("bi"), F.greatest("mine", o).alias("bj")))))
        here = here.select(F.xxhash64("label", "dim", "leaf").alias("key"), "dim", "leaf", "pair.bi", "pair.bj", "node", "copies", "v", "leaves", F.when(F.col("mine") == F.col("pair.bi"), 0).otherwise(1).alias("side"))
        here = here.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        mets.append(stage(here.mapInArrow(_compare(threshold), "node long, links long, other long"), "met"))
        part.close()
    stage.close(classes, *mets)
    met = reduce(DataFrame.union, mets)
    comp = stage.hold(connected_components(met.select(F.col("node").alias("a"), F.col("other").alias("b")).where("a <> b")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = stage(classes.join(links, "node", "left").join(comp, "node", "left").select("label", "node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")), "named")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = stage(named.join(least, "comp").select("label", "node", "n_links", "component_id"), "found")
    stage.close(named)
    mine = t.where("good").join(named, ["label", "node"]).select("_id", "n_links", "component_id")
    rest = t.where("not good").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return mine.union(rest).withColumnRenamed("_id", id_col)


def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(k.n, 0)::bigint AS n_links, least(e.vec_id, coalesce(m.m, e.vec_id)) AS component_id, coalesce(m.m, e.vec_id) >= e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = e.vec_id
"""
