"""Near vectors against the full cosine matrix."""

import numpy as np

from quillspark.llm.projection_forest import _grown, near_vectors
from quillspark.runtime import Tables

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def brute(rows, threshold=0.93):
    ok = [r[1] is not None and r[2] is not None and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]
    x = np.array([np.asarray(r[1], np.float32).astype(float) / np.linalg.norm(np.asarray(r[1], np.float32).astype(float)) if o else np.zeros(len(rows[0][1])) for r, o in zip(rows, ok)])
    label = np.array([-1 - i if r[2] is None else r[2] for i, r in enumerate(rows)])
    link = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    comp = np.array([r[0] for r in rows])
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(rows))])
        if (new == comp).all():
            return {r[0]: (int(link[i].sum()), int(comp[i])) for i, r in enumerate(rows)}
        comp = new


def table(n=600, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim))
    vectors = [centres[rng.integers(40)] + rng.standard_normal(dim) * rng.choice([0.15, 0.3]) for _ in range(n)]
    rows = [(i, [float(np.float32(e)) for e in v], int(rng.integers(3)), "x") for i, v in enumerate(vectors)]
    rows += [(n + i, rows[5][1], rows[5][2], "x") for i in range(50)]
    rows += [(n + 60, None, 1, ""), (n + 61, [0.0] * dim, 1, ""), (n + 62, [float("nan")] * dim, 1, ""), (n + 63, [None] * dim, 1, ""), (n + 64, rows[0][1], None, "")]
    return rows


def test_matches_brute_force(spark):
    rows = table()
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), leaf=40, block=16, trees=8).collect()
    got, want = {r.vec_id: (r.n_links, r.component_id) for r in got}, brute(rows)
    assert len(got) == len(want)
    assert sum(g == want[k] for k, g in got.items()) >= 0.99 * len(want)
    assert all(g[0] <= want[k][0] for k, g in got.items())


def test_odd_tables(spark):
    df = spark.createDataFrame(table()[:3], SCHEMA)
    assert near_vectors(df.where("false")).count() == 0
    assert near_vectors(df.where("vec_id = 1").union(df.where("vec_id = 1"))).collect()[0].n_links == 1
    assert near_vectors(spark.createDataFrame([(1, None, 1, ""), (None, None, None, "")], SCHEMA)).count() == 2


def links(rows, threshold=0.93):
    x = np.array([np.asarray(r[1], np.float32).astype(float) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    close = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
    return close.sum(1) - 1


def test_default_settings_find_links_in_deep_trees(spark):
    """Half of a label in one cluster at the threshold, the worst case, and pairs planted at it; depth 7."""
    rng, dim = np.random.default_rng(3), 64
    centre = rng.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    tight = [centre + rng.standard_normal(dim) * np.sqrt(0.07 / 0.93 / dim) for _ in range(1500)]
    loose = []
    for _ in range(750):
        a, b = (v / np.linalg.norm(v) for v in rng.standard_normal((2, dim)))
        b -= (a @ b) * a
        loose += [a, 0.9305 * a + np.sqrt(1 - 0.9305**2) * b / np.linalg.norm(b)]
    rows = [(i, [float(np.float32(e)) for e in v], 1, "x") for i, v in enumerate([*tight, *loose])]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    want = links(rows)
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= want).all()
    assert found[:1500].sum() >= 0.98 * want[:1500].sum() > 100_000 and found[1500:].sum() >= 0.99 * want[1500:].sum()


def test_every_length_is_compared(spark):
    rows = [(i, [1.0, 0.1 * i], 1, "") for i in range(5)] + [(10, [1.0, 2.0, 3.0], 1, ""), (11, [1.0, 2.0, 3.01], 1, ""), (12, [1.0, 2.0, 3.0], 2, ""), (13, [], 1, "")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[10] == (1, 10) and got[11] == (1, 10) and got[12] == (0, 12) and got[13] == (0, 13)


def test_cluster_too_tight_to_split(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(e)) for e in np.ones(16) + rng.standard_normal(16) * 1e-3], 1, "x") for i in range(300)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), block=64).collect()
    assert all((r.n_links, r.component_id) == (299, 0) for r in got)


def test_null_id_with_a_good_vector(spark):
    v = [1.0, 2.0, 3.0]
    got = near_vectors(spark.createDataFrame([(None, v, 1, ""), (5, v, 1, ""), (7, v, 1, ""), (None, v, None, "")], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 0, 0), (5, 1, 5), (7, 1, 5)]


def test_growth_holds_the_visits_of_one_round(spark):
    """Finished leaves are kept once; the visits of earlier rounds and their models go."""
    x = np.random.default_rng(5).standard_normal((300, 8)).tolist()
    start = spark.createDataFrame([(1, 8, 0, 1, i, 1, v, 6, False) for i, v in enumerate(x)], "label int, dim int, tree int, path long, node long, copies long, v array<double>, last int, ended boolean")
    stage = Tables()
    out = _grown(start, stage, 0.93, 0.64, 8, 1024, 2)
    names = [t._staged_at.getName().split("-")[0] for t in stage.held]
    assert names.count("done") > 1 and names.count("visits") == 1 and "model" not in names
    assert out.select("node").distinct().count() == 300
    stage.close()


def test_portions_hold_a_part_of_the_visits_and_count_a_link_once(spark, monkeypatch):
    from quillspark.llm import projection_forest

    sizes = []

    class Seen(projection_forest.Tables):
        def __call__(self, df, label):
            out = super().__call__(df, label)
            if {"tree", "v"} <= set(out.columns):
                sizes.append(out.count())
            return out

    monkeypatch.setattr(projection_forest, "Tables", Seen)
    monkeypatch.setattr(projection_forest, "PORTION_BYTES", 50_000, raising=False)
    rng = np.random.default_rng(9)
    rows = [(3 * k + i, [float(np.float32(e)) for e in c + rng.standard_normal(16) * 0.01], 1, "x") for k, c in enumerate(rng.standard_normal((100, 16))) for i in range(3)]
    rows += [(400 + i, v, 2, "x") for i, (_, v, _, _) in enumerate(rows[:9])]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), leaf=40, block=16, trees=2).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert sizes and max(sizes) < 600  # of two trees
