"""The neighbourhood-preserving reduction: its parts against plain rules, the layout by what it keeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import manifold


def planted(spark, n=160, groups=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 24))
    of = rng.integers(0, groups, n)
    v = centres[of] + rng.normal(size=(n, 24)) * 0.15
    v[20:26], of[20:26] = v[20], of[20]  # copies
    rows = spark.createDataFrame([(2**60 + i, x.tolist(), "x") for i, x in enumerate(v)], "id bigint, emb array<double>, y string")
    return rows, v, of


def vectors(rows):
    return {r["id"] - 2**60: np.array(r["emb"]) for r in rows.collect() if r["emb"] is not None}


def trustworthiness(v, y, k=10):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    far, near = 1 - u @ u.T, ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(far, -1)
    np.fill_diagonal(near, np.inf)
    rank = far.argsort(1).argsort(1)
    n, lost = len(v), 0
    for i in range(n):
        lost += np.maximum(rank[i, near[i].argsort()[:k]] - k, 0).sum()
    return 1 - lost * 2 / (n * k * (2 * n - 3 * k - 1))


def test_curve_and_memberships():
    a, b = manifold.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)
    d = np.sort(np.random.default_rng(0).uniform(0.1, 1, (5, 15)), 1)
    w = manifold.weights(d)
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(1), np.log2(15), atol=1e-6) and (np.diff(w, axis=1) <= 0).all()
    assert np.allclose(manifold.weights(np.zeros((2, 4))), 1) and np.isfinite(manifold.weights(np.full((1, 1), 0.5))).all()


def test_weights_of_links_are_the_union_of_both_sides(spark):
    rows, v, _ = planted(spark, 40)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    found = {(r["id"] - 2**60, r["neighbor"] - 2**60): r["w"] for r in manifold.fuzzy(manifold.usable(rows, "emb"), 5).collect()}
    assert len(found) == 200
    near = {}
    for i in range(40):
        order = sorted((round(d[i, j], 12), j) for j in range(40) if j != i)[:5]
        for j, w in zip([j for _, j in order], manifold.weights(np.maximum([[x for x, _ in order]], 0))[0], strict=True):
            near[i, j] = w
    for (i, j), w in found.items():
        if (i, j) in near and not (20 <= i < 26 or 20 <= j < 26):  # rounding decides among copies
            one, other = near[i, j], near.get((j, i), 0.0)
            assert w == pytest.approx(one + other - one * other, abs=1e-6)


@pytest.mark.parametrize("block", [8192, 60])
def test_layout_keeps_neighbourhoods_and_its_result(spark, block):
    rows, v, of = planted(spark)
    reducer = manifold.UmapReducer(3, 10, epochs=60, block=block)
    found = reducer.reduce(rows, "emb")
    assert found.columns == rows.columns
    y = vectors(found)
    got = np.stack([y[i] for i in range(len(v))])
    assert got.shape == (160, 3) and np.isfinite(got).all() and trustworthiness(v, got) > 0.9
    near = ((got[:, None] - got[None]) ** 2).sum(2)
    np.fill_diagonal(near, np.inf)
    assert (of[near.argmin(1)] == of).mean() > 0.97
    again = vectors(reducer.reduce(rows.repartition(3, F.hash("emb")), "emb"))
    assert all(np.allclose(y[i], again[i]) for i in y)


def test_new_rows_by_a_kept_reducer_and_rows_without_a_vector(spark, tmp_path):
    rows, v, of = planted(spark)
    none = spark.createDataFrame([(1, None, "x"), (2, [float("nan")] * 24, "x")], rows.schema)
    model = manifold.UmapReducer(2, 10, epochs=40).fit(rows.unionByName(none))
    model.save(str(tmp_path / "kept"))
    kept = manifold.Fitted.load(spark, str(tmp_path / "kept"))
    base = {r["base_id"] - 2**60: np.array(r["y"]) for r in kept.base.collect()}
    assert len(base) == 160
    rng = np.random.default_rng(7)
    new = spark.createDataFrame([(i, (v[i] + rng.normal(size=24) * 0.05).tolist(), "x") for i in range(30)] + [(900, None, "x")], rows.schema)
    out = {r["id"]: r["emb"] for r in kept.transform(new).collect()}
    assert len(out) == 31 and out[900] is None
    ids = sorted(base)
    places = np.stack([base[i] for i in ids])
    assert np.mean([of[ids[((places - np.array(out[i])) ** 2).sum(1).argmin()]] == of[i] for i in range(30)]) > 0.9
    two = manifold.UmapReducer(2).reduce(rows.limit(2), "emb")
    assert sorted(map(str, two.collect())) == sorted(map(str, rows.limit(2).collect()))
    five = manifold.UmapReducer(50, 15, epochs=5).reduce(rows.limit(5).unionByName(none), "emb")
    assert sorted((r["emb"] is None, len(r["emb"] or [])) for r in five.collect()) == [(False, 4)] * 5 + [(True, 0)] * 2


def test_the_engine_clusters_and_draws_by_neighbourhoods(spark):
    from kinweave.plans import engine
    from kinweave.sources import config

    rows, v, of = planted(spark, 60, 3)
    faces, c = rows.drop("y"), config.EngineConfig(reducer=config.ReducerConfig("umap", 3, 8))
    known = spark.createDataFrame([], "pos int, identity_id string, centroid array<double>")
    found = {r["id"] - 2**60: r["label"] for r in engine.group(faces, known, c).collect()}
    kept = [i for i in found if found[i] >= 0]
    assert len(found) == 60 and len(kept) > 45
    for label in set(found[i] for i in kept):
        assert len({of[i] for i in kept if found[i] == label}) == 1  # no cluster mixes groups
    drawn = engine.flat(faces, c)
    assert drawn.filter("x IS NULL OR y IS NULL").isEmpty() and drawn.select("x", "y").distinct().count() == 60
    assert engine.flat(faces.limit(2), c).filter("x <> 0 OR y <> 0").isEmpty()
