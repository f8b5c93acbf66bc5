"""Products of blocks that are read from the shared folder: what is sent and kept doesn't grow with the number of blocks."""

import os

import numpy as np
import pytest

from kinweave.operators import clustering, similarity, thresholds
from kinweave.operators.graph import shared_dir


def frame(spark, v):
    return spark.createDataFrame([(7 * i, x.tolist()) for i, x in enumerate(v)], "id bigint, emb array<double>")


@pytest.mark.parametrize("at_most", [None, 1.2])
def test_pairs_are_not_shuffled(spark, at_most):
    v = np.random.default_rng(2).normal(size=(90, 5))
    found = similarity.pairwise(frame(spark, v), metric="euclidean", at_most=at_most, block=10)
    d = similarity.distances(v, v, "euclidean")
    want = {(7 * a, 7 * b): d[a, b] for a in range(90) for b in range(a + 1, 90) if at_most is None or d[a, b] <= at_most}
    got = {(r["a"], r["b"]): r["distance"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_hold_each_row_once(spark):
    v = np.random.default_rng(3).normal(size=(95, 4))
    kept = similarity.all_blocks(frame(spark, v), "id", "emb", 10)
    assert len(kept.names) == 10 and all(kept.names)
    seen = kept.tasks([(p, np.array([p])) for p in range(10)], "id bigint", lambda read, i, js: [similarity.pa.table({"id": read(i)[0]})])
    assert [r["id"] for r in seen.collect()] == [7 * i for i in range(95)]
    kept.drop()
    assert similarity.pairwise(frame(spark, v).limit(0), block=10).count() == 0


@pytest.mark.parametrize(("kind", "few"), [("dense", 0), ("dense", 1 << 18), ("copies", 4), ("awkward", 0)])
def test_statistics_are_exact_and_read_blocks(spark, monkeypatch, kind, few):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 3)) if kind == "dense" else np.repeat(rng.normal(size=(8, 3)), 15, axis=0)
    if kind == "awkward":  # many nearly equal distances, a vector of zeros, one that isn't a number
        v = np.ones((120, 3)) + rng.normal(size=(120, 3)) * 1e-7
        v[5] = 0
    all_blocks, passes = thresholds.all_blocks, []
    monkeypatch.setattr(thresholds, "all_blocks", lambda *a: all_blocks(*a, 16))
    tasks = similarity.Stored.tasks
    monkeypatch.setattr(similarity.Stored, "tasks", lambda self, *a: passes.append(a) or tasks(self, *a))
    rows = frame(spark, np.concatenate((v, np.full((1, 3), np.nan))) if kind == "awkward" else v)
    one = thresholds.distance_stats(rows, few=few).first()
    u = similarity.units(v)
    d = (1 - u @ u.T)[np.triu_indices(len(v), 1)]
    assert one["num_pairs"] == len(d) and len(passes) >= 2
    assert np.allclose([one["mean"], one["std"], one["min"], one["max"]], [d.mean(), d.std(), d.min(), d.max()], atol=1e-7)
    assert np.allclose([one[f"p{p}"] for p in thresholds.PERCENTILES], np.percentile(d, thresholds.PERCENTILES), rtol=0, atol=1e-12)


def test_dispatch_drops_its_blocks(spark):
    """Both ways of clustering leave nothing in the shared folder."""
    rng = np.random.default_rng(4)
    rows = frame(spark, rng.normal(size=(60, 3)))
    before = kept(spark)
    config = clustering.ClusterConfig(min_cluster_size=5, eps=0.9, db_min_samples=3, noise_fallback_ratio=-1.0, one_task=0)
    found = {r["id"]: r["label"] for r in clustering.cluster(rows, config).collect()}
    alike = clustering.ClusterConfig(min_cluster_size=5, noise_fallback_ratio=2.0, one_task=0)
    tree, one = ({r["id"]: r["label"] for r in clustering.cluster(rows, c).collect()} for c in (alike, clustering.ClusterConfig(min_cluster_size=5, noise_fallback_ratio=2.0)))
    assert tree == one and found == {r["id"]: r["label"] for r in clustering.dbscan(rows, 0.9, 3, block=8).collect()}
    assert kept(spark) == before


def kept(spark):
    return {p for p in os.listdir(shared_dir(spark).removeprefix("file://")) if p.startswith("kinweave-blocks-")}
