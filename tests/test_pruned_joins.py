"""Neighbour joins that skip pairs of blocks: the rows of the full pass, and how much is skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import clustering, similarity


def planted(spark, seed=0, n=400, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 6))
    v = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, 6)) * spread
    v[50:60] = v[50]  # copies
    v[70] = 0
    rows = [(2**60 + i, x.tolist()) for i, x in enumerate(v)]
    return spark.createDataFrame([*rows, (1, None)], "id bigint, emb array<double>"), v


def full(v, metric):
    d = similarity.distances(v, v, metric)
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pruned_neighbours_are_those_of_the_full_pass(spark, metric):
    rows, v = planted(spark)
    d, first = full(v, metric), 2**60
    eps = 0.15 if metric == "euclidean" else 0.002
    want = {(first + a, first + b) for a, b in zip(*np.nonzero(d <= eps), strict=True) if a < b}
    assert {(r["a"], r["b"]) for r in similarity.pairwise(rows, metric=metric, at_most=eps, block=20).collect()} == want
    found = {}
    for r in similarity.knn(rows, 4, metric=metric, block=20).collect():
        found.setdefault(r["id"] - first, []).append((r["rank"], r["neighbor"] - first, r["distance"]))
    assert len(found) == 400
    for i, got in found.items():
        order = np.lexsort((np.arange(400), d[i]))[:4]
        assert np.allclose([x[2] for x in sorted(got)], d[i][order], atol=1e-7) and [x[0] for x in sorted(got)] == [1, 2, 3, 4]


def test_pruned_density_clusters_are_those_of_one_block(spark):
    rows, _ = planted(spark, 3)
    one, many = ({r["id"]: r["label"] for r in clustering.dbscan(rows, 0.12, 3, block=b).collect()} for b in (2048, 25))
    assert one == many and one[1] == -1 and len(set(one.values())) > 10


def test_blocks_are_skipped_on_planted_clusters(spark):
    rows, _ = planted(spark, 1, 600)
    blocks = similarity.metric_blocks(rows, "id", "emb", block=30)
    near = blocks.near(0.2)
    sizes = [r["n"] for r in blocks.rows.groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 600 and near.diagonal().all() and (near == near.T).all()
    assert near.mean() < 0.4  # the share of the pairs of blocks that is compared
    assert blocks.near(np.inf).all() and similarity.metric_blocks(rows.limit(0), "id", "emb").rows.count() == 0
    nan = rows.unionByName(spark.createDataFrame([(5, [float("nan")] * 6)], rows.schema))
    assert clustering.dbscan(nan, 0.12, 3, block=40).filter("id = 5").first()["label"] == -1
