"""Merging without the driver against the greedy loop."""

import numpy as np
import pytest

from kinweave.operators import refine


def sums_of(spark, v):
    return spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "label bigint, total array<double>")


def greedy(v, threshold):
    return refine.merge_plan([i * 3 for i in range(len(v))], np.ones(len(v)), v, threshold)


def found(spark, v, threshold, **options):
    return {r["label"]: r["home"] for r in refine.merge_homes(sums_of(spark, v), threshold, **options).collect()}


def test_sums_of_planted_groups_of_any_length(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 5))
    v = (centres[rng.integers(0, 12, 90)] + rng.normal(size=(90, 5)) * 0.25) * rng.integers(1, 40, 90)[:, None]
    want = greedy(v, 0.05)
    assert 10 < len(set(want.values())) < 80
    assert found(spark, v, 0.05, block=25) == want


def test_a_mean_that_comes_nearer_to_another_component_than_its_members_were(spark):
    a, up = np.radians(25), np.radians(24)
    v = np.array([[np.cos(a), np.sin(a), 0], [np.cos(a), -np.sin(a), 0], [np.cos(up), 0, np.sin(up)], [0, 0, -1.0]])
    near = 1 - np.cos(2 * a) + 1e-3
    apart = 1 - v[2] @ v[0]
    v[2] = [np.cos(np.radians(55)), 0, np.sin(np.radians(55))]
    apart, mean = 1 - v[2] @ v[0], 1 - v[2][0]
    assert near < apart and mean > near  # nothing happens yet: the mean is too far
    v[2] = [np.cos(np.radians(47)), 0, np.sin(np.radians(47))]
    assert near < 1 - v[2] @ v[0] and 1 - v[2][0] < near  # only the mean of the first two is near enough
    want = greedy(v, near)
    assert want == {0: 0, 3: 0, 6: 0, 9: 9} and found(spark, v, near) == want


@pytest.mark.parametrize("most", [4, 10])
def test_components_over_the_bound_are_merged_in_steps_of_the_threshold(spark, most):
    rng = np.random.default_rng(5)
    angles = np.sort(rng.uniform(0, 1.5, 24))  # a chain: one component under the whole threshold
    v = np.stack([np.cos(angles), np.sin(angles)], 1) * rng.integers(1, 5, 24)[:, None]
    assert found(spark, v, 0.02, most=most) == greedy(v, 0.02)


def test_ties_zeros_and_sums_without_a_number(spark):
    v = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0], [2, 0, 0], [0, 4, 0], [-1, 0, 0], [1, 0, 0]])
    for threshold in (0.5, 1.5):
        assert found(spark, v, threshold) == greedy(v, threshold)
    rows = spark.createDataFrame([(i, x.tolist(), i) for i, x in enumerate(v)] + [(20, [float("nan"), 0.0, 0.0], 9), (21, None, 10), (22, [1.0, 0.0, 0.0], -1)], "id bigint, emb array<double>, label int")
    one, many = ({r["id"]: r["label"] for r in refine.merge_clusters(rows, 0.5, few=few).collect()} for few in (100, 2))
    assert one == many and one[4] == one[7] == 0 and one[5] == 1 and one[20] == 9 and one[21] == 10 and one[22] == -1
    assert refine.merge_homes(sums_of(spark, v).limit(0), 0.5).count() == 0
