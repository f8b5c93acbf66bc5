"""The hierarchy against a plain reference: every merge by definition, recursion from the top."""

import numpy as np
import pytest

from kinweave.operators import clustering, hierarchy, similarity


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], "id bigint, emb array<double>")


def reference(v, least, samples):
    """(labels, probabilities) of rows in the order of their ids."""
    n = len(v)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    core = np.zeros(n)
    if 1 < samples <= n:
        core = np.sort(d, axis=1)[:, samples - 1]
    reach = np.round(np.maximum(np.maximum(d, core[:, None]), core[None]), 9)
    least = min(least, max(2, n // 3))
    groups, tree = {i: (i,) for i in range(n)}, {}
    name = list(range(n))
    for w, a, b in sorted((reach[a, b], a, b) for a in range(n) for b in range(a + 1, n)):
        x, y = name[a], name[b]
        if x != y:
            new = n + len(tree)
            tree[new] = (w, x, y)
            groups[new] = groups[x] + groups[y]
            for p in groups[new]:
                name[p] = new
    clusters = []

    def walk(node, birth, parent):
        me = len(clusters)
        clusters.append({"birth": birth, "parent": parent, "rows": {}, "kids": [], "edges": [], "node": node})
        while True:
            w, x, y = tree[node]
            at = 1 / w if w > 0 else np.inf
            big = [s for s in (x, y) if len(groups[s]) >= least]
            if len(big) == 2:
                clusters[me]["edges"] += [(at, len(groups[s])) for s in big]
                clusters[me]["kids"] = [walk(s, at, me) for s in big]
                return me
            for s in (x, y):
                if s not in big:
                    clusters[me]["rows"] |= {p: at for p in groups[s]}
            if not big:
                return me
            node = big[0]

    if n < max(2, least):
        return [-1] * n, [0.0] * n
    walk(max(groups), 0.0, -1)

    def stable(c):
        c = clusters[c]
        return sum(0 if a == c["birth"] else (min(a, 1e300) - c["birth"]) * m for a, m in [(a, 1) for a in c["rows"].values()] + c["edges"])

    def best(c):
        below = [best(k) for k in clusters[c]["kids"]]
        inner = sum(w for w, _ in below)
        if c and (not below or stable(c) >= inner * (1 - 1e-9)):
            return stable(c), [c]
        return max(inner, stable(c)), [k for _, s in below for k in s]

    def members(c):
        out = dict(clusters[c]["rows"])
        for k in clusters[c]["kids"]:
            out |= members(k)
        return out

    labels, shares = [-1] * n, [0.0] * n
    chosen = best(0)[1]
    for label, c in enumerate(sorted(chosen, key=lambda c: min(groups[clusters[c]["node"]]))):
        top = max([*clusters[c]["rows"].values(), *(a for a, _ in clusters[c]["edges"])])
        for p, a in members(c).items():
            labels[p], shares[p] = label, 1.0 if top == 0 or np.isinf(a) else min(a, top) / top
    return labels, shares


def data(kind, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "tied":
        return rng.integers(0, 5, (40, 2)).astype(float)
    if kind == "nested":  # groups of groups
        return np.concatenate([np.add(c, s) + rng.normal(size=(4, 2)) * 0.05 for c in ((0, 0), (20, 0), (0, 20)) for s in ((0, 0), (2, 0), (0, 2.5))])
    if kind == "copies":
        return np.repeat(rng.normal(size=(9, 3)), [1, 5, 1, 4, 2, 1, 6, 1, 3], axis=0)
    if kind == "chain":  # each merge takes one row more
        return np.cumsum(1 + 0.01 * np.arange(40))[:, None] * [1.0, 0.0]
    return rng.normal(size=(int(kind), 3))


@pytest.mark.parametrize("kind", ["tied", "nested", "copies", "chain", "10", "3", "70"])
def test_one_task_equals_the_reference(spark, kind):
    v = data(kind)
    sizes, samples = (2, 3, 5), (1, 2, 4)
    rows = frame(spark, enumerate(v))
    found = {(r["min_cluster_size"], r["min_samples"], r["id"]): (r["label"], r["probability"]) for r in hierarchy.grid(rows, sizes, samples).collect()}
    assert len(found) == 9 * len(v)
    for s in sizes:
        for k in samples:
            labels, shares = reference(v, s, k)
            assert [found[s, k, i][0] for i in range(len(v))] == labels, (s, k)
            assert np.allclose([found[s, k, i][1] for i in range(len(v))], shares), (s, k)


@pytest.mark.parametrize(("kind", "sizes", "samples", "band"), [("tied", (2, 5), (1,), 7), ("copies", (2,), (3,), 5), ("chain", (2,), (1,), 10)])
def test_tables_equal_the_reference(spark, kind, sizes, samples, band):
    """Without a task that sees all rows: ids of 64 bits, bands of a few edges."""
    v = data(kind)
    first = 2**60
    rows = frame(spark, [(first + i, x) for i, x in enumerate(v)] + [(5, None), (6, [float("nan")] * v.shape[1]), (7, [float("inf")] + [0.0] * (v.shape[1] - 1))])
    found = {(r["min_cluster_size"], r["min_samples"], r["id"]): (r["label"], r["probability"]) for r in hierarchy.grid(rows, sizes, samples, one_task=0, band=band).collect()}
    for s in sizes:
        for k in samples:
            labels, shares = reference(v, s, k)
            assert [found[s, k, first + i][0] for i in range(len(v))] == labels
            assert np.allclose([found[s, k, first + i][1] for i in range(len(v))], shares)
            assert [found[s, k, i] for i in (5, 6, 7)] == [(-1, 0.0)] * 3


@pytest.mark.parametrize(("kind", "near"), [("tied", 1), ("nested", 2), ("copies", 1), ("chain", 1), ("150", 1), ("150", 8)])
def test_two_passes_equal_the_reference(spark, monkeypatch, kind, near):
    """Nearest rows, then what joins them: blocks of ten rows, forests of the tasks in two steps."""
    for name, value in (("NEAREST", near), ("SIDE", 10), ("HELD", 1)):
        monkeypatch.setattr(hierarchy, name, value)
    v = data(kind, 4)
    sizes, samples = (2, 5), (1, 3)
    first = 2**60
    rows = frame(spark, [*((first + i, x) for i, x in enumerate(v)), (5, None)])
    found = {(r["min_cluster_size"], r["min_samples"], r["id"]): (r["label"], r["probability"]) for r in hierarchy.grid(rows, sizes, samples, one_task=0).collect()}
    assert len(found) == 4 * (len(v) + 1)
    for s in sizes:
        for k in samples:
            labels, shares = reference(v, s, k)
            assert [found[s, k, first + i][0] for i in range(len(v))] == labels, (s, k)
            assert np.allclose([found[s, k, first + i][1] for i in range(len(v))], shares), (s, k)
            assert found[s, k, 5] == (-1, 0.0)


def test_the_tree_takes_two_passes_over_pairs(spark, monkeypatch):
    """All of samples share them, and the places of copies beyond the nearest rows are found."""
    v = np.repeat(np.random.default_rng(5).normal(size=(12, 3)), 20, axis=0)
    passes = []
    tasks = similarity.Stored.tasks
    monkeypatch.setattr(similarity.Stored, "tasks", lambda self, *a: passes.append(a) or tasks(self, *a))
    monkeypatch.setattr(hierarchy, "SIDE", 40)
    found = hierarchy.grid(frame(spark, enumerate(v)), (2, 5), (1, 2, 3), one_task=0).collect()
    assert len(passes) == 2
    for s in (2, 5):
        labels, _ = reference(v, s, 2)
        assert [r["label"] for r in sorted(found, key=lambda r: r["id"]) if (r["min_cluster_size"], r["min_samples"]) == (s, 2)] == labels


def test_awkward_rows(spark):
    for rows in ([(1, None)], [(1, None), (2, [1.0])], [(1, [float("nan")]), (2, [1.0])]):
        assert {(r["label"], r["probability"]) for r in clustering.hdbscan(frame(spark, rows)).collect()} == {(-1, 0.0)}
    assert clustering.hdbscan(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, [0.0]), (1, [0.1]), (2, [9.0]), (3, [9.1]), (4, [30.0]), (5, [30.1])])
    assert sorted((r["id"], r["label"]) for r in clustering.hdbscan(twice).collect()) == [(1, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
    mixed = frame(spark, [(2**60 + i, [float(i // 4) * 10 + i % 4 * 0.1, 0.0]) for i in range(12)] + [(1, None)])
    got = {r["id"]: r["label"] for r in clustering.cluster(mixed, clustering.ClusterConfig(min_cluster_size=3)).collect()}
    assert got[1] == -1 and [got[2**60 + i] for i in range(12)] == [0] * 4 + [1] * 4 + [2] * 4
