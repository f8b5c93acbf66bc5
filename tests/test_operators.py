"""Operators against numpy, and the edge cases."""

import itertools
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.operators import clustering, evaluate, graph, identities, imaging, refine, report, similarity, thresholds
from kinweave.sources import config, images, tables


def frame(spark, v, **columns):
    names = list(columns)
    rows = [(i, [float(x) for x in r], *(columns[n][i] for n in names)) for i, r in enumerate(v)]
    kinds = {int: "int", float: "double", str: "string"}
    return spark.createDataFrame(rows, "id bigint, emb array<double>" + "".join(f", {n} {kinds[type(columns[n][0])]}" for n in names))


def blobs(seed=42, k=3, n=10, d=50, apart=10.0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n, d)) * 0.3 + rng.normal(size=d) * apart for _ in range(k)])


# --- clustering

def test_blobs_are_found(spark):
    rows = frame(spark, blobs())
    got = clustering.cluster(rows).collect()
    assert len(got) == 30 and len({r["label"] for r in got} - {-1}) >= 2
    five = {r["id"]: r["label"] for r in clustering.hdbscan(rows, clustering.ClusterConfig(min_cluster_size=5)).collect()}
    assert [len({five[i] for i in range(a, a + 10)}) for a in (0, 10, 20)] == [1, 1, 1] and len(set(five.values())) == 3


def test_no_row_and_one_row(spark):
    one = frame(spark, np.ones((1, 4)))
    assert [tuple(r) for r in clustering.cluster(one).collect()] == [(0, 0, 1.0)]
    assert clustering.cluster(one.limit(0)).count() == 0


def test_spanning_tree_rounds_equal_prim(spark):
    """Points of a small grid, copies among them, and spread ones: both ways to build the tree choose the same edges."""
    from kinweave.operators import hierarchy

    for v in (blobs(7, 4, 12, 8, 3.0), np.random.default_rng(2).integers(0, 6, (60, 2)).astype(float)):
        points = hierarchy.core_distances(hierarchy.placed(frame(spark, v), "id", "emb").select("pos", "v"), (1, 3))
        own = points.orderBy("pos").toPandas()
        for c in ("c1", "c3"):
            a, b, w = hierarchy.prim(np.stack(own["v"].to_list()), own[c].to_numpy())
            rounds = sorted(tuple(r) for r in hierarchy.spanning_edges(points, c).collect())
            assert rounds == sorted(zip(a.tolist(), b.tolist(), w.tolist(), strict=True)) and len(rounds) == len(v) - 1


def test_normalizing_is_linear_in_the_dimension(spark):
    import time

    from kinweave.functions.vectors import l2_normalize

    took = {}
    for d in (64, 512):
        rows = spark.range(300, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.sin(i * (F.col("id") + 1))).alias("v")).select(l2_normalize(F.col("v")).alias("u"))
        rows.agg(F.sum(F.element_at("u", 1))).collect()
        began = time.time()
        for _ in range(3):
            rows.agg(F.sum(F.element_at("u", -1))).collect()
        took[d] = time.time() - began
        one = np.array(rows.first()["u"])
        assert len(one) == d and abs((one**2).sum() - 1) < 1e-9
    assert took[512] < 24 * took[64]  # 64 times if the norm were computed again for every number
    assert spark.createDataFrame([([0.0, 0.0],), (None,)], "v array<double>").select(l2_normalize(F.col("v")).alias("u")).filter("u IS NULL").count() == 2


def test_knn_of_copies_is_bounded(spark):
    rows = frame(spark, np.ones((300, 3)))
    assert sum(similarity.least_k(np.zeros((300, 300)), 5)[0] == 7) == 5
    found = similarity.knn(rows, 2).collect()
    assert len(found) == 600 and {(r["neighbor"], r["rank"]) for r in found if r["id"] == 5} == {(0, 1), (1, 2)}


def test_large_labels_in_blocks(spark, monkeypatch):
    from kinweave.operators import refine as module

    v = np.concatenate([blobs(5, 2, 40, 6, 4.0), blobs(9, 1, 10, 6, 1.0)])
    rows = frame(spark, v, label=[0] * 80 + [3] * 10)
    whole = {r["label"]: (r["n"], r["max_distance"]) for r in refine.cluster_diameter(rows).collect()}
    monkeypatch.setattr(module, "group_blocks", lambda *a, **k: similarity.group_blocks(*a, **k, block=13))
    parts = {r["label"]: (r["n"], r["max_distance"]) for r in refine.cluster_diameter(rows).collect()}
    u = v[:80] / np.linalg.norm(v[:80], axis=1)[:, None]
    assert whole.keys() == parts.keys() == {0, 3} and all(whole[k][0] == parts[k][0] and abs(whole[k][1] - parts[k][1]) < 1e-12 for k in whole)
    assert abs(whole[0][1] - (1 - u @ u.T).max()) < 1e-9
    sides = [{r["id"]: r["side"] for r in refine.halves(rows.select("id", "label", F.col("emb").alias("v")), sample=n).collect()} for n in (2048, 9)]
    assert sides[0] == sides[1] and [sides[0][i] for i in range(80)] == [0] * 40 + [1] * 40


def test_file_names_are_different(spark):
    names = ["/a/x.jpg", "/b/x.jpg", "/c/x_1.jpg", "/d/x.jpg", "/e/x_1.jpg", "/f/x_3.jpg", "/g/.hidden", "/h/.hidden", "/i/x"]
    rows = spark.createDataFrame([(0, p, i) for i, p in enumerate(names)] + [(1, "/b/x.jpg", 99)], "label int, image_path string, ord int")
    found = {r["image_path"]: r["file_name"] for r in report.manifest(rows).filter("label = 0").collect()}
    assert len(set(found.values())) == len(names)
    assert [found[n] for n in names] == ["x.jpg", "x_2.jpg", "x_1.jpg", "x_4.jpg", "x_1_1.jpg", "x_3.jpg", ".hidden", ".hidden_1", "x"]
    assert report.manifest(rows).filter("label = 1").first()["file_name"] == "x.jpg"


def test_plot_pixels(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.9), (1, 0.001, 0.0, 0.3), (-1, 1.0, 1.0, 0.5), (2, 1.0, 0.0, 0.9), (3, 1.0, 0.0, 0.9)], "label int, x double, y double, alpha double")
    got = sorted((r["px"], r["py"], r["label"]) for r in report.plot_pixels(points, 10, 8).collect())
    assert got == [(0, 0, 0), (9, 0, 2), (9, 7, -1)]
    image = report.plot_image(points, 10, 8)
    assert image.shape == (8, 10, 3) and (image[0, 9] < 250).any() and (image[3, 5] == 255).all()
    assert (report.plot_image(points.limit(0), 4, 4) == 255).all()


def test_settings_have_an_effect(spark):
    from kinweave.operators import quality

    one = spark.createDataFrame([(0.0, 0.0, 60.0, 60.0, 20.0, 20.0, 40.0, 39.0, 30.0, 0.9, 60.0)], "x1 double, y1 double, x2 double, y2 double, lex double, ley double, rex double, rey double, nx double, det_score double, lap_var double")
    base = quality.scored(one).first()
    assert (base["size_score"], base["blur_score"], base["pose_score"]) == (0.7, 0.8, 0.7)
    assert quality.scored(one, least_size=100).first()["size_score"] == 0.3 and quality.scored(one, blur=100).first()["blur_score"] == 0.5
    assert quality.scored(one, most_angle=30).first()["pose_score"] == 0.1


def test_detector_is_told_its_settings(spark):
    class Asking:
        def prepare(self, det_size, det_thresh):
            self.told = [*det_size, det_thresh]

        def detect(self, image):
            return [(self.told + [0.0], [[0.0, 0.0]] * 5, 1.0)]

    images_ = spark.createDataFrame([("p", "ab" * 32, 4, 4, 3, bytearray(48))], "path string, image_hash string, height int, width int, channels int, pixels binary")
    assert imaging.detect(images_, Asking, det_size=(320, 200), det_thresh=0.25).first()["bbox"] == [320.0, 200.0, 0.25, 0.0]
    crops = spark.createDataFrame([("f", [bytearray(112 * 112 * 3)])], "face_id string, crops array<binary>")
    with pytest.raises(Exception, match="not 512"):
        imaging.embed(crops, imaging.MeanColorEmbedder, dimension=512).collect()


def test_robust_alignment_leaves_an_outlier_out():
    rng = np.random.default_rng(2)
    turn = imaging.similarity(np.array([[0.0, 0], [1, 0]]), np.array([[3.0, 4], [5, 7]]))
    source = imaging.TEMPLATE.copy()
    target = source @ turn[:, :2].T + turn[:, 2] + rng.normal(size=(5, 2)) * 0.01
    target[3] += 60
    assert np.abs(imaging.robust_similarity(source, target) - turn).max() < 0.05 < np.abs(imaging.similarity(source, target) - turn).max()


def test_dbscan_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(25, 2)) * 0.2 + c for c in ((0, 0), (3, 3))] + [rng.uniform(-8, 8, (12, 2))])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    eps, least = 0.35, 3
    core = (d <= eps).sum(1) >= least
    parent = list(range(len(v)))
    for i, j in itertools.combinations(range(len(v)), 2):
        if core[i] and core[j] and d[i, j] <= eps:
            a, b = sorted((parent[i], parent[j]))
            parent = [a if p == b else p for p in parent]
    names = {c: k for k, c in enumerate(sorted({parent[i] for i in range(len(v)) if core[i]}))}
    want = [names[parent[i]] if core[i] else min((names[parent[j]] for j in range(len(v)) if core[j] and d[i, j] <= eps), default=-1) for i in range(len(v))]
    got = {r["id"]: r["label"] for r in clustering.dbscan(frame(spark, v), eps, least).collect()}
    assert [got[i] for i in range(len(v))] == want


def test_noisy_rows_fall_back(spark):
    rng = np.random.default_rng(5)
    got = clustering.cluster(frame(spark, rng.normal(size=(12, 3))), clustering.ClusterConfig(noise_fallback_ratio=-1.0, eps=100.0)).collect()
    assert {r["label"] for r in got} == {0}


# --- refinement

def test_refine_returns_every_row(spark):
    rng = np.random.default_rng(1)
    rows = frame(spark, rng.normal(size=(10, 16)), label=[0, 0, 0, 1, 1, 1, 2, 2, -1, -1], probability=[0.9, 0.8, 0.7, 0.9, 0.6, 0.5, 0.8, 0.7, 0.1, 0.05])
    got = refine.refine(rows).collect()
    assert sorted(r["id"] for r in got) == list(range(10)) and all(0 <= r["confidence"] <= 1 for r in got)
    assert all(r["in_review"] == (r["label"] == -1 or r["confidence"] < 0.4) for r in got)


def test_merge_plan_against_recomputation():
    rng = np.random.default_rng(2)
    for _ in range(20):
        v, labels = rng.normal(size=(30, 3)), rng.integers(0, 8, 30)
        names = sorted(set(labels.tolist()))
        total = np.stack([v[labels == k].sum(0) for k in names])
        plan = refine.merge_plan(names, np.array([(labels == k).sum() for k in names]), total, 0.5)
        own = labels.copy()
        while True:
            left = sorted(set(own.tolist()))
            means = [v[own == k].mean(0) for k in left]
            best = min(((1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), i, j) for (i, a), (j, b) in itertools.combinations(zip(left, means, strict=True), 2)), default=None)
            if best is None or best[0] >= 0.5:
                break
            own[own == best[2]] = best[1]
        assert [plan[k] for k in labels.tolist()] == own.tolist()


def test_split_two_groups(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(6, 4)) * 0.05 + [1, 0, 0, 0], rng.normal(size=(5, 4)) * 0.05 + [-1, 0.2, 0, 0], rng.normal(size=(3, 4)) * 0.05 + [0, 0, 1, 0]])
    got = {r["id"]: r["label"] for r in refine.split_clusters(frame(spark, v, label=[0] * 11 + [5] * 3), 0.8).select("id", "label").collect()}
    assert {got[i] for i in range(6)} == {0} and {got[i] for i in range(6, 11)} == {6} and {got[i] for i in range(11, 14)} == {5}


# --- thresholds, nearest rows

def test_thresholds(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(30, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = frame(spark, v)
    stats = thresholds.distance_stats(rows)
    d = np.array([1 - v[i] @ v[j] for i, j in itertools.combinations(range(30), 2)])
    one = stats.first()
    assert one["num_pairs"] == len(d) and np.allclose([one["mean"], one["std"], one["min"], one["max"]], [d.mean(), d.std(), d.min(), d.max()])
    assert np.allclose([one[f"p{p}"] for p in thresholds.PERCENTILES], np.percentile(d, thresholds.PERCENTILES))
    t = thresholds.thresholds(stats).first().asDict()
    assert len(t) == 4 and all(x > 0 for x in t.values())
    off = thresholds.thresholds(stats, thresholds.ThresholdConfig(enabled=False, fixed_merge=0.9)).first()
    assert tuple(off) == (0.3, 0.8, 0.4, 0.6)
    fixed = thresholds.thresholds(stats, thresholds.ThresholdConfig(fixed_merge=0.9)).first()
    assert fixed["merge_threshold"] == 0.9 and fixed["reassign_threshold"] == 1.8
    assert tuple(thresholds.thresholds(thresholds.distance_stats(rows.limit(1)), rows=1).first()) == (0.3, 0.8, 0.4, 0.6)
    assert json.loads(thresholds.threshold_report(stats).first()[0])["statistics"]["num_pairs"] == len(d)


@pytest.mark.parametrize("most", [similarity.MOST_NUMBERS, 40])
def test_nearest_by_table_and_by_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "MOST_NUMBERS", most)
    rng = np.random.default_rng(8)
    v, t = rng.normal(size=(40, 6)), rng.normal(size=(15, 6))
    t[3] = t[9]
    rows, targets = frame(spark, v), spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(t)], "pos int, centroid array<double>")
    got = {r["id"]: r for r in similarity.nearest(rows, targets, id_col="id", vec_col="emb", key_col="pos", target_col="centroid").collect()}
    d = similarity.distances(v, t, "cosine")
    assert [got[i]["pos"] for i in range(40)] == [int(np.flatnonzero(x <= x.min() + 1e-12)[0]) for x in d] and np.allclose([got[i]["distance"] for i in range(40)], d.min(1))
    assert similarity.nearest(rows, targets.limit(0), id_col="id", vec_col="emb", key_col="pos", target_col="centroid").count() == 0


def test_knn_in_several_blocks(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(50, 5))
    got = {}
    for r in similarity.knn(frame(spark, v), 4, block=12).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"]))
    d = similarity.distances(v, v, "cosine")
    np.fill_diagonal(d, np.inf)
    assert {i: [n for _, n in sorted(x)] for i, x in got.items()} == {i: np.argsort(d[i])[:4].tolist() for i in range(50)}
    pairs = similarity.pairwise(frame(spark, v), at_most=0.5, block=12).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {(i, j) for i, j in itertools.combinations(range(50), 2) if d[i, j] <= 0.5}


# --- evaluation, identities

def test_evaluation(spark):
    rows = lambda p, g: spark.createDataFrame(list(zip(p, g, strict=True)), "pred int, gt int")
    good = evaluate.evaluation_report(rows([0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 0, 0, 1, 1, 1, 2, 2, 2])).first()
    assert all(np.isclose(good[m], 1) for m in ("ari", "nmi", "f1", "purity"))
    assert evaluate.evaluation_report(rows([0, 1, 0, 1, 0, 1], [0, 0, 0, 1, 1, 1])).first()["f1"] < 1
    noise = evaluate.evaluation_report(rows([-1, -1, 0], [1, 1, 1])).first()
    assert noise["valid"] == 1 and noise["f1"] is None and np.isclose(noise["noise_ratio"], 2 / 3)


def test_learning_twice_merges(spark):
    e = np.eye(4)
    faces = frame(spark, [e[0], e[0] + 0.05, e[1], e[2], e[2] + 0.02])
    changes = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (99, 3), (3, -2)], "id bigint, label int")
    known = identities.learn(faces, changes)
    assert [(r["pos"], r["identity_id"], r["n"]) for r in known.orderBy("pos").collect()] == [(0, "Person_000", 2), (1, "Person_001", 1)]
    more = identities.learn(faces, spark.createDataFrame([(1, 0), (4, 2)], "id bigint, label int"))
    merged = identities.merge_identities(known.select("pos", "identity_id", "centroid"), more, 0.3).orderBy("pos").collect()
    assert [(r["pos"], r["identity_id"]) for r in merged] == [(0, "Person_000"), (1, "Person_001"), (2, "Person_002")]
    assert all(np.isclose(np.linalg.norm(r["centroid"]), 1) for r in merged)
    hits = {r["id"]: r["pos"] for r in identities.classify_known(faces, known, 0.4).collect()}
    assert hits == {0: 0, 1: 0, 2: 1, 3: None, 4: None}


# --- scalars, configuration, reports

def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("c")).first()["c"]
    assert value(S.face_id(F.lit("abcdef1234567890abcdef"), F.lit(5))) == "abcdef1234567890_005"
    assert value(S.size_score(F.lit(100.0), F.lit(100.0))) > 0.5 > value(S.size_score(F.lit(15.0), F.lit(15.0)))
    assert value(S.confidence_penalty(F.lit(True), F.lit(0.9))) == 1.0 > value(S.confidence_penalty(F.lit(False), F.lit(0.3)))
    assert value(S.pose_score(*[F.lit(None).cast("double")] * 5)) == 0.5 and value(S.blur_score(F.lit(None).cast("double"))) == 0.0
    assert [value(S.person_number(F.lit(x))) for x in ("Person_012", "noise", "a_b")] == [12, None, None]
    assert value(S.pairs(F.array(*map(F.lit, (1, 2, 3, 4))))) == [[1, 2], [3, 4]]
    points = np.arange(212.0).reshape(106, 2)
    assert np.allclose(value(S.five_of_106(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in points]))), imaging.five_points(points))
    assert value(S.stem(F.lit("/a/.hidden"))) == ".hidden" and value(S.suffix(F.lit("/a/B.JPG"))) == ".jpg"


def test_config(tmp_path):
    assert config.load("/nowhere.yaml") == config.EngineConfig()
    path = tmp_path / "c.yaml"
    path.write_text("clustering: {eps: 0.7}\nadaptive_threshold: {fixed_merge: 0.2}\n")
    found = config.load(str(path))
    assert found.clustering.eps == 0.7 and found.clustering.min_cluster_size == 2 and found.adaptive_threshold.fixed_merge == 0.2
    config.save(found, str(path))
    assert config.load(str(path)) == found
    with pytest.raises(ValueError):
        config.build(config.EngineConfig(), {"copy_mode": "move"})


def test_report_json(spark):
    rows = spark.createDataFrame([(1, 0, "f1", "/a/x.jpg", 0.5, False), (2, 0, "f2", "/b/x.jpg", 0.7, False), (3, 0, "f3", "/a/x.jpg", 0.9, False), (4, -1, "f4", "/a/y.jpg", 0.05, True)], "ord int, label int, face_id string, image_path string, confidence double, in_review boolean")
    found = json.loads(report.report_json(rows).first()[0])
    assert (found["n_clusters"], found["n_faces"], found["n_review"], found["n_noise"]) == (1, 4, 1, 1)
    person = found["clusters"]["Person_000"]
    assert person["face_count"] == 3 and [i["destination"] for i in person["images"]] == ["Person_000/x.jpg", "Person_000/x_1.jpg"] and np.isclose(person["avg_confidence"], 0.7)


# --- pictures

def bmp(pixels):
    h, w, _ = pixels.shape
    row = (3 * w + 3) // 4 * 4
    body = b"".join(pixels[y].tobytes().ljust(row, b"\0") for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_alignment():
    image = np.random.default_rng(0).integers(0, 255, (200, 200, 3), dtype=np.uint8)
    points = imaging.TEMPLATE + 30
    crop = imaging.align(image, points)
    assert crop.shape == (112, 112, 3) and np.array_equal(crop, image[30:142, 30:142])
    assert imaging.align(image, points.ravel()).shape == (112, 112, 3) and imaging.align(image, points[:2]) is None
    assert imaging.align(image, points, degrees=5, scale=1.05).shape == (112, 112, 3)
    assert imaging.laplacian_variance(np.full((9, 9, 3), 7, np.uint8)) == 0


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.bmp", "sub/b.BMP", "broken.bmp", "document.pdf"):
        (tmp_path / name).write_bytes(b"no picture" if name in ("broken.bmp", "document.pdf") else bmp(np.full((4, 6, 3), 9, np.uint8)))
    files = images.scan(spark, str(tmp_path))
    assert sorted(r["filename"] for r in images.info(files).collect()) == ["a.bmp", "b.BMP", "broken.bmp"]
    assert images.scan(spark, str(tmp_path), recursive=False).count() == 2
    decoded = images.decode(spark, str(tmp_path)).collect()
    assert len(decoded) == 2 and all((r["height"], r["width"], r["channels"]) == (4, 6, 3) for r in decoded)
    assert [r["path"].rsplit("/", 1)[1] for r in images.undecoded(files, images.decode(spark, str(tmp_path))).collect()] == ["broken.bmp"]
    (tmp_path / "none").mkdir()
    assert images.scan(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        images.scan(spark, str(tmp_path / "missing")).count()


def test_reducers(spark):
    v = np.random.default_rng(1).normal(size=(20, 12))
    rows = frame(spark, v)
    assert imaging.NoReducer().reduce(rows, "emb") is rows
    assert imaging.PcaReducer(5).reduce(rows.limit(2), "emb").first()["emb"] == rows.limit(2).first()["emb"]
    assert len(imaging.PcaReducer(5).reduce(rows, "emb").first()["emb"]) == 5
    assert {(r["x"], r["y"]) for r in imaging.project_2d(rows.limit(2)).collect()} == {(0.0, 0.0)}


# --- the engine

def faces_folder(folder):
    rng = np.random.default_rng(3)
    people = [rng.integers(0, 255, (8, 8, 3)) for _ in range(3)]
    for k in range(9):
        block = np.kron(people[k % 3], np.ones((16, 16, 1)))[:112, :112]
        image = np.zeros((140, 140, 3))
        image[10:122, 10:122] = block
        image += rng.integers(0, 6, image.shape)
        (folder / f"p{k}.bmp").write_bytes(bmp(image.clip(0, 255).astype(np.uint8)))


def make_detector():
    import numpy as np

    template = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])

    class Whole:
        def detect(self, image):
            if image[0, 0].sum() > 700:
                raise RuntimeError("no face")
            return [([10, 10, 122, 122], (template + 10).tolist(), 0.9), ([0, 0, 5, 5], template.tolist(), 0.2)]

    return Whole()


def test_engine_end_to_end(spark, tmp_path):
    from pyspark import cloudpickle

    import tests.test_operators as here
    from kinweave.plans.engine import Engine

    cloudpickle.register_pickle_by_value(here)
    photos, out = tmp_path / "photos", tmp_path / "out"
    photos.mkdir()
    faces_folder(photos)
    (photos / "blank.bmp").write_bytes(bmp(np.full((20, 20, 3), 255, np.uint8)))
    (photos / "lost.webp").write_bytes(b"RIFF....WEBP")
    settings = config.build(config.EngineConfig(), {"input_dir": str(photos), "output_dir": str(out), "clustering": {"min_cluster_size": 2}, "adaptive_threshold": {"fixed_merge": 0.05, "fixed_split": 1.9, "fixed_review": 0.2}})
    engine = Engine(spark, settings, make_detector)
    got = engine.run()
    assert engine.counts == {"images": 11, "faces": 9, "skipped_decode": 1, "skipped_detect": 1, "skipped_gate": 0, "skipped_align": 0, "skipped_embed": 0}
    assert {(r["image_path"].rsplit("/", 1)[1], r["stage"]) for r in engine.workspace.read("skipped").collect()} == {("blank.bmp", "detect"), ("lost.webp", "decode")}
    assert engine.progress.state["status"] == "done" and engine.progress.state["progress"] == 100
    assert (out / "_metadata" / "confidence_heatmap.png").read_bytes()[:4] == b"\x89PNG"
    assert engine.review_items().count() <= 9 and engine.face_metadata().count() == 9
    assert "thresholds" in json.loads(next((out / "_metadata" / "threshold_report").glob("*.txt")).read_text())
    people = {r["face_id"]: int(r["image_path"].rsplit("/p", 1)[1].split(".")[0]) % 3 for r in engine.workspace.read("faces").collect()}
    assert len(people) == 9
    labels = {}
    for r in got.collect():
        labels.setdefault(r["label"], set()).add(people[r["face_id"]])
    assert len(labels) == 3 and all(len(p) == 1 for p in labels.values())
    report_ = json.loads((next((out / "_metadata" / "cluster_report").glob("*.txt"))).read_text())
    assert report_["n_faces"] == 9 and report_["n_clusters"] == 3
    (out / "Person_777").mkdir()
    (out / "Person_777" / "old.bmp").write_bytes(b"")
    copied = engine.copy_files()
    assert copied["photos"] == 9 and copied["missing"] == 0 and len(list(out.glob("Person_*/*.bmp"))) == 9 and not (out / "Person_777").exists()
    crops = list(out.glob("Person_*/crops/*.png"))
    assert len(crops) == 9 and copied["crops"] >= 9 and all(c.read_bytes()[:8] == b"\x89PNG\r\n\x1a\n" for c in crops) and (out / "_metadata").exists()
    rng = np.random.default_rng(9)
    (photos / "p9.bmp").write_bytes(bmp((np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((18, 18, 1)))[:140, :140] * 0.9).astype(np.uint8)))
    engine.run(incremental=True)
    assert engine.counts["images"] == 1 and engine.counts["faces"] == 1 and engine.workspace.read("faces").count() == 10
    some = sorted(people)[0]
    engine.review_action(some, "accept")
    engine.review_action(some, "new")
    with pytest.raises(ValueError):
        engine.review_action(some, "move")
    known = engine.learn()
    assert known.count() == 1 and engine.workspace.read("corrections").count() == 1
    assert engine.learn().count() == 1
    truth = tmp_path / "truth.json"
    truth.write_text(json.dumps({f"p{k}.bmp": k % 3 for k in range(9)}))
    measured = engine.evaluate(str(truth)).first()
    assert measured["total"] == 9
    grid = engine.calibrate(str(truth)).collect()
    assert sum(r["best"] for r in grid) == 1 and next(r["f1"] for r in grid if r["best"]) == max(r["f1"] for r in grid)
    assert engine.apply_corrections().count() == 10
    assert json.loads(engine.status())["n_identities"] == 1
    # two photos once more, under other names: every face is in every report once
    (photos / "q0.bmp").write_bytes((photos / "p0.bmp").read_bytes())
    (photos / "q1.bmp").write_bytes((photos / "p1.bmp").read_bytes())
    assert engine.run().count() == 12 and engine.face_metadata().count() == 12
    known = engine.workspace.read("assignments").filter("label >= 0").count()
    assert engine.workspace.read("plot_points").count() == 12 and engine.workspace.read("manifest").count() == known
    assert json.loads((next((out / "_metadata" / "cluster_report").glob("*.txt"))).read_text())["n_faces"] in (known, 12)
    assert engine.copy_files()["photos"] == len(list(out.glob("Person_*/*.bmp")))
    assert engine.evaluate(str(truth)).first()["total"] == 9


def test_command_line_without_faces(spark, tmp_path, capsys, monkeypatch):
    from kinweave.__main__ import main

    monkeypatch.chdir(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bmp").write_bytes(bmp(np.full((4, 4, 3), 9, np.uint8)))
    assert main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0]) == {"photos": 0, "missing": 0, "crops": 0}


def test_streams(spark, tmp_path):
    from kinweave.streaming import ingest

    photos = tmp_path / "photos"
    photos.mkdir()
    for k in range(3):
        (photos / f"{k}.bmp").write_bytes(bmp(np.full((4, 4, 3), min(k, 1), np.uint8)))
    w, seen = tables.Workspace(spark, str(tmp_path / "w")), []
    go = lambda: ingest.new_images(spark, str(photos), w, str(tmp_path / "c"), lambda rows, n: seen.append(rows.count())).awaitTermination()
    go()
    assert sum(seen) == 2 and w.read("processed_images").count() == 2
    (photos / "9.bmp").write_bytes(bmp(np.full((4, 4, 3), 9, np.uint8)))
    go()
    assert sum(seen) == 3 and w.read("processed_images").count() == 3
    folder = tmp_path / "changes"
    spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 5, 3)], "face_id string, label int, seq bigint").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema("face_id string, label int, seq bigint").parquet(str(folder))
    ingest.corrections(stream, w, str(tmp_path / "c2")).awaitTermination()
    assert sorted((r["face_id"], r["label"]) for r in w.read("corrections").collect()) == [("a", 5), ("b", 2)]
    vectors = tmp_path / "vectors"
    spark.createDataFrame([("p", [1.0, 0.0], 1), ("p", [0.0, 1.0], 2), ("q", [3.0, 4.0], 3)], "identity_id string, emb array<double>, seq bigint").coalesce(1).write.parquet(str(vectors))
    rows = spark.readStream.schema("identity_id string, emb array<double>, seq bigint").parquet(str(vectors))
    q = ingest.running_centroids(rows).writeStream.outputMode("update").format("memory").queryName("centroids").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["identity_id"]: (r["n"], r["centroid"]) for r in spark.sql("SELECT * FROM centroids").collect()}
    assert got["p"][0] == 2 and np.allclose(got["p"][1], [0.5**0.5] * 2) and np.allclose(got["q"][1], [0.6, 0.8])


def test_workspace(spark, tmp_path):
    w = tables.Workspace(spark, str(tmp_path))
    assert w.read("faces").count() == 0 and "embedding" in w.read("faces").columns
    rows = spark.createDataFrame([("a", 1, 1)], "face_id string, label int, seq bigint")
    w.write("corrections", rows)
    w.write("corrections", w.read("corrections").unionByName(rows))
    assert w.append("corrections", rows).count() == 3
    w.clear("corrections")
    assert w.read("corrections").count() == 0
    (tmp_path / "t.json").write_text('{"a": 0, "b.jpg": 3}')
    assert sorted(map(tuple, tables.load_ground_truth(spark, str(tmp_path / "t.json")).collect())) == [("a", 0), ("b.jpg", 3)]
    (tmp_path / "x.log").write_text("\n".join(map(str, range(500))))
    last = tables.read_log(spark, str(tmp_path / "x.log"), 3).collect()
    assert [r["line"] for r in last] == ["497", "498", "499"] and last[0]["total"] == 500


def test_command_line():
    from kinweave.__main__ import main

    assert main(["--evaluate", "--output", "x"]) == 1 and main(["--output", "x"]) == 1


def test_progress(tmp_path):
    from kinweave.streaming.progress import Broadcaster, setup_logging

    b = Broadcaster(2)
    q, slow = b.subscribe(), b.subscribe()
    b.step("scan")
    b.step("detect")
    assert q.get()["step"] == "scan" and q.get()["progress"] == 15
    b.step("done")
    assert len(b.queues) == 1 and q.get()["status"] == "done" and slow.qsize() == 2
    setup_logging(str(tmp_path), console=False).info("x")
    assert "| INFO     | x" in (tmp_path / "pipeline.log").read_text()


@pytest.mark.parametrize("kind", ["UMAP", "PCA", ""])
def test_unknown_reducers_are_refused(spark, kind):
    from kinweave.plans import engine

    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, emb array<double>")
    with pytest.raises(ValueError, match="reducer.kind"):
        engine.group(rows, rows.limit(0), config.EngineConfig(reducer=config.ReducerConfig(kind=kind)))


class _Cluster:
    """Enough of a session on a cluster without a checkpoint folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

        class _jsc:
            @staticmethod
            def sc():
                class Held:
                    getCheckpointDir = staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))

                return Held

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph.shared_dir(_Cluster)
