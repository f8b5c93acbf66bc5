"""Models in ONNX files, which are built here byte by byte; suppression of boxes; the rasteriser and the picture."""

from functools import partial

import numpy as np
import pytest

from kinweave.operators import imaging, raster, report
from tests.test_operators import bmp

# --- a small writer of ONNX files


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def num(field, n):
    return varint(field << 3) + varint(n)


def part(field, body):
    body = body.encode() if isinstance(body, str) else body
    return varint(field << 3 | 2) + varint(len(body)) + body


def ints(name, *values):
    return part(5, part(1, name) + b"".join(num(8, v) for v in values) + num(20, 7))


def node(kind, inputs, output, *attributes):
    return part(1, b"".join(part(1, i) for i in inputs) + part(2, output) + part(4, kind) + b"".join(attributes))


def tensor(name, array):
    kind = {"f": 1, "i": 7}[array.dtype.kind]
    return part(5, b"".join(num(1, d) for d in array.shape) + num(2, kind) + part(8, name) + part(9, array.tobytes()))


def value(field, name, *dims):
    shape = b"".join(part(1, num(1, d) if isinstance(d, int) else part(2, d)) for d in dims)
    return part(field, part(1, name) + part(2, part(1, num(1, 1) + part(2, shape))))


def model(graph):
    return num(1, 8) + part(7, graph + part(2, "g")) + part(8, part(1, "") + num(2, 13))


def detector_file(path, size, strides=(8, 16, 32)):
    """Scores are the brightness of each place; boxes reach one stride from the anchor, landmarks lie on a small pattern."""
    graph, pattern = b"", np.array([[-0.3, -0.3], [0.3, -0.3], [0, 0], [-0.2, 0.3], [0.2, 0.3]], np.float32)
    for s in strides:
        n = (size // s) ** 2
        graph += node("AveragePool", ["x"], f"p{s}", ints("kernel_shape", s, s), ints("strides", s, s))
        graph += node("ReduceMean", [f"p{s}"], f"m{s}", ints("axes", 1)) + node("Reshape", [f"m{s}", "column"], f"score{s}")
        graph += node("Identity", [f"b{s}"], f"box{s}") + node("Identity", [f"k{s}"], f"kps{s}")
        graph += tensor(f"b{s}", np.ones((n, 4), np.float32)) + tensor(f"k{s}", np.tile(pattern.reshape(1, 10), (n, 1)))
    graph += tensor("column", np.array([-1, 1], np.int64)) + value(11, "x", 1, 3, size, size)
    for what, d in (("score", 1), ("box", 4), ("kps", 10)):
        for s in strides:
            graph += value(12, f"{what}{s}", (size // s) ** 2, d)
    path.write_bytes(model(graph))
    return str(path), pattern


def embedder_file(path):
    """The mean of each channel."""
    path.write_bytes(model(node("ReduceMean", ["x"], "m", ints("axes", 2, 3)) + node("Reshape", ["m", "rows"], "v") + tensor("rows", np.array([-1, 3], np.int64)) + value(11, "x", "n", 3, 112, 112) + value(12, "v", "n", 3)))
    return str(path)


# --- models


def test_detector_finds_known_boxes(tmp_path):
    path, pattern = detector_file(tmp_path / "d.onnx", 64)
    d = imaging.OnnxDetector(path)
    d.prepare(det_size=(64, 64), det_thresh=0.9)
    image = np.zeros((64, 64, 3), np.uint8)
    image[16:24, 32:40] = 255
    ((box, points, score),) = d.detect(image)
    assert box == [24, 8, 40, 24] and score == pytest.approx(127.5 / 128)
    assert np.allclose(points, np.array([32, 16]) + pattern * 8, atol=1e-4)
    ((box, points, _),) = d.detect(image.repeat(2, 0).repeat(2, 1))  # twice as large
    assert box == [48, 16, 80, 48] and np.allclose(points, np.array([64, 32]) + pattern * 16, atol=1e-3)
    wide = np.zeros((32, 64, 3), np.uint8)  # not square: what is below stays dark
    wide[:8, :8] = 255
    assert [b for b, _, _ in d.detect(wide)] == [[-8, -8, 8, 8]]
    assert d.detect(np.zeros((64, 64, 3), np.uint8)) == [] and len(d.detect(image[:, :, :1])) == 1
    image[16:24, 40:48] = 255  # the boxes of neighbours overlap by a third: both stay
    assert [b for b, _, _ in d.detect(image)] == [[24, 8, 40, 24], [32, 8, 48, 24]]
    d.overlap = 0.3
    assert [b for b, _, _ in d.detect(image)] == [[24, 8, 40, 24]]
    d.prepare(det_size=(60, 33))
    assert d.size == (64, 64)
    with pytest.raises(ValueError, match="outputs"):
        imaging.OnnxDetector(path, strides=(8, 16))


def test_suppression_against_brute_force():
    def iou(a, b):
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return both / max(1e-12, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 60):
        corner = rng.uniform(0, 40, (n, 2))
        boxes, scores = np.concatenate([corner, corner + rng.uniform(5, 20, (n, 2))], 1), rng.integers(0, 9, n) / 9
        stay = []
        for i in sorted(range(n), key=lambda i: (-scores[i], i)):
            if all(iou(boxes[i], boxes[j]) <= 0.4 for j in stay):
                stay.append(i)
        assert imaging.apart(boxes, scores).tolist() == stay


def test_resized():
    image = np.arange(48.0).reshape(4, 4, 3)
    assert np.array_equal(imaging.resized(image, 4, 4), image)
    assert np.array_equal(imaging.resized(image, 2, 2), image.reshape(2, 2, 2, 2, 3).mean((1, 3)))
    assert (imaging.resized(np.full((5, 3, 3), 7.0), 11, 2) == 7).all()


def test_run_with_model_files(spark, tmp_path):
    from kinweave.plans.engine import Engine
    from kinweave.sources import config

    photos, out = tmp_path / "photos", tmp_path / "out"
    photos.mkdir()
    for k in range(3):
        image = np.zeros((64, 64, 3), np.uint8)
        image[16:24, 32:40] = 255
        image[:, :, k] = np.maximum(image[:, :, k], 40)
        (photos / f"{k}.bmp").write_bytes(bmp(image))
    settings = config.build(config.EngineConfig(), {"input_dir": str(photos), "output_dir": str(out), "detection": {"det_size": [64, 64], "det_thresh": 0.9}})
    detector, embedder = detector_file(tmp_path / "d.onnx", 64)[0], embedder_file(tmp_path / "e.onnx")
    spark.sparkContext.addFile(embedder)
    engine = Engine(spark, settings, partial(imaging.OnnxDetector, detector), partial(imaging.OnnxEmbedder, "e.onnx"))  # a path, and a name of a file that was sent along
    faces = engine.ingest().collect()
    assert len(faces) == 3 and all(list(r["bbox"]) == [24, 8, 40, 24] and len(r["embedding"]) == 3 for r in faces)
    assert all(np.isclose(np.linalg.norm(r["embedding"]), 1, atol=1e-5) for r in faces) and len({tuple(r["embedding"]) for r in faces}) == 3


# --- the picture


def test_letters_and_markers():
    assert ["".join(".#"[int(v)] for v in row) for row in raster.glyph("P")] == ["####.", "#...#", "#...#", "####.", "#....", "#....", "#...."]
    assert raster.text_mask("P001").shape == (7, 23) and raster.text_mask("P1", 2).shape == (14, 22) and raster.text_mask("").shape == (7, 0)
    assert not raster.glyph("é").any() and np.array_equal(raster.glyph("a"), raster.glyph("A"))
    assert len({raster.glyph(c).tobytes() for c in raster.FONT}) == len(raster.FONT)
    assert raster.marker_mask("x", 2).sum() == 9 and raster.marker_mask("D", 2).sum() == 13 and raster.marker_mask("o", 1).sum() == 5
    assert raster.marker_mask("o", 4).sum() > raster.marker_mask("D", 4).sum()
    assert raster.radius_of(30) < raster.radius_of(140) and raster.radius_of(0) == 1


def test_paint_is_cut_at_the_borders():
    image = np.full((5, 5, 3), 255.0)
    raster.paint(image, np.ones((3, 3), bool), -2, -2, np.zeros(3))
    raster.paint(image, np.ones((3, 3), bool), 4, 4, np.zeros(3), 0.5)
    raster.paint(image, np.ones((3, 3), bool), 9, 9, np.zeros(3))
    assert image[0, 0].tolist() == [0, 0, 0] and image[4, 4].tolist() == [127.5] * 3 and (image != 255).sum() == 6


def test_picture(spark):
    rows = [(0, 0.0, 0.0, "o", 140.0, 1.0), (1, 10.0, 0.0, "D", 80.0, 0.8), (-1, 0.0, 10.0, "x", 30.0, 0.5), (1, 10.0, 10.0, "o", 20.0, 1.0)]
    points = spark.createDataFrame(rows, "label int, x double, y double, marker string, size double, alpha double")
    image = report.plot_image(points, 121, 101)
    bottom, right = 100, 120
    assert (image[bottom, :5] != 255).any(1).all() and (image[bottom - 4 : bottom + 1, 0] != 255).any(1).all()  # a disc of radius 4 in the corner
    assert image[bottom, right].tolist() == [51, 51, 255] and image[bottom - 3, right].tolist() == [51, 51, 255]  # a red diamond, of 0.8
    assert (image[bottom - 3, right - 1] == 255).all() and (image[bottom - 2, right - 1] != 255).any()
    assert image[0, 0].tolist() == [191] * 3 and image[1, 1].tolist() == [191] * 3 and (image[0, 1] == 255).all()  # a gray cross
    titled = report.plot_image(points, 121, 101, title="P1\nP2")
    assert titled.shape == (101, 121, 3)
    mask = raster.text_mask("P1")
    top, left = 6 + 3 - 3, 60 - mask.shape[1] // 2
    assert np.array_equal((titled[top : top + 7, left : left + mask.shape[1]] == 0).all(2), mask)
    texts = {r["text"]: (r["px"], r["py"]) for r in report.plot_texts(points, 121, 71).collect()}
    assert texts == {"P000": (0, 0), "P001": (120, 35)}
    name = raster.text_mask("P001")[:, :12]
    y = 30 + 71 - 1 - 35 - 3
    assert np.array_equal((titled[y : y + 7, 120 - 11 : 121] == 0).all(2), name)


def test_many_clusters_send_a_row_a_cell(spark):
    points = spark.range(5000).selectExpr("cast(id as int) as label", "id % 71 as x", "id div 71 as y", "1.0 as alpha").selectExpr("label", "cast(x as double) as x", "cast(y as double) as y", "cast(alpha as double) as alpha")
    assert report.plot_texts(points, 280, 110).count() <= 100
    title = report.plot_title(points.selectExpr("label", "false as in_review"))
    assert title.endswith("5000 clusters - 0 noise - 0 review items")
