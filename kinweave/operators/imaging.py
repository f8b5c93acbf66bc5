"""Pixels and models. Models are given as factories (called once in each Python worker); pixel work runs on Arrow batches."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import l2_normalize, vector_mean

#: The failure of a file that is no picture.
UNREADABLE = "not a picture that can be read"
#: Where eyes, nose and mouth corners lie in an aligned crop of 112 x 112 pixels.
TEMPLATE = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])
CROP = 112


class Detector(Protocol):
    def detect(self, image: np.ndarray) -> list[tuple[list[float], list[list[float]], float]]:
        """(box of 4, landmarks, score) of each face in a BGR image."""


class Embedder(Protocol):
    def embed(self, crops: np.ndarray) -> np.ndarray:
        """Vectors of (n, 112, 112, 3) BGR crops."""


class Reducer(Protocol):
    def reduce(self, rows: DataFrame, vec_col: str) -> DataFrame:
        """rows with another vector column of the same name."""


def onnx_session(path: str):
    """A session of the model in an ONNX file: a path that the executors see, or the name of a file that was given to them by --files or addFile. One thread, since tasks fill the cores."""
    import onnxruntime
    from pyspark import SparkFiles

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    providers = [p for p in ("CUDAExecutionProvider", "CPUExecutionProvider") if p in onnxruntime.get_available_providers()]
    return onnxruntime.InferenceSession(path if os.path.exists(path) else SparkFiles.get(path), options, providers=providers)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """image at another size, bilinear between the middles of pixels."""

    def places(n: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = ((np.arange(n) + 0.5) * old / n - 0.5).clip(0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    y0, y1, fy = places(height, image.shape[0])
    x0, x1, fx = places(width, image.shape[1])
    rows = image[y0] * (1 - fy)[:, None, None] + image[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def apart(boxes: np.ndarray, scores: np.ndarray, most: float = 0.4) -> np.ndarray:
    """Non-maximum suppression: places of the boxes (x1, y1, x2, y2) that stay, best score first (ties: the earlier one); a box goes if one that stays has an intersection over union of more than most with it."""
    left, stay = np.argsort(-scores, kind="stable"), []
    areas = (boxes[:, 2] - boxes[:, 0]).clip(0) * (boxes[:, 3] - boxes[:, 1]).clip(0)
    while len(left):
        one, left = left[0], left[1:]
        stay.append(one)
        both = (np.minimum(boxes[one, 2:], boxes[left, 2:]) - np.maximum(boxes[one, :2], boxes[left, :2])).clip(0).prod(1)
        left = left[both <= most * (areas[one] + areas[left] - both)]
    return np.array(stay, int)


class OnnxDetector:
    """A single-shot face detector with anchors, in an ONNX file. For each stride it has one output of scores (a column), after these one each of distances from an anchor to the box's four sides, after these one each of
    offsets of five landmarks, both in strides. Anchors lie at multiples of the stride, row by row, equally many at each place. Input: RGB, (x - 127.5) / 128, channels first, the picture at the top left of det_size.
    Boxes and landmarks are those of the given image, best score first."""

    def __init__(self, path: str, *, strides: tuple[int, ...] = (8, 16, 32), overlap: float = 0.4):
        self.session = onnx_session(path)
        self.name = self.session.get_inputs()[0].name
        self.strides, self.overlap, self.size, self.least = strides, overlap, (640, 640), 0.5
        if len(self.session.get_outputs()) != 3 * len(strides):
            raise ValueError(f"{path}: {len(self.session.get_outputs())} outputs, not 3 for each of {len(strides)} strides")

    def prepare(self, det_size: tuple[int, int] | None = None, det_thresh: float | None = None) -> None:
        """det_size: width and height, rounded up to multiples of the largest stride."""
        top = max(self.strides)
        self.size = tuple(-(-int(s) // top) * top for s in det_size or self.size)
        self.least = self.least if det_thresh is None else det_thresh

    def detect(self, image: np.ndarray) -> list[tuple[list[float], list[list[float]], float]]:
        width, height = self.size
        image = np.repeat(image, 3, 2) if image.shape[2] == 1 else image[:, :, :3]
        scale = min(height / image.shape[0], width / image.shape[1])
        h, w = max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))
        held = np.zeros((height, width, 3), np.float32)
        held[:h, :w] = np.rint(resized(image.astype(np.float32), h, w))
        outputs = self.session.run(None, {self.name: np.ascontiguousarray(((held[:, :, ::-1] - 127.5) / 128).transpose(2, 0, 1)[None].astype(np.float32))})
        n, found = len(self.strides), []
        for k, stride in enumerate(self.strides):
            scores = outputs[k].reshape(-1)
            y, x = np.mgrid[0 : height // stride, 0 : width // stride]
            anchors, rest = divmod(len(scores), y.size)
            if rest or not anchors:
                raise ValueError(f"{len(scores)} scores don't fit {y.size} places of stride {stride}")
            centres = (np.stack([x.ravel(), y.ravel()], 1) * float(stride)).repeat(anchors, 0)
            sides, points = outputs[n + k].reshape(-1, 4) * stride, outputs[2 * n + k].reshape(-1, 5, 2) * stride
            good = scores >= self.least
            boxes = np.concatenate([centres[good] - sides[good, :2], centres[good] + sides[good, 2:]], 1)
            found.append((boxes, centres[good][:, None] + points[good], scores[good]))
        boxes, points, scores = (np.concatenate(part) for part in zip(*found, strict=True))
        back = np.array([image.shape[1] / w, image.shape[0] / h])
        return [((boxes[i].reshape(2, 2) * back).ravel().tolist(), (points[i] * back).tolist(), float(scores[i])) for i in apart(boxes, scores, self.overlap)]


class OnnxEmbedder:
    """An embedding model in an ONNX file: RGB, (x - 127.5) / 127.5, channels first."""

    def __init__(self, path: str):
        self.session = onnx_session(path)
        self.name = self.session.get_inputs()[0].name

    def embed(self, crops: np.ndarray) -> np.ndarray:
        x = (crops[..., ::-1].astype(np.float32) - 127.5) / 127.5
        return self.session.run(None, {self.name: np.ascontiguousarray(x.transpose(0, 3, 1, 2))})[0]


class MeanColorEmbedder:
    """A deterministic stand-in for tests: mean colours of a grid of cells."""

    def __init__(self, cells: int = 8):
        self.cells = cells

    def embed(self, crops: np.ndarray) -> np.ndarray:
        n, c = len(crops), self.cells
        side = CROP // c
        return crops[:, : c * side, : c * side].astype(np.float64).reshape(n, c, side, c, side, 3).mean((2, 4)).reshape(n, -1) - 127.5


class NoReducer:
    def reduce(self, rows: DataFrame, vec_col: str) -> DataFrame:
        return rows


class PcaReducer:
    """Principal components; fewer rows than three pass through, and there are never more components than rows less one."""

    def __init__(self, components: int = 50):
        self.components = components

    def reduce(self, rows: DataFrame, vec_col: str) -> DataFrame:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector, vector_to_array

        shape = rows.agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("d")).first()
        if shape["n"] < 3:
            return rows
        k = min(self.components, shape["n"] - 1, shape["d"])
        v = rows.withColumn("__v", array_to_vector(F.col(vec_col).cast("array<double>")))
        out = PCA(k=k, inputCol="__v", outputCol="__p").fit(v).transform(v)
        return out.withColumn(vec_col, vector_to_array("__p")).drop("__v", "__p")


def project_2d(rows: DataFrame, vec_col: str = "emb") -> DataFrame:
    """rows with x and y; zeros for fewer than three rows."""
    if len(rows.limit(3).collect()) < 3:
        return rows.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    return PcaReducer(2).reduce(rows.withColumn("__two", F.col(vec_col)), "__two").withColumns({"x": F.element_at("__two", 1), "y": F.element_at("__two", 2)}).drop("__two")


def gray(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.114, 0.587, 0.299])


def laplacian_variance(image: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian of a gray image; mirrored at the borders without repeating them."""
    g = np.pad(np.round(gray(image)) if image.ndim == 3 else image.astype(float), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """2 x 3 matrix of the least-squares similarity from source to target points; the identity if the source points coincide."""
    ms, mt = source.mean(0), target.mean(0)
    s, t = source - ms, target - mt
    power = (s * s).sum()
    if power < 1e-12:
        return np.array([[1.0, 0, 0], [0, 1, 0]])
    a = (s * t).sum() / power
    b = (s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]).sum() / power
    turn = np.array([[a, -b], [b, a]])
    return np.hstack([turn, (mt - turn @ ms)[:, None]])


def robust_similarity(source: np.ndarray, target: np.ndarray, within: float = 5.0) -> np.ndarray:
    """As similarity(), of those points only that agree: of the maps that two points fix, the one that brings most points within a distance of their targets (ties: the least squares of these) chooses them. All points if
    no two agree with a third."""
    best, chosen = (2, 0.0), None
    for i, j in combinations(range(len(source)), 2):
        m = similarity(source[[i, j]], target[[i, j]])
        off = np.linalg.norm(source @ m[:, :2].T + m[:, 2] - target, axis=1)
        near = off <= within
        rank = (int(near.sum()), -float((off[near] ** 2).sum()))
        if rank > best and near.sum() > 2:
            best, chosen = rank, near
    return similarity(source, target) if chosen is None else similarity(source[chosen], target[chosen])


def warp(image: np.ndarray, matrix: np.ndarray, size: int = CROP) -> np.ndarray:
    """image under the similarity matrix, bilinear, edges repeated."""
    inverse = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    y, x = np.mgrid[0:size, 0:size]
    at = inverse[:2] @ np.stack([x.ravel(), y.ravel(), np.ones(size * size)])
    h, w = image.shape[:2]
    px, py = at[0].clip(0, w - 1), at[1].clip(0, h - 1)
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (px - x0)[:, None], (py - y0)[:, None]
    i = image.astype(float)
    out = i[y0, x0] * (1 - fx) * (1 - fy) + i[y0, x1] * fx * (1 - fy) + i[y1, x0] * (1 - fx) * fy + i[y1, x1] * fx * fy
    return np.rint(out).clip(0, 255).astype(np.uint8).reshape(size, size, -1)


def five_points(landmarks: np.ndarray) -> np.ndarray | None:
    """Five of the landmarks, flat or as pairs; None with fewer than five."""
    points = np.asarray(landmarks, float).reshape(-1, 2)
    if len(points) < 5:
        return None
    if len(points) < 106:
        return points[:5]
    return np.stack([points[33:43].mean(0), points[87:97].mean(0), points[86], points[52], points[61]])


def align(image: np.ndarray, landmarks: np.ndarray, *, degrees: float = 0.0, scale: float = 1.0, size: int = CROP) -> np.ndarray | None:
    """The crop in which the landmarks, turned and scaled about their mean first, lie on the template."""
    points = five_points(landmarks)
    if points is None:
        return None
    t = np.deg2rad(degrees)
    turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    middle = points.mean(0)
    return warp(image, robust_similarity((points - middle) @ turn.T * scale + middle, TEMPLATE * size / CROP), size)


def image_of(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels)


def views(image: np.ndarray, landmarks: np.ndarray, seed: int, *, perturbations: int = 2, rotation: float = 5.0, jitter: float = 0.05) -> list[bytes] | None:
    """The aligned crop and perturbed ones, turned and scaled by repeatable random amounts; None without five landmarks."""
    first = align(image, landmarks)
    if first is None:
        return None
    rng = np.random.default_rng(seed)
    turns = [(rng.uniform(-rotation, rotation), 1 + rng.uniform(-jitter, jitter)) for _ in range(perturbations)]
    return [first.tobytes()] + [align(image, landmarks, degrees=d, scale=s).tobytes() for d, s in turns]


def png(image: np.ndarray) -> bytes:
    """A PNG file of a BGR image."""
    h, w = image.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image[:, :, ::-1].reshape(h, -1)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def detect(images: DataFrame, detector: Callable[[], Detector], *, det_size: tuple[int, int] | None = None, det_thresh: float | None = None, **options) -> DataFrame:
    """(image_path, image_hash, bbox, landmarks, det_score, ordinal, lap_var, crops, failure) per face found, with the crops of views(). An image on which the detector fails has one row with the failure's text and
    no face, so has one without pixels (height below 1). A detector that has prepare() is told det_size and det_thresh once. images: (path, image_hash, height, width, channels, pixels); one picture is held at a time besides Arrow's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = detector()
        if hasattr(model, "prepare"):
            model.prepare(det_size=det_size, det_thresh=det_thresh)
        names = ["image_path", "image_hash", "bbox", "landmarks", "det_score", "ordinal", "lap_var", "crops", "failure"]
        kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.binary()), pa.string()]
        for batch in batches:
            for row in range(batch.num_rows):
                path, image_hash, height, width, channels, pixels = (batch.column(c)[row].as_py() for c in range(6))
                out: list[tuple] = []
                if height < 1:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, image_hash, *[None] * 6, UNREADABLE), kinds, strict=True)], names)
                    continue
                try:
                    image = image_of(pixels, height, width, channels)
                    found = model.detect(image)
                except Exception as e:  # the model's own: any kind
                    found = []
                    out.append((path, image_hash, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                for k, (box, landmarks, score) in enumerate(found):
                    x1, y1, x2, y2 = max(0, int(box[0])), max(0, int(box[1])), min(width, int(box[2])), min(height, int(box[3]))
                    part = image[y1:y2, x1:x2]
                    crops = views(image, np.array(landmarks), int(image_hash[:12], 16) + k, **options)
                    out.append((path, image_hash, [float(b) for b in box], [[float(a) for a in p] for p in landmarks], float(score), k, laplacian_variance(part) if part.size else None, crops, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "image_path string, image_hash string, bbox array<double>, landmarks array<array<double>>, det_score double, ordinal int, lap_var double, crops array<binary>, failure string"
    return images.select("path", "image_hash", "height", "width", "channels", "pixels").mapInArrow(run, schema)


def encoded(rows: DataFrame) -> DataFrame:
    """(name, content) of rows (name, crop): crops as PNG files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([png(image_of(x.as_py(), CROP, CROP, 3)) for x in b.column(1)], pa.binary())], ["name", "content"])

    return rows.select("name", "crop").mapInArrow(run, "name string, content binary")


def embed(faces: DataFrame, embedder: Callable[[], Embedder], *, id_col: str = "face_id", flip: bool = True, dimension: int | None = None) -> DataFrame:
    """(id, embedding): the unit mean of the unit vectors of each face's crops and the first one's mirror image. A face without crops, or whose first crop or mean has a zero vector, is left out;
    other zero vectors are skipped. All crops of a batch go through the model at once. With dimension, vectors of another length raise."""
    kind = faces.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder()
        for batch in batches:
            lists = batch.column(1).to_pylist()
            owner = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
            pixels = np.stack([np.frombuffer(b, np.uint8).reshape(CROP, CROP, 3) for c in lists for b in c])
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            if flip:
                pixels, owner = np.concatenate([pixels, pixels[first][:, :, ::-1]]), np.concatenate([owner, owner[first]])
            v = np.asarray(model.embed(pixels), float)
            if dimension is not None and v.shape[1] != dimension:
                raise ValueError(f"the model's vectors have {v.shape[1]} numbers, not {dimension}")
            norm = np.linalg.norm(v, axis=1)
            total = np.zeros((len(lists), v.shape[1]))
            ok = norm > 0
            np.add.at(total, owner[ok], v[ok] / norm[ok][:, None])
            length = np.linalg.norm(total, axis=1)
            keep = (length > 1e-12) & (norm[: len(first)][first] > 0)
            out = (total[keep] / length[keep][:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(out.tolist(), pa.list_(pa.float32()))], [id_col, "embedding"])

    return faces.select(id_col, "crops").filter("size(crops) > 0").mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")


def ensemble_mean(views: DataFrame, *, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """(id, embedding): the unit mean of each id's view vectors."""
    return vector_mean(views, id_col, vec_col).select(id_col, l2_normalize(F.col("centroid")).alias("embedding"))
