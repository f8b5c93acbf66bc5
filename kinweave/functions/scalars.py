"""Scalar expressions: identifiers, names, paths, quality tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are images for the scan, without case.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def face_id(image_hash: Column, index: Column) -> Column:
    return F.format_string("%s_%03d", F.substring(image_hash, 1, 16), index.cast("int"))


def person_name(label: Column) -> Column:
    """Person_NNN, or noise below 0."""
    return F.when(label >= 0, F.format_string("Person_%03d", label.cast("int"))).otherwise(F.lit("noise"))


def person_number(name: Column) -> Column:
    """The number in Person_NNN; null for other names."""
    return F.try_element_at(F.split(name, "_"), F.lit(2)).try_cast("int")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name up to its last dot; a name that only begins with a dot is whole."""
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot, or empty."""
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))).otherwise(F.lit(""))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def safe_ratio(x: Column, n: Column) -> Column:
    return F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))


def confidence_band(c: Column) -> Column:
    return F.when(c > 0.65, "high").when(c > 0.35, "medium").otherwise("low")


def log_level(line: Column) -> Column:
    return F.when(line.contains("ERROR"), "error").when(line.contains("WARNING"), "warning").when(line.contains("| INFO"), "info").otherwise("other")


def progress_percent(step: Column, steps: int = 13) -> Column:
    return F.floor(step * F.lit(100.0) / steps).cast("int")


def size_score(width: Column, height: Column, least: float = 40.0) -> Column:
    s = F.least(width, height)
    return F.when(s < least / 2, 0.0).when(s < least, 0.3).when(s < 2 * least, 0.7).otherwise(1.0)


def blur_score(variance: Column, bound: float = 50.0) -> Column:
    """Tier of the Laplacian variance; 0 for an empty crop (null)."""
    return F.when(variance.isNull(), 0.0).when(variance < 0.3 * bound, 0.1).when(variance < bound, 0.5).when(variance < 3 * bound, 0.8).otherwise(1.0)


def pose_score(lex: Column, ley: Column, rex: Column, rey: Column, nx: Column, most: float = 75.0) -> Column:
    """Tier of the nose's offset from the eyes' middle, relative to their distance, and of the eyes' tilt, at most `most` degrees; 0.5 without landmarks."""
    apart = F.sqrt((rex - lex) * (rex - lex) + (rey - ley) * (rey - ley))
    ratio, tilt = F.abs(nx - (lex + rex) / 2) / apart, F.abs(F.degrees(F.atan2(rey - ley, rex - lex)))
    tiers = F.when((ratio > 0.5) | (tilt > most), 0.1).when((ratio > 0.3) | (tilt > 45), 0.4).when((ratio > 0.15) | (tilt > 20), 0.7).otherwise(1.0)
    return F.when(lex.isNull(), 0.5).when(apart < 1e-6, 0.1).otherwise(tiers)


def aspect_score(width: Column, height: Column) -> Column:
    r = width / height
    return F.when((width < 1) | (height < 1), 0.0).when(r.between(0.6, 1.4), 1.0).when(r.between(0.4, 1.8), 0.6).otherwise(0.2)


def composite(size: Column, blur: Column, pose: Column, confidence: Column, aspect: Column) -> Column:
    return size * 0.25 + blur * 0.25 + pose * 0.20 + F.least(confidence, F.lit(1.0)) * 0.20 + aspect * 0.10


def reasons(size: Column, blur: Column, pose: Column, confidence: Column, aspect: Column) -> Column:
    """Names of the scores that fail."""
    rules = [("size", size, 0.5), ("blur", blur, 0.3), ("pose", pose, 0.3), ("confidence", confidence, 0.3), ("aspect", aspect, 0.3)]
    return F.array_compact(F.array(*[F.when(c < t, F.lit(n)) for n, c, t in rules]))


def confidence_penalty(passed: Column, score: Column) -> Column:
    return F.when(passed, 1.0).otherwise(F.greatest(F.lit(0.2), score))


def similarity_transform(source: list[Column], target: list[float]) -> list[Column]:
    """The six numbers (a, -b, tx, b, a, ty) of the similarity that maps the eyes of source (left x, left y, right x, right y) on those of target; the identity for coinciding eyes."""
    lx, ly, rx, ry = source
    tlx, tly, trx, try_ = (F.lit(float(t)) for t in target)
    sx, sy, dx, dy = rx - lx, ry - ly, trx - tlx, try_ - tly
    s2, d2 = sx * sx + sy * sy, dx * dx + dy * dy
    scale, turn = F.sqrt(d2) / F.sqrt(s2), F.atan2(dy, dx) - F.atan2(sy, sx)
    a, b = scale * F.cos(turn), scale * F.sin(turn)
    mx, my, nx, ny = (lx + rx) / 2, (ly + ry) / 2, (tlx + trx) / 2, (tly + try_) / 2
    same = F.sqrt(s2) < 1e-6
    found = [a, -b, nx - (a * mx - b * my), b, a, ny - (b * mx + a * my)]
    return [F.when(same, F.lit(i)).otherwise(x) for i, x in zip((1.0, 0.0, 0.0, 0.0, 1.0, 0.0), found, strict=True)]


def perturb_point(x: Column, y: Column, mx: Column, my: Column, degrees: float, scale: float) -> tuple[Column, Column]:
    """A point turned and scaled about (mx, my)."""
    c, s = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    dx, dy = x - mx, y - my
    return (dx * c - dy * s) * scale + mx, (dx * s + dy * c) * scale + my


def pairs(flat: Column) -> Column:
    """A flat list as a list of pairs."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda i: F.slice(flat, i * 2 + 1, 2))


def five_of_106(points: Column) -> Column:
    """Five landmarks of 106: eyes as means of points 33 to 42 and 87 to 96, then points 86, 52 and 61; the first five if there are fewer than 106."""
    mean = lambda first, k: F.transform(F.slice(points, first, 10), lambda p: p[k])
    middle = lambda first: F.array(*[F.aggregate(mean(first, k), F.lit(0.0), lambda s, x: s + x) / 10 for k in (0, 1)])
    return F.when(F.size(points) < 106, F.slice(points, 1, 5)).otherwise(F.array(middle(34), middle(88), points[86], points[52], points[61]))
