"""Detections and their quality: thresholds, ranks within an image, clamps, scores and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import scalars as S


def rank_faces(rows: DataFrame, *, image_col: str = "img", most: int = 50, threshold: float = 0.5) -> DataFrame:
    """rows with face_index: the place by det_score within the image (ties by vec_id). The best `most` stay, of these the ones that reach threshold."""
    place = F.row_number().over(Window.partitionBy(image_col).orderBy(F.desc("det_score"), "vec_id")) - 1
    return rows.withColumn("face_index", place.cast("int")).filter((F.col("face_index") < most) & (F.col("det_score") >= threshold))


def geometry(rows: DataFrame) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return rows.withColumns({"width": w, "height": h, "area": w * h, "min_side": F.least(w, h)})


def clamp(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Crop corners as whole pixels inside the image."""
    low = lambda c: F.greatest(F.lit(0), F.col(c).cast("int"))
    high = lambda c, m: F.least(F.lit(m), F.col(c).cast("int"))
    return rows.withColumns({"cx1": low("x1"), "cy1": low("y1"), "cx2": high("x2", width), "cy2": high("y2", height)})


def scored(rows: DataFrame, *, least_size: float = 40.0, blur: float = 50.0, most_angle: float = 75.0) -> DataFrame:
    """rows (x1 ... y2, lex ... ny, det_score, lap_var) with the five scores, composite, reasons and passed."""
    g = geometry(rows)
    g = g.withColumns({"size_score": S.size_score(F.col("width"), F.col("height"), least_size), "blur_score": S.blur_score(F.col("lap_var"), blur), "pose_score": S.pose_score(*[F.col(c) for c in ("lex", "ley", "rex", "rey", "nx")], most_angle), "aspect_score": S.aspect_score(F.col("width"), F.col("height"))})
    parts = [F.col(c) for c in ("size_score", "blur_score", "pose_score", "det_score", "aspect_score")]
    g = g.withColumns({"composite": S.composite(*parts), "reasons": S.reasons(*parts)})
    return g.withColumn("passed", F.size("reasons") == 0)


def gate(rows: DataFrame, least: float = 0.2) -> DataFrame:
    """rows without those that fail and score under least."""
    return rows.filter(~(~F.col("passed") & (F.col("composite") < least)))
