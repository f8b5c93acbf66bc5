"""Cluster reports, file manifests, plot points, listings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.scalars import basename, clip, person_name
from kinweave.operators import raster


def first_images(faces: DataFrame) -> DataFrame:
    """Of each label and image path the first face (by ord): what is copied to the label's folder."""
    rank = F.row_number().over(Window.partitionBy("label", "image_path").orderBy("ord"))
    return faces.filter("label >= 0").withColumn("__rn", rank).filter("__rn = 1").drop("__rn")


def manifest(faces: DataFrame) -> DataFrame:
    """first_images with file_name, different within a label: the first image of a name keeps it; each further one gets the smallest number (_1, _2, ... before its extension) that makes a name which no image of
    the label has as its own, nor another further one."""
    rows = first_images(faces).withColumn("__name", basename(F.col("image_path")))
    nth = F.row_number().over(Window.partitionBy("label", "__name").orderBy("ord")) - 1
    rows = rows.withColumn("__n", nth)
    stem, ext = F.regexp_replace("__name", r"^(.+)\.[^.]*$", "$1"), F.regexp_extract("__name", r"^.+(\.[^.]*)$", 1)
    rows = rows.withColumns({"__stem": stem, "__ext": ext})
    # numbers that an image of the label has as its own name's: they are skipped. A name is of one form stem_number only, so further images of different names don't meet but where stems nest
    taken = rows.filter("__n = 0").select("label", F.regexp_extract("__stem", r"^(.*)_([1-9]\d{0,8})$", 1).alias("__stem"), F.regexp_extract("__stem", r"^(.*)_([1-9]\d{0,8})$", 2).try_cast("bigint").alias("__k"), "__ext").filter("__k IS NOT NULL")
    taken = taken.groupBy("label", "__stem", "__ext").agg(F.array_sort(F.collect_set("__k")).alias("__taken"))
    rows = rows.join(taken, ["label", "__stem", "__ext"], "left")
    # the n-th free number: n, moved on by every taken number that is not above it
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), F.col("__n").cast("bigint"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    name = F.when(F.col("__n") == 0, F.col("__name")).otherwise(F.concat("__stem", F.lit("_"), free.cast("string"), "__ext"))
    return rows.withColumn("file_name", name).select(*faces.columns, "file_name")


def cluster_report(faces: DataFrame) -> DataFrame:
    """(cluster_name, face_count, n_images, avg_confidence, n_review) per label >= 0, over all faces."""
    rows = faces.filter("label >= 0").groupBy("label").agg(F.count("*").alias("face_count"), F.countDistinct("image_path").alias("n_images"), F.avg("confidence").alias("avg_confidence"), F.count_if("in_review").alias("n_review"))
    return rows.select(person_name(F.col("label")).alias("cluster_name"), "face_count", "n_images", "avg_confidence", "n_review")


def report_totals(faces: DataFrame) -> DataFrame:
    return faces.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), F.count("*").alias("n_faces"), F.count_if("in_review").alias("n_review"), F.count_if(F.expr("label = -1")).alias("n_noise"))


def report_json(faces: DataFrame) -> DataFrame:
    """One row: the nested report as JSON. A cluster's images are one list, so this is for reports that fit a row; the manifest table holds the same at any size."""
    images = manifest(faces).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("image_path").alias("source"), F.concat(person_name(F.col("label")), F.lit("/"), F.col("file_name")).alias("destination"), "face_id", "confidence"))).alias("images"))
    counts = faces.filter("label >= 0").groupBy("label").agg(F.count("*").alias("face_count"), F.avg("confidence").alias("avg_confidence"))
    entry = F.struct("face_count", F.transform("images", lambda s: s.dropFields("ord")).alias("images"), "avg_confidence")
    clusters = counts.join(images, "label", "left").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(person_name(F.col("label")).alias("k"), entry.alias("v"))))).alias("clusters"))
    return report_totals(faces).crossJoin(clusters).select(F.to_json(F.struct("n_clusters", "n_faces", "n_review", "n_noise", "clusters")).alias("report"))


def plot_points(faces: DataFrame) -> DataFrame:
    """faces with marker, size and alpha: clusters as points sized by confidence, review items as diamonds, noise as x."""
    noise, review = F.col("label") == -1, F.col("in_review")
    marker = F.when(noise, "x").when(review, "D").otherwise("o")
    size = F.when(noise, 30.0).when(review, 80.0).otherwise(F.col("confidence") * 120 + 20)
    alpha = F.when(noise, 0.5).when(review, 0.8).otherwise(clip(F.col("confidence") * 0.8 + 0.2, 0.3, 1.0))
    return faces.withColumns({"marker": marker, "size": size, "alpha": alpha})


def plot_labels(points: DataFrame) -> DataFrame:
    """(text, x, y) at each label's mean position of points (label, x, y)."""
    return points.filter("label >= 0").groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select(F.format_string("P%03d", F.col("label").cast("int")).alias("text"), "x", "y")


def _placed(points: DataFrame, ends: DataFrame, width: int, height: int) -> DataFrame:
    """points with px and py, their pixel in a picture that the ends (one row: x0, x1, y0, y1) fill."""
    at = lambda c, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(c) - F.col(f"{c}0")) / F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(1e-12)) * n))).cast("int")
    return points.crossJoin(F.broadcast(ends)).withColumns({"px": at("x", width), "py": at("y", height)}).drop("x0", "x1", "y0", "y1")


def _ends(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def plot_pixels(points: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """(px, py, label, alpha, marker, size) of the pixels that points (label, x, y, alpha, and marker and size, else discs of size 20) fall on, at most width * height rows: the point of the largest alpha is seen (ties:
    the smaller label, then the first marker and the larger size)."""
    rows = points.withColumns({k: F.col(k) if k in points.columns else v for k, v in {"marker": F.lit("o"), "size": F.lit(20.0)}.items()})
    top = F.max(F.struct("alpha", (-F.col("label")).alias("m"), (-F.ascii("marker")).alias("k"), "size")).alias("top")
    seen = _placed(rows, _ends(rows), width, height).groupBy("px", "py").agg(top)
    return seen.select("px", "py", (-F.col("top.m")).cast("int").alias("label"), "top.alpha", F.char(-F.col("top.k")).alias("marker"), "top.size")


def plot_texts(points: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """(px, py, text): the names of the clusters (plot_labels) where they fit: of those that fall into one cell of a name's size, the first. At most a row a cell, however many clusters there are."""
    cell_x, cell_y = 4 * raster.WIDE + 4, raster.TALL + 4
    named = _placed(plot_labels(points), _ends(points), width, height)
    cells = named.groupBy(F.expr(f"px div {cell_x}").alias("cx"), F.expr(f"py div {cell_y}").alias("cy"))
    return cells.agg(F.min(F.struct(F.length("text").alias("n"), "text", "px", "py")).alias("one")).select("one.px", "one.py", "one.text")


def plot_title(faces: DataFrame) -> str:
    t = report_totals(faces).first()
    return f"Face clusters by confidence\n{t['n_clusters']} clusters - {t['n_noise']} noise - {t['n_review']} review items"


def plot_image(points: DataFrame, width: int = 640, height: int = 480, title: str | None = None) -> np.ndarray:
    """A BGR picture of the points: a colour for each label, gray crosses for noise, red diamonds for review items, discs for the rest, paler the smaller alpha; the clusters' names at their middles, the lines of the
    title on top. Crosses lie lowest and diamonds highest. What comes to the driver is at most a row per pixel."""
    lines = title.split("\n") if title else []
    head = len(lines) * (raster.TALL + 5) + 6 if lines else 0
    image = np.full((height, width, 3), 255.0)
    field = image[head:]
    tall = height - head
    order = {"x": 0, "o": 1, "D": 2}
    for r in sorted(plot_pixels(points, width, tall).toLocalIterator(), key=lambda r: (order.get(r["marker"], 1), r["alpha"], r["py"], r["px"])):
        turn = (r["label"] * 0.61803398875) % 1.0 * 2 * np.pi
        colour = np.array([128.0] * 3) if r["label"] < 0 else np.array([0.0, 0, 255]) if r["marker"] == "D" else 128 + 100 * np.cos(turn + np.array([0, 2.0944, 4.1888]))
        radius = raster.radius_of(r["size"])
        raster.paint(field, raster.marker_mask(r["marker"], radius), tall - 1 - r["py"] - radius, r["px"] - radius, colour, r["alpha"])
    if lines:
        for r in plot_texts(points, width, tall).toLocalIterator():
            raster.write(field, r["text"], tall - 1 - r["py"], r["px"], boxed=True)
    for k, line in enumerate(lines):
        raster.write(image, line, 6 + k * (raster.TALL + 5) + raster.TALL // 2, width // 2)
    return image.astype(np.uint8)


def top_per_cluster(faces: DataFrame, k: int = 4) -> DataFrame:
    """(cluster_name, t1, ..., tk): the first k image names of each cluster, empty where there are fewer. The k least are found before the rows of a label meet."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("ord"))
    top = faces.filter("label >= 0").withColumn("__rn", rank).filter(F.col("__rn") <= k)
    wide = top.groupBy("label").agg(*[F.coalesce(F.max(F.when(F.col("__rn") == i, basename(F.col("image_path")))), F.lit("")).alias(f"t{i}") for i in range(1, k + 1)])
    return wide.select(person_name(F.col("label")).alias("cluster_name"), *[f"t{i}" for i in range(1, k + 1)])


def cluster_files(report: DataFrame, files: DataFrame) -> DataFrame:
    """report with photo_files and crop_files counts and names from a listing (cluster_name, kind, name)."""
    lists = files.groupBy("cluster_name").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name")))).alias(f"{k}_files") for k in ("photo", "crop")])
    return report.join(lists, "cluster_name", "left")


def output_stats(files: DataFrame, totals: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row: n_clusters (folders), n_photos, n_faces, n_review, n_input_photos, has_plot (whether the listing has the scatter plot)."""
    own = files.agg(F.countDistinct("cluster_name").alias("n_clusters"), F.count_if(F.expr("kind = 'photo'")).alias("n_photos"), (F.count_if(F.expr("kind = 'plot'")) > 0).alias("has_plot"))
    return own.crossJoin(totals.select("n_faces", "n_review")).crossJoin(inputs.agg(F.count("*").alias("n_input_photos")))
