"""Image files: scan, information, decoding, incremental selection."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.scalars import IMAGE_EXTENSIONS, basename, content_hash, suffix


def with_extension(rows: DataFrame, path_col: str, extensions: tuple[str, ...]) -> DataFrame:
    return rows.filter(suffix(F.col(path_col)).isin(*["." + e for e in extensions]))


def scan(spark: SparkSession, folder: str, *, recursive: bool = True, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, modificationTime, length, content) of image files, their extensions compared without case. A path that does not exist raises; content is only read if it is used."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder)


def discover(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(path), in the order of the paths' components."""
    return scan(spark, folder, **options).select("path").distinct().orderBy(F.split("path", "/"))


def info(files: DataFrame) -> DataFrame:
    """(path, filename, extension, size_bytes) without reading contents."""
    return files.select("path", basename(F.col("path")).alias("filename"), suffix(F.col("path")).alias("extension"), F.col("length").alias("size_bytes"))


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("image_hash", content_hash(F.col("content")))


def decode(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """(path, height, width, channels, pixels): decoded images (BGR, 8 bits); files that cannot be read are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
    return rows.select(F.regexp_replace(origin, "^file:///", "file:/").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


#: Files that are named to Spark's reader in one round: what the driver holds of a run's paths.
FILES = 1 << 16


def rounds(files: DataFrame, size: int = FILES) -> Iterator[list[tuple[str, str]]]:
    """The pairs (path, image_hash) of files in lists of at most size; the driver holds one of them and a partition."""
    held = []
    for r in files.select("path", "image_hash").toLocalIterator():
        held.append((r["path"], r["image_hash"]))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def decode_files(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(path, image_hash, height, width, channels, pixels) of these files (path, image_hash) and no others, each read and decoded once. One that is no picture Spark can read has height -1 and no pixels."""
    names = [re.sub(r"([\\{}\[\]*?])", r"\\\1", path) for path, _ in files]  # paths are patterns to the reader
    known = spark.createDataFrame(files, "path string, image_hash string")
    if not files:
        return known.selectExpr("path", "image_hash", "0 as height", "0 as width", "0 as channels", "X'' as pixels")
    rows = spark.read.format("image").load(names)
    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
    pictures = rows.select(F.regexp_replace(origin, "^file:///", "file:/").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
    return pictures.join(F.broadcast(known), "path")  # at most FILES rows


def undecoded(files: DataFrame, images: DataFrame) -> DataFrame:
    """Paths of files that decode() left out."""
    return files.select("path").join(images.select("path"), "path", "left_anti")


def processed(images: DataFrame, done: DataFrame) -> DataFrame:
    """images whose hash is among the processed ones."""
    return images.join(done.select("image_hash").distinct(), "image_hash", "left_semi")


def unprocessed(images: DataFrame, processed: DataFrame) -> DataFrame:
    """images whose hash is not among the processed ones; an image without a hash stays."""
    return images.join(processed.select("image_hash").distinct(), "image_hash", "left_anti")
