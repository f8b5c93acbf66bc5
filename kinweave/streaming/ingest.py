"""Incremental runs as streams: new images, running centroids, corrections."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kinweave.functions.scalars import IMAGE_EXTENSIONS, content_hash
from kinweave.sources.images import unprocessed
from kinweave.sources.tables import Workspace

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def new_images(spark: SparkSession, folder: str, workspace: Workspace, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None, *, per_batch: int = 1000) -> StreamingQuery:
    """Work off the image files that have come since the last run: those whose content is not recorded yet go to handle, and are recorded after it. A batch that failed between both is given to handle
    again, under the same number: what handle writes should be keyed by image_hash or by that number."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in IMAGE_EXTENSIONS) + "}"
    files = spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        fresh = unprocessed(rows.withColumn("image_hash", content_hash(F.col("content"))), workspace.read("processed_images")).dropDuplicates(["image_hash"])
        if handle is not None:
            handle(fresh, number)
        workspace.append("processed_images", fresh.select(F.col("path").alias("image_path"), "image_hash"))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_images(spark: SparkSession, folder: str, *, per_batch: int = 1000) -> DataFrame:
    """A stream of (path, modificationTime, length, image_hash) of image files, each content once, whatever the number of its copies. What was seen is the stream's own state, in its checkpoint, and no table is
    read; contents are hashed where they are read and not shuffled. Of copies that come in one batch any may be the one."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in IMAGE_EXTENSIONS) + "}"
    files = spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select("path", "modificationTime", "length", content_hash(F.col("content")).alias("image_hash")).dropDuplicates(["image_hash"])


#: The state store that lasting_centroids needs: on disk, so state may be larger than an executor's memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastingCentroid(StatefulProcessor):
    """For a key: the number of its faces and their running centroid as a value, the faces that are in it as a map. A face counts once, though it come again in a later batch; its first row by order is taken. States
    that nothing has touched for ttl milliseconds go, if ttl is given: a face that comes again after that counts anew."""

    def __init__(self, key_col: str, face_col: str, vec_col: str, order_col: str, ttl: int | None):
        self.key, self.face, self.vec, self.order, self.ttl = key_col, face_col, vec_col, order_col, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("centroid", "n bigint, centroid array<double>", self.ttl)
        self.faces = handle.getMapState("faces", "face string", "seq bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        chunks = [pdf[[self.face, self.order, self.vec]] for pdf in rows if len(pdf)]  # a key of many rows comes in several
        batch = pd.concat(chunks).sort_values([self.order, self.face], kind="stable").drop_duplicates(self.face)
        n, centroid = self.value.get() if self.value.exists() else (0, None)
        before = n
        for face, seq, v in batch.itertuples(index=False):  # each step needs the one before
            if self.faces.containsKey((face,)):
                continue
            self.faces.updateValue((face,), (int(seq),))
            v = np.asarray(v, float)
            centroid = _unit(v) if centroid is None else _unit((np.asarray(centroid, float) + v) / 2)
            n += 1
        if n > before:
            centroid = np.asarray(centroid).tolist()
            self.value.update((n, centroid))
            yield pd.DataFrame({self.key: [key[0]], "n": [n], "centroid": [centroid]})

    def close(self) -> None:
        pass


def lasting_centroids(rows: DataFrame, *, key_col: str = "identity_id", face_col: str = "face_id", vec_col: str = "emb", order_col: str = "seq", ttl_ms: int | None = None) -> DataFrame:
    """A stream of (key, n, centroid) as running_centroids(), which also remembers the faces: rows whose face is in its key's centroid already change nothing, so a source that repeats rows gives the same centroids.
    Rows without a key or a face or a vector are left out. The session's state store must be STATE_STORE."""
    kept = rows.filter(F.col(key_col).isNotNull() & F.col(face_col).isNotNull() & F.col(vec_col).isNotNull()).select(key_col, F.col(face_col).cast("string").alias(face_col), F.col(order_col).cast("bigint").alias(order_col), vec_col)
    schema = f"`{key_col}` {rows.schema[key_col].dataType.simpleString()}, n bigint, centroid array<double>"
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return kept.groupBy(key_col).transformWithStateInPandas(LastingCentroid(key_col, face_col, vec_col, order_col, ttl_ms), schema, "Update", mode)


def _unit(v: np.ndarray) -> np.ndarray:
    length = float(np.sqrt((v * v).sum()))
    return v / length if length else v


def running_centroids(rows: DataFrame, *, key_col: str = "identity_id", vec_col: str = "emb", order_col: str = "seq") -> DataFrame:
    """A stream of (key, n, centroid): each new vector of a key is averaged with its unit centroid and the result made a unit vector again, in the order of order_col within a batch. A key's rows of one batch are sorted in its task, whose size the source's rows per trigger bound."""

    def fold(key: tuple, groups, state):
        n, centroid = state.get if state.exists else (0, None)
        chunks = [(pdf[order_col].to_numpy(), np.stack(pdf[vec_col].to_numpy()).astype(float)) for pdf in groups if len(pdf)]  # a key of many rows comes in several
        vectors = np.concatenate([v for _, v in chunks])[np.argsort(np.concatenate([k for k, _ in chunks]), kind="stable")]
        if centroid is None:
            centroid, vectors, n = _unit(vectors[0]), vectors[1:], 1
        for v in vectors:  # each step needs the one before
            centroid = _unit((np.asarray(centroid) + v) / 2)
        n += len(vectors)
        centroid = np.asarray(centroid).tolist()
        state.update((n, centroid))
        yield pd.DataFrame({key_col: [key[0]], "n": [n], "centroid": [centroid]})

    return rows.groupBy(key_col).applyInPandasWithState(fold, f"{key_col} string, n bigint, centroid array<double>", "n bigint, centroid array<double>", "update", "NoTimeout")


def corrections(rows: DataFrame, workspace: Workspace, checkpoint: str, then: Callable[[], object] | None = None) -> StreamingQuery:
    """A stream of corrections (face_id, label, seq) upserted into the workspace's table, the last of a face winning. After each batch then is called, say Engine.apply_corrections."""
    from kinweave.operators.identities import upsert

    def batch(changes: DataFrame, _: int) -> None:
        workspace.write("corrections", upsert(workspace.read("corrections"), changes.select("face_id", "label", "seq"), "face_id", "seq"))
        if then is not None:
            then()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
