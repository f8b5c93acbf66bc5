"""What streams remember over restarts: contents of images, centroids and their faces."""

import numpy as np
import pytest

from kinweave.streaming import ingest

SCHEMA = "identity_id string, face_id string, seq bigint, emb array<double>"


@pytest.fixture
def store(spark):
    key, provider = ingest.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    yield
    spark.conf.set(key, before)


def centroid(vectors):
    c = None
    for v in vectors:
        c = np.array(v, float) if c is None else (c + v) / 2
        c /= np.linalg.norm(c)
    return c


def test_centroids_and_faces_outlive_the_query(spark, tmp_path, store):
    folder, out = tmp_path / "rows", tmp_path / "out"
    rng = np.random.default_rng(4)
    v = {f"f{k}": rng.normal(size=3).tolist() for k in range(6)}

    def put(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    def go():
        found = {}
        stream = ingest.lasting_centroids(spark.readStream.schema(SCHEMA).parquet(str(folder)))
        take = lambda df, _: found.update({r["identity_id"]: (r["n"], r["centroid"]) for r in df.collect()})
        q = stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(out)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return found

    put(("a", "f1", 2, v["f1"]), ("a", "f0", 1, v["f0"]), ("a", "f0", 5, v["f5"]), ("b", "f2", 1, v["f2"]), (None, "f3", 1, v["f3"]), ("a", None, 9, v["f3"]), ("a", "f9", 9, None))
    first = go()
    assert set(first) == {"a", "b"} and first["a"][0] == 2 and np.allclose(first["a"][1], centroid([v["f0"], v["f1"]])) and first["b"][0] == 1
    put(("a", "f1", 7, v["f4"]), ("a", "f3", 8, v["f3"]), ("b", "f2", 3, v["f5"]))  # a new query, with the first one's checkpoint: f1 and f2 are known
    second = go()
    assert set(second) == {"a"} and second["a"][0] == 3 and np.allclose(second["a"][1], centroid([v["f0"], v["f1"], v["f3"]]))
    assert go() == {}


def test_contents_are_seen_once(spark, tmp_path, store):
    photos = tmp_path / "photos"
    photos.mkdir()
    names = []

    def go():
        q = ingest.fresh_images(spark, str(photos), per_batch=2).writeStream.outputMode("append").foreachBatch(lambda df, _: names.extend(r["path"].rsplit("/", 1)[1] for r in df.collect()))
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    for k, content in enumerate((b"one", b"two", b"one", b"three")):
        (photos / f"{k}.bmp").write_bytes(content)
    (photos / "x.txt").write_bytes(b"four")
    go()
    assert len(names) == 3 and {"1.bmp", "3.bmp"} <= set(names)
    names.clear()
    (photos / "copy.JPG").write_bytes(b"two")
    (photos / "new.png").write_bytes(b"five")
    go()
    assert names == ["new.png"]
