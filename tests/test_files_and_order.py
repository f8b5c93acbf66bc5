"""Files copied by the tasks, and the order of a stream's rows over several chunks."""

import numpy as np
import pytest

from kinweave.sources.tables import copy_from
from kinweave.streaming import ingest


def test_files_are_copied_whole_without_their_content_in_a_shuffle(spark, tmp_path):
    source, out = tmp_path / "in 50%", tmp_path / "out"
    source.mkdir()
    rng, rows = np.random.default_rng(0), []
    for i in range(12):
        (source / f"p{i}.bin").write_bytes(rng.bytes(0 if i == 3 else 3000 + i))
        rows.append((f"file:{source}/p{i}.bin", f"Person_{i % 3}/p {i}.bin"))
    rows += [(f"file:{source}/gone.bin", "Person_0/gone.bin"), (str(source / "p1.bin"), "Person_9/again.bin")]
    df = spark.createDataFrame(rows, "source string, name string")
    for _ in range(2):  # a task that runs again leaves the same files
        assert copy_from(df, str(out), piece=1000) == {"copied": 13, "missing": 1}
        written = sorted(p for p in out.rglob("*") if p.is_file())
        assert len(written) == 13 and not any(p.name.startswith(".") for p in written)
        assert all((out / name).read_bytes() == (source / path.rpartition("/")[2]).read_bytes() for path, name in rows if "gone" not in path)
    assert copy_from(df.limit(0), str(out)) == {"copied": 0, "missing": 0}
    (tmp_path / "dir").mkdir()
    with pytest.raises(Exception, match="dir"):  # a source that can't be read fails, and leaves nothing
        copy_from(spark.createDataFrame([(f"file:{tmp_path}/dir", "Person_0/dir")], df.schema), str(out))
    assert sum(p.is_file() for p in out.rglob("*")) == 13


def test_running_centroids_keep_the_order_over_chunks(spark, tmp_path):
    n = 25_000
    rng = np.random.default_rng(2)
    v, order = rng.normal(size=(n, 3)), rng.permutation(n)
    frame = spark.createDataFrame([("a", int(i), v[i].tolist()) for i in order], "identity_id string, seq bigint, emb array<double>")
    frame.coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "rows"))
    q = ingest.running_centroids(rows).writeStream.outputMode("update").format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = v[0] / np.linalg.norm(v[0])
    for x in v[1:]:
        want = want + x
        want /= 2
        want /= np.linalg.norm(want)
    found = spark.table("ordered").collect()
    assert len(found) == 1 and found[0]["n"] == n and np.allclose(found[0]["centroid"], want)
