"""Ingest: which files are decoded, what a repeated run adds, counts; control of a run."""

import struct
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import imaging
from kinweave.plans.engine import Engine
from kinweave.sources import config, images
from kinweave.sources.tables import Workspace
from kinweave.streaming.progress import Broadcaster, Busy, Cancelled, Control


def bmp(pixels):
    h, w, _ = pixels.shape
    row = (3 * w + 3) // 4 * 4
    body = b"".join(pixels[y].tobytes().ljust(row, b"\0") for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def detector():
    points = imaging.TEMPLATE.tolist()

    class One:
        def detect(self, image):
            return [([0.0, 0.0, 112.0, 112.0], points, 0.9)]

    return One()


def picture(seed):
    return bmp(np.random.default_rng(seed).integers(0, 255, (120, 120, 3), dtype=np.uint8))


def test_decode_files_reads_only_what_is_named(spark, tmp_path):
    names = ["plain.bmp", "with space.bmp", "a+b%20c.bmp", "glob[1]{x,y}*.bmp", "ünï.bmp"]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(bmp(np.full((4, 6, 3), k, np.uint8)))
    (tmp_path / "broken.bmp").write_bytes(b"no picture")
    (tmp_path / "other.bmp").write_bytes(picture(0))
    files = [(r["path"], r["image_hash"]) for r in images.hashed(images.scan(spark, str(tmp_path))).collect() if not r["path"].endswith("other.bmp")]
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.decode_files(spark, files).collect()}
    assert set(got) == {*names, "broken.bmp"} and got["broken.bmp"]["height"] == -1
    assert all(set(got[n]["pixels"]) == {k} and (got[n]["height"], got[n]["width"]) == (4, 6) for k, n in enumerate(names))
    assert {r["path"] for r in images.decode_files(spark, files).collect()} == {p for p, _ in files}
    assert {r["path"].rsplit("/", 1)[1] for r in images.decode(spark, str(tmp_path)).collect()} == {*names, "other.bmp"}
    assert images.decode_files(spark, []).count() == 0
    known = spark.createDataFrame([(f"p{k}", "h") for k in range(7)], "path string, image_hash string")
    assert [len(part) for part in images.rounds(known, 3)] == [3, 3, 1] and not list(images.rounds(known.limit(0)))


def test_add_appends_only_new_keys(spark, tmp_path):
    w = Workspace(spark, str(tmp_path))
    row = lambda *rows: spark.createDataFrame(rows, "image_path string, face_index int, stage string, reason string")
    keys = ["image_path", "face_index"]
    w.add("skipped", row(("a", None, "detect", "x"), ("b", 1, "gate", "y")), keys)
    w.add("skipped", row(("a", None, "detect", "x"), ("b", 2, "gate", "y")), keys)
    assert w.read("skipped").count() == 3


@pytest.fixture
def engine(spark, tmp_path):
    from pyspark import cloudpickle

    import tests.test_ingest_and_control as here

    cloudpickle.register_pickle_by_value(here)
    (tmp_path / "photos").mkdir()
    settings = config.build(config.EngineConfig(), {"input_dir": str(tmp_path / "photos"), "output_dir": str(tmp_path / "out")})
    return Engine(spark, settings, detector)


def test_incremental_run_decodes_fresh_files_once(spark, tmp_path, engine, monkeypatch):
    asked = []
    plain = images.decode_files
    monkeypatch.setattr(images, "decode_files", lambda s, files: (asked.extend(p.rsplit("/", 1)[1] for p, _ in files), plain(s, files))[1])
    photos = tmp_path / "photos"
    for k in range(3):
        (photos / f"p{k}.bmp").write_bytes(picture(k))
    (photos / "broken.bmp").write_bytes(b"no picture")
    engine.ingest()
    assert sorted(asked) == ["broken.bmp", "p0.bmp", "p1.bmp", "p2.bmp"]
    assert engine.counts == {"images": 4, "faces": 3, "skipped_decode": 1, "skipped_detect": 0, "skipped_gate": 0, "skipped_align": 0, "skipped_embed": 0}
    asked.clear()
    (photos / "p 3.bmp").write_bytes(picture(3))
    engine.ingest(incremental=True)
    assert asked == ["p 3.bmp"] and engine.counts["images"] == 1 and engine.counts["faces"] == 1
    w = engine.workspace
    assert w.read("faces").count() == 4 and w.read("processed_images").count() == 5

    # a run that fails before it records its images, and is done again
    (photos / "p4.bmp").write_bytes(picture(4))
    add = Workspace.add
    monkeypatch.setattr(Workspace, "add", lambda self, name, rows, keys: 1 / 0 if name == "processed_images" else add(self, name, rows, keys))
    with pytest.raises(ZeroDivisionError):
        engine.ingest(incremental=True)
    monkeypatch.setattr(Workspace, "add", add)
    engine.ingest(incremental=True)
    faces = w.read("faces")
    assert faces.count() == 5 == faces.select("face_id", "image_path").distinct().count()
    assert w.read("crops").count() == 5 and w.read("skipped").count() == 1 and w.read("processed_images").count() == 6


def test_upload_numbers_taken_names(spark, tmp_path, engine):
    photos = tmp_path / "photos"
    (photos / "a.bmp").write_bytes(b"old")
    (photos / "a_1.bmp").write_bytes(b"older")
    rows = [("a.bmp", b"1"), ("x/y/a.bmp", b"2"), ("b.JPG", b"3"), ("b.JPG", b"3"), ("a_1.bmp", b"4"), ("note.txt", b"5"), (None, b"6"), ("c.png", None)]
    got = engine.upload(spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "name string, content binary")).collect()
    assert len(got) == 4 and len({r["file_name"] for r in got}) == 4
    held = {p.name: p.read_bytes() for p in photos.glob("*.*") if not p.name.startswith(".")}
    assert held["a.bmp"] == b"old" and held["a_1.bmp"] == b"older" and held["b.JPG"] == b"3" and len(held) == 6
    assert sorted(held.values()) == [b"1", b"2", b"3", b"4", b"old", b"older"]
    assert all(n.startswith("a_") for n, c in held.items() if c in (b"1", b"2", b"4"))
    assert engine.upload(spark.createDataFrame([], "name string, content binary")).count() == 0


def test_report_text(spark):
    from kinweave.operators import evaluate

    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (-1, 1)], "pred int, gt int")
    lines = evaluate.report_text(evaluate.evaluation_report(rows)).first()["text"].split("\n")
    assert lines[1].split()[-1] == "5" and lines[3].endswith("1 (20.0 %)") and lines[-1].split()[-1] == "1.0000" and len({len(x[:24]) for x in lines}) == 1
    assert evaluate.report_text(evaluate.evaluation_report(rows.limit(0))).first()["text"].count("n/a") == 6


def test_run_is_refused_cancelled_and_announced(spark):
    b = Broadcaster()
    c = Control(b)
    q, ended = b.subscribe(), []

    def slow():
        try:
            with c.run(spark):
                c.step("scan")
                spark.range(0, 400_000_000_000, 1, 4).agg(F.sum(F.sqrt("id"))).collect()  # hours
        except Cancelled as e:
            ended.append(e)

    t = threading.Thread(target=slow)
    t.start()
    until = time.time() + 30
    while not Control.stages(spark) and time.time() < until:
        time.sleep(0.1)
    assert Control.stages(spark)[0]["tasks"] >= 1
    with pytest.raises(Busy), c.run(spark):
        pass
    assert c.cancel(spark)
    t.join(60)
    assert not t.is_alive() and len(ended) == 1 and b.state["status"] == "cancelled" and not c.cancel(spark)
    assert [u["status"] for u in b.listen(q)] == ["running", "cancelled"]
    with c.run(spark):  # the next run is not
        c.step("scan")
        assert spark.range(5).count() == 5
    with pytest.raises(ValueError), c.run(spark):
        raise ValueError("broken")
    assert b.state["status"] == "failed" and "broken" in b.state["error"]


def test_cancelled_between_jobs(spark):
    c = Control(Broadcaster())
    with pytest.raises(Cancelled), c.run(spark):
        assert c.cancel(spark)
        c.step("detect")


def test_keepalive():
    b = Broadcaster()
    q = b.subscribe()
    heard = b.listen(q, every=0.05)
    assert next(heard) == {"keepalive": True}
    b.step("scan")
    assert next(heard)["step"] == "scan" and next(heard) == {"keepalive": True}
    b.step("done")
    assert [u["status"] for u in heard] == ["done"]
