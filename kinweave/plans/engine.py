"""The whole run: scan, detect, score, embed, classify, cluster, refine, report; review, evaluation and calibration."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.operators import clustering, evaluate, hierarchy, identities, imaging, manifold, quality, refine, report, thresholds
from kinweave.operators.graph import cut
from kinweave.sources import images
from kinweave.sources.config import EngineConfig
from kinweave.sources.tables import Workspace, copy_from, load_ground_truth, put_files, read_json_lines
from kinweave.streaming.progress import Broadcaster, Control

log = logging.getLogger("kinweave")


def indexed(faces: DataFrame) -> DataFrame:
    """faces (face_id, embedding) with a whole number id, stable for a face: vectors are compared by it."""
    return faces.withColumn("id", F.xxhash64("face_id", "image_path"))


def reducer_of(config: EngineConfig) -> imaging.Reducer:
    """The configured reducer; one that isn't built in is refused."""
    r = config.reducer
    if r.kind == "pca":
        return imaging.PcaReducer(r.n_components)
    if r.kind == "umap":
        return manifold.UmapReducer(r.n_components, r.n_neighbors, r.min_dist)
    if r.kind == "none":
        return imaging.NoReducer()
    raise ValueError(f"reducer.kind {r.kind!r} is not built in: none, pca or umap")


def flat(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """rows (id, emb) with x and y for the picture: by neighbourhoods if vectors are reduced so, else the first two principal components; zeros for fewer than three rows."""
    if config.reducer.kind != "umap":
        return imaging.project_2d(rows)
    placed = manifold.UmapReducer(2, config.reducer.n_neighbors, 0.1).fit(rows)
    if placed is None:
        return rows.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    at = placed.base.select(F.col("base_id").alias("id"), F.element_at("y", 1).alias("x"), F.element_at("y", 2).alias("y"))
    return rows.join(at, "id", "left").fillna(0.0, ["x", "y"])


def group(faces: DataFrame, known: DataFrame, config: EngineConfig, step: Callable[[str], None] = lambda _: None, note: Callable[[DataFrame], None] = lambda _: None) -> DataFrame:
    """(id, label, probability, confidence, in_review) of faces (id, emb): known identities first, the rest by density, all refined with thresholds from the distances. step is told each step's name, note the
    statistics of the distances."""
    spark, reducer = faces.sparkSession, reducer_of(config)
    step("classify")
    have = config.identities.enabled and not known.isEmpty()
    hits = identities.classify_known(faces, known, config.identities.classification_threshold) if have else spark.createDataFrame([], "id bigint, pos int, distance double")
    rest = faces.join(hits.filter("pos IS NOT NULL"), "id", "left_anti")
    n = len(rest.limit(2).collect())
    step("reduce")
    reduced = reducer.reduce(rest, "emb")
    step("cluster")
    clustered = clustering.cluster(reduced, config.clustering)
    if n == 1 and have:
        clustered = clustered.withColumn("probability", F.lit(0.5))
    joined = faces.join(identities.combine(faces, hits, clustered), "id")
    step("thresholds")
    stats = thresholds.distance_stats(faces)
    note(stats)
    t = thresholds.thresholds(stats, config.adaptive_threshold, faces.count()).first()
    tuned = replace(config.refinement, merge_threshold=t["merge_threshold"], split_threshold=t["split_threshold"], reassign_threshold=t["reassign_threshold"], review_threshold=t["review_threshold"])
    step("refine")
    return refine.refine(joined, tuned).join(joined.select("id", "probability"), "id")


@dataclass
class Engine:
    """spark, where tables lie, and the models' factories."""

    spark: SparkSession
    config: EngineConfig
    detector: Callable[[], imaging.Detector] | None = None
    embedder: Callable[[], imaging.Embedder] = imaging.MeanColorEmbedder
    counts: dict[str, int] = field(default_factory=dict)
    progress: Broadcaster = field(default_factory=Broadcaster)

    def __post_init__(self) -> None:
        self.control = Control(self.progress)

    @property
    def workspace(self) -> Workspace:
        return Workspace(self.spark, f"{self.config.output_dir}/_tables")

    def ingest(self, incremental: bool = False) -> DataFrame:
        """Find, score and embed the faces of the input folder's images; incremental: of those that are not recorded yet. The faces table. What is left out is in the table skipped, with the stage and the reason, and
        counted: images that can't be decoded or that the detector fails on, faces that don't pass the gate, can't be aligned or have no vector. Only the images to be worked off are decoded, in rounds of a
        bounded number of files, each once; the counts are observed while the tables are written. An incremental run that failed on its way can be run again: what its tables hold already isn't added twice."""
        c, w = self.config, self.workspace
        self.control.step("scan")
        files = images.hashed(images.scan(self.spark, c.input_dir, recursive=c.recursive))
        fresh = images.unprocessed(files, w.read("processed_images")) if incremental else files
        scratch = Workspace(self.spark, f"{c.output_dir}/_tables/_batch")
        seen = Observation()
        fresh = scratch.write("fresh", fresh.select("path", "image_hash").observe(seen, F.count("*").alias("images")))
        self.control.step("detect")
        options = {"det_size": c.detection.det_size, "det_thresh": c.detection.det_thresh, "perturbations": c.embedding.num_perturbations, "rotation": c.embedding.rotation_range, "jitter": c.embedding.scale_jitter}
        found = scratch.write("found", imaging.detect(images.decode_files(self.spark, []), self.detector, **options))
        for part in images.rounds(fresh):  # pictures are decoded and models run once, whatever is done with their results
            found = scratch.append("found", imaging.detect(images.decode_files(self.spark, part), self.detector, **options))
        self.control.step("score")
        ranked = quality.rank_faces(found.filter("failure IS NULL").withColumns({"img": F.col("image_path"), "vec_id": F.col("ordinal")}), most=c.detection.max_faces, threshold=c.detection.det_thresh)
        at = lambda i: F.col("landmarks")[i[0]][i[1]]
        flat = ranked.withColumns({"x1": F.col("bbox")[0], "y1": F.col("bbox")[1], "x2": F.col("bbox")[2], "y2": F.col("bbox")[3], "lex": at((0, 0)), "ley": at((0, 1)), "rex": at((1, 0)), "rey": at((1, 1)), "nx": at((2, 0)), "ny": at((2, 1))})
        q = c.quality
        scored = quality.scored(flat, least_size=q.min_face_size, blur=q.blur_threshold, most_angle=q.max_pose_angle).withColumn("face_id", S.face_id(F.col("image_hash"), F.col("face_index")))
        good = quality.gate(scored, q.gate)
        keep = w.add if incremental else lambda name, rows, _: w.write(name, rows)
        keep("crops", good.select("face_id", "crops"), ["face_id"])
        self.control.step("embed")
        vectors = scratch.write("vectors", imaging.embed(good.dropDuplicates(["face_id"]), self.embedder, flip=c.embedding.use_flip, dimension=c.embedding.dimension))
        rows = good.join(vectors, "face_id").select("face_id", "image_path", "image_hash", "face_index", "bbox", "landmarks", "det_score", F.col("composite").alias("quality_score"), F.col("passed").alias("quality_passed"), F.col("reasons").alias("quality_reasons"), "embedding")
        kept = Observation()
        faces = keep("faces", rows.observe(kept, F.count("*").alias("faces")), ["face_id", "image_path"])
        none = F.lit(None).cast("int").alias("face_index")
        skip = lambda df, stage, reason: df.select("image_path", "face_index" if "face_index" in df.columns else none, F.lit(stage).alias("stage"), reason.cast("string").alias("reason"))
        failed = found.filter("failure IS NOT NULL")
        unread = F.col("failure") == imaging.UNREADABLE
        skipped = skip(failed.filter(unread), "decode", F.col("failure")).unionByName(skip(failed.filter(~unread), "detect", F.col("failure")))
        skipped = skipped.unionByName(skip(scored.join(good.select("face_id"), "face_id", "left_anti"), "gate", F.concat_ws(",", "reasons")))
        unaligned = F.col("crops").isNull()
        without = good.join(vectors.select("face_id"), "face_id", "left_anti")
        skipped = skipped.unionByName(skip(without.filter(unaligned), "align", F.lit("fewer than five landmarks"))).unionByName(skip(without.filter(~unaligned), "embed", F.lit("no vector")))
        stages = ("decode", "detect", "gate", "align", "embed")
        left = Observation()
        keep("skipped", skipped.observe(left, *[F.count_if(F.col("stage") == k).alias(f"skipped_{k}") for k in stages]), ["image_path", "face_index", "stage", "reason"])
        keep("processed_images", fresh.withColumnRenamed("path", "image_path"), ["image_path", "image_hash"])
        self.counts = {k: v or 0 for o in (seen, kept, left) for k, v in o.get.items()}
        log.info("processed %s", self.counts)
        return faces

    def upload(self, files: DataFrame) -> DataFrame:
        """Put files (name, content) into the input folder; (name, file_name) of those put. Names keep their last part only. One that is taken, in the folder or by another of these files, gets a number before its
        extension; of files of one name and one content there is one. Files that are no images by their extension, and rows with a null, are left out. Busy while a run is going. Contents are shuffled once."""
        with self.control.run(self.spark):
            given = images.with_extension(files.dropna(subset=["name", "content"]), "name", S.IMAGE_EXTENSIONS)
            given = given.select("name", "content", S.basename(F.col("name")).alias("own"), S.content_hash(F.col("content")).alias("hash"))
            new = given.select("own", "hash").distinct().select(F.concat("hash", F.lit("/"), "own").alias("image_path"), F.lit(1).alias("ord"))
            try:
                there = images.scan(self.spark, self.config.input_dir, recursive=False).select("path")
            except AnalysisException:  # no folder yet
                there = self.spark.createDataFrame([], "path string")
            old = there.select(F.concat(F.lit("there/"), S.basename(F.col("path"))).alias("image_path"), F.lit(0).alias("ord"))
            ordered = old.unionByName(new).withColumn("ord", F.struct("ord", "image_path")).withColumn("label", F.lit(0))
            named = cut(report.manifest(ordered).filter("ord.ord = 1").select("image_path", "file_name"))
            kept = given.withColumn("image_path", F.concat("hash", F.lit("/"), "own")).dropDuplicates(["image_path"]).join(named, "image_path")
            put_files(kept.select(F.col("file_name").alias("name"), "content"), self.config.input_dir)
            return named.select(F.substring_index("image_path", "/", -1).alias("name"), "file_name")

    def run(self, incremental: bool = False) -> DataFrame:
        """Ingest, group and write; returns the assignments. Busy while another run or regrouping of this engine is going."""
        with self.control.run(self.spark):
            if self.detector is not None:
                self.ingest(incremental)
            return self._regroup()

    def cancel(self) -> bool:
        """End the run that is going, from another thread; whether there was one. Tables keep what their last finished write left."""
        return self.control.cancel(self.spark)

    def regroup(self) -> DataFrame:
        """Group and write what the tables hold; the assignments."""
        with self.control.run(self.spark):
            return self._regroup()

    def _regroup(self) -> DataFrame:
        w = self.workspace
        faces = indexed(w.read("faces"))
        if faces.isEmpty():
            self.control.step("done")
            return w.read("assignments")
        rows = faces.select("id", F.col("embedding").cast("array<double>").alias("emb"))
        found = group(rows, w.read("identities"), self.config, self.control.step, self.note_thresholds)
        self.control.step("assign")
        out = w.write("assignments", faces.select("id", "face_id", "image_path").join(found, "id").select("face_id", "image_path", "label", "probability", "confidence", "in_review"))
        self.write_output(faces, out)
        self.control.step("done")
        log.info("grouped %s", self.status())
        return out

    def note_thresholds(self, stats: DataFrame) -> None:
        thresholds.threshold_report(stats, self.config.adaptive_threshold).coalesce(1).write.mode("overwrite").text(f"{self.config.output_dir}/_metadata/threshold_report")

    def write_output(self, faces: DataFrame, assigned: DataFrame) -> None:
        """Reports and manifest: folders of tables by cluster_name, and JSON reports. A face without an assignment is noise with confidence 0."""
        out, w = self.config.output_dir, self.workspace
        defaults = {"label": -1, "probability": 0.0, "confidence": 0.0, "in_review": True}
        rows = faces.join(assigned, ["face_id", "image_path"], "left").fillna(defaults).withColumn("ord", F.col("id"))
        self.control.step("plot")
        w.write("plot_points", report.plot_points(flat(rows.withColumn("emb", F.col("embedding").cast("array<double>")), self.config)).select("face_id", "label", "x", "y", "marker", "size", "alpha"))
        picture = self.spark.createDataFrame([("_metadata/confidence_heatmap.png", bytearray(imaging.png(report.plot_image(w.read("plot_points"), title=report.plot_title(rows)))))], "name string, content binary")
        put_files(picture, out)
        self.control.step("report")
        w.write("manifest", report.manifest(rows).withColumn("cluster_name", S.person_name(F.col("label"))).drop("embedding"), partition_by="cluster_name")
        rows.filter("in_review").select("face_id", "image_path", F.col("label").alias("current_label"), "confidence", "quality_score").write.mode("overwrite").json(f"{out}/_metadata/review_items")
        rows.select("face_id", F.col("label").alias("cluster_label"), S.person_name(F.col("label")).alias("cluster_name"), "confidence", "image_path", "bbox", "quality_score", "det_score").write.mode("overwrite").json(f"{out}/_metadata/face_metadata")
        report.report_json(rows).coalesce(1).write.mode("overwrite").text(f"{out}/_metadata/cluster_report")

    def review_items(self) -> DataFrame:
        return read_json_lines(self.spark, f"{self.config.output_dir}/_metadata/review_items", "face_id string, image_path string, current_label int, confidence double, quality_score double")

    def face_metadata(self) -> DataFrame:
        schema = "face_id string, cluster_label int, cluster_name string, confidence double, image_path string, bbox array<double>, quality_score double, det_score double"
        return read_json_lines(self.spark, f"{self.config.output_dir}/_metadata/face_metadata", schema)

    def clean_output(self) -> int:
        """Remove the person folders and the review queue of earlier runs, through Spark's file system; tables, reports and logs stay. The number of folders removed."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.config.output_dir)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        old = [x.getPath() for x in fs.listStatus(root) if x.isDirectory() and (x.getPath().getName().startswith("Person_") or x.getPath().getName() == "_review_queue")]
        return sum(bool(fs.delete(p, True)) for p in old)

    def copy_files(self) -> dict[str, int]:
        """Clear earlier output, then copy each manifest row's image into its person folder and, with save_crops, each face's first crop as PNG into its crops folder, faces in review into _review_queue. Written in the
        tasks, wherever Arrow's file systems reach (a mounted folder, HDFS, an object store). Numbers of photos, crops and missing, of manifest rows whose image is gone."""
        c, w = self.config, self.workspace
        self.clean_output()
        rows = w.read("manifest").select("cluster_name", "image_path", "file_name")
        if rows.isEmpty():
            return {"photos": 0, "missing": 0, "crops": 0}
        found = copy_from(rows.select(F.col("image_path").alias("source"), F.concat_ws("/", "cluster_name", "file_name").alias("name")), c.output_dir)
        counts = {"photos": found["copied"], "missing": found["missing"]}
        if counts["missing"]:
            log.warning("%s source images are missing", counts["missing"])
        counts["crops"] = 0
        if c.save_crops:
            # photos that are equal byte by byte have equal faces, of which one crop is written
            crops = w.read("crops").filter("crops IS NOT NULL").dropDuplicates(["face_id"])
            faces = w.read("assignments").drop("image_path").distinct().join(crops, "face_id").withColumn("crop", F.col("crops")[0])
            named = F.concat(S.person_name(F.col("label")), F.lit("/crops/"), "face_id", F.lit(".png"))
            own = faces.filter("label >= 0").select(named.alias("name"), "crop").unionByName(faces.filter("in_review").select(F.concat(F.lit("_review_queue/"), "face_id", F.lit(".png")).alias("name"), "crop"))
            counts["crops"] = put_files(imaging.encoded(own), c.output_dir)
        return counts

    def correct(self, changes: DataFrame) -> DataFrame:
        """Upsert corrections (face_id, label, seq)."""
        w = self.workspace
        return w.write("corrections", identities.upsert(w.read("corrections"), changes, "face_id", "seq"))

    def review_action(self, face_id: str, action: str, label: int | None = None) -> DataFrame:
        """accept, move (to label), new or discard one face, as a correction."""
        w = self.workspace
        current = w.read("assignments").filter(F.col("face_id") == face_id).first()
        if current is None or action not in ("accept", "move", "new", "discard") or (action == "move" and label is None):
            raise ValueError(f"cannot {action} {face_id}")
        seq = (w.read("corrections").agg(F.max("seq")).first()[0] or 0) + 1
        if action == "new":
            label = identities.next_label(w.read("assignments"), w.read("corrections")).first()[0]
        chosen = {"accept": current["label"], "move": label, "new": label, "discard": -2}[action]
        return self.correct(self.spark.createDataFrame([(face_id, int(chosen), seq)], "face_id string, label int, seq bigint"))

    def apply_corrections(self) -> DataFrame:
        """Learn from the corrections and group again with what is known then; the assignments."""
        self.learn()
        return self.regroup()

    def learn(self) -> DataFrame:
        """Merge what the corrections teach into the known identities."""
        w = self.workspace
        rows = indexed(w.read("faces"))
        changes = w.read("corrections").join(rows.select("face_id", "id"), "face_id").select("id", "label")
        learned = identities.learn(rows.select("id", F.col("embedding").alias("emb")), changes)
        known = w.read("identities")
        new = learned.select("pos", "identity_id", "centroid") if known.isEmpty() else identities.merge_identities(known, learned, self.config.identities.merge_threshold)
        return w.write("identities", new)

    def evaluate(self, truth_path: str) -> DataFrame:
        w = self.workspace
        matched = evaluate.match_ground_truth(w.read("assignments"), load_ground_truth(self.spark, truth_path))
        found = evaluate.evaluation_report(matched.select(F.col("label").alias("pred"), F.col("gt_label").alias("gt")))
        if found.first()["valid"] >= 2:
            found.write.mode("overwrite").json(f"{self.config.output_dir}/_metadata/evaluation_report")
        return found

    def calibrate(self, truth_path: str) -> DataFrame:
        """The grid's settings with their measures; best marks the one with the largest f1."""
        faces = evaluate.match_ground_truth(indexed(self.workspace.read("faces")), load_ground_truth(self.spark, truth_path))
        found = calibrate(faces.select("id", F.col("embedding").cast("array<double>").alias("emb"), F.col("gt_label").alias("gt")))
        best = evaluate.best_of_grid(found).select("ordinal", F.lit(True).alias("best"))
        found = found.join(best, "ordinal", "left").withColumn("best", F.coalesce("best", F.lit(False))).orderBy("ordinal")
        found.write.mode("overwrite").json(f"{self.config.output_dir}/_metadata/calibration_results")
        return found

    def status(self) -> str:
        """Counts of the tables, as JSON."""
        w = self.workspace
        totals = report.report_totals(w.read("assignments")).first().asDict()
        return json.dumps(totals | {"n_identities": w.read("identities").count(), "n_corrections": w.read("corrections").count()})


def calibrate(rows: DataFrame, sizes: tuple[int, ...] = (2, 3, 5), samples: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(ordinal, min_cluster_size, min_samples, f1, ari, noise_ratio, n_clusters) of each setting with two clustered rows or more, from rows (id, emb, gt)."""
    spark, out, k = rows.sparkSession, [], 0
    everything = cut(hierarchy.grid(rows, sizes, samples).join(rows.select("id", "gt"), "id"))
    for size in sizes:
        for sample in samples:
            found = everything.filter((F.col("min_cluster_size") == size) & (F.col("min_samples") == sample))
            table = evaluate.contingency(found.select(F.col("label").alias("pred"), "gt"))
            one = evaluate.pairwise(table).crossJoin(evaluate.adjusted_rand(table)).crossJoin(clustering.summary(found)).first()
            if one["n_faces"] - one["n_noise"] >= 2:
                out.append((k, size, sample, one["f1"], one["ari"], one["noise_ratio"], one["n_clusters"]))
            k += 1
    return spark.createDataFrame(out, "ordinal int, min_cluster_size int, min_samples int, f1 double, ari double, noise_ratio double, n_clusters bigint")
