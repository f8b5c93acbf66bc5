"""Tables of a workspace folder: written as Parquet, read with fixed schemas, empty where there is none yet."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "processed_images": "image_path string, image_hash string",
    "faces": "face_id string, image_path string, image_hash string, face_index int, bbox array<double>, landmarks array<array<double>>, det_score double, quality_score double, quality_passed boolean, quality_reasons array<string>, embedding array<float>",
    "assignments": "face_id string, image_path string, label int, probability double, confidence double, in_review boolean",
    "identities": "pos int, identity_id string, centroid array<double>",
    "corrections": "face_id string, label int, seq bigint",
    "crops": "face_id string, crops array<binary>",
    "manifest": "face_id string, image_path string, file_name string, label int, confidence double, cluster_name string",
    "plot_points": "face_id string, label int, x double, y double, marker string, size double, alpha double",
    "skipped": "image_path string, face_index int, stage string, reason string",
}

#: Tables with more columns than their schema says, which is for those that aren't written yet.
DERIVED = ("manifest", "plot_points")


def truth_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """(key, gt_label) from rows of JSON objects that map keys to labels."""
    return texts.select(F.explode(F.from_json(column, "map<string,int>")).alias("key", "gt_label"))


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_from_json(spark.read.text(path, wholetext=True))


def read_json_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_log(spark: SparkSession, path: str, last: int = 200) -> DataFrame:
    """(n, line, total) of the last lines of one log file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return lines.orderBy(F.desc("n")).limit(last).crossJoin(lines.agg(F.count("*").alias("total"))).orderBy("n")


def lookup(rows: DataFrame, key: str, value: object, total: str = "total") -> DataFrame:
    """The rows whose key has the value, with the number of all rows; none if there is no such row."""
    return rows.filter(F.col(key) == value).crossJoin(rows.agg(F.count("*").alias(total)))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a folder of JSON lines; none where there is no such folder yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def put_files(rows: DataFrame, folder: str) -> int:
    """Write each row's content under its name (a path below folder) in the tasks, through Arrow's file systems: a local or mounted path, or the address of one that Arrow reaches. The number written; a task
    that is run again writes the same files."""

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))
        n, made = 0, set()
        for b in batches:
            for i in range(b.num_rows):
                at = f"{root}/{b.column(0)[i].as_py()}"
                parent = at.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(at) as out:
                    out.write(b.column(1)[i].as_py())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select("name", "content").mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def file_system(path: str):
    """Arrow's file system of a path as Spark names it, and the path there."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else os.path.abspath(path)
    scheme, _, rest = path.partition("://")
    host, _, below = rest.partition("/")
    system, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"{root.rstrip('/')}/{below}"


def copy_from(rows: DataFrame, folder: str, *, piece: int = 1 << 23) -> dict[str, int]:
    """Copy each row's file source to its name, a path below folder: the tasks read and write, so no content is shuffled, each file is read once and a task holds one piece. A copy has a name of its own until it is
    whole, so tasks that fail or run twice leave whole files only. The numbers copied and missing, of sources that aren't there."""

    def copy(batches):
        import pyarrow as pa

        system, root = file_system(folder)
        done, missing, made = 0, 0, set()
        for b in batches:
            for source, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, path = file_system(source)
                at = f"{root}/{name}"
                parent, _, last = at.rpartition("/")
                try:
                    content = own.open_input_stream(path)
                except FileNotFoundError:
                    missing += 1
                    continue
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                unfinished = f"{parent}/.{last}.{uuid.uuid4().hex}"
                with content:
                    try:
                        with system.open_output_stream(unfinished) as out:
                            while data := content.read(piece):
                                out.write(data)
                        try:
                            system.move(unfinished, at)
                        except OSError:  # where a move doesn't replace what is there
                            system.delete_file(at)
                            system.move(unfinished, at)
                    except BaseException:
                        if system.get_file_info(unfinished).is_file:
                            system.delete_file(unfinished)
                        raise
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64()), pa.array([missing], pa.int64())], ["done", "missing"])

    found = rows.select("source", "name").repartition("name").mapInArrow(copy, "done bigint, missing bigint")
    one = found.agg(F.coalesce(F.sum("done"), F.lit(0)).alias("done"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing")).first()
    return {"copied": one["done"], "missing": one["missing"]}


@dataclass(frozen=True)
class Workspace:
    """Versions of each table lie side by side; a pointer file names the current one, so a table that is being read is never overwritten and a failed write leaves the old one."""

    spark: SparkSession
    root: str

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/CURRENT"

    def current(self, name: str) -> str | None:
        fs, jvm = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(self._pointer(name))
        if not fs.exists(at):
            return None
        return f"{self.root}/{name}/{self.spark.read.text(self._pointer(name)).first()[0]}"

    def read(self, name: str) -> DataFrame:
        at = self.current(name)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(at) if name in SCHEMAS and name not in DERIVED else self.spark.read.parquet(at)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, rows: DataFrame, partition_by: str | None = None) -> DataFrame:
        version = uuid.uuid4().hex
        writer = rows.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/{version}")
        self._point(name, version)
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Append to the current version, or begin one."""
        at = self.current(name)
        if at is None:
            return self.write(name, rows)
        rows.write.mode("append").parquet(at)
        return self.read(name)

    def add(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Append the rows whose keys (nulls equal) the table doesn't hold yet, so that a run that is done again after a failure adds what is missing and nothing twice."""
        if self.current(name) is None:
            return self.write(name, rows)
        there = self.read(name).select(*[F.col(k).alias(f"__there_{k}") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__there_{k}"))
        return self.append(name, rows.join(there, same, "left_anti"))

    def clear(self, name: str) -> None:
        fs, jvm = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self._pointer(name)), False)

    def _point(self, name: str, version: str) -> None:
        fs, jvm = self._fs()
        out = fs.create(jvm.org.apache.hadoop.fs.Path(self._pointer(name)), True)
        out.write(bytearray(version.encode()))
        out.close()
