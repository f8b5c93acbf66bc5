"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to Python, unless the session has a limit of its own; a longer row is a batch by itself.
BATCH_BYTES, SPARK_DEFAULT = "4m", ("64m", "67108864", "67108864b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a folder is made and set if all run on one machine (local mode), else this raises: executors don't see each
    other's folders. The caller's deployment clears it (spark.cleaner.referenceTracking.cleanCheckpoints for checkpoints); a folder that is made here is removed when Python ends."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else ""
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="kinweave-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = "file://" + made
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and held in the shared folder; it survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a written table in the shared folder."""
    return os.path.join(shared_dir(spark), f"kinweave-{what}-{uuid.uuid4().hex}")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null stays null. lower() has a fast path for ASCII, which translate() hasn't."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def residue(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def unit_hash(key: Column) -> Column:
    """A repeatable number in [0, 1) for each key; null keys get that of -1."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("-1")), F.lit(77)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded(spark: SparkSession) -> None:
    """From now on Arrow batches have BATCH_BYTES at most, if the session still has Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in SPARK_DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def decoded(column: pa.Array) -> list[str | None]:
    """Strings of a column of UTF-8 bytes; malformed bytes become U+FFFD."""
    return [None if t is None else t.decode("utf-8", "replace") for t in column.to_pylist()]


def release() -> None:
    """Give memory that is free back to the system: workers are used again, for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


#: What operators keep in a worker for their next task, by operator.
KEPT: dict[str, dict] = {}


def forget(but: str = "") -> None:
    """Drop what other operators have kept in this worker: it now works for another stage."""
    kept = [k for name, k in KEPT.items() if name != but and k]
    for k in kept:
        k.clear()
    if kept:
        release()


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], keeps: str = "") -> DataFrame:
    """Apply fn to every Arrow batch, which are bounded in bytes; empty results are skipped. keeps: whose kept things stay (see KEPT)."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(but=keeps)
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        release()

    return df.mapInArrow(run, schema)
