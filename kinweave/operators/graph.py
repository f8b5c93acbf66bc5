"""Connected components, and the shared folder in which iterations are cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a folder is made in local mode and removed when Python ends; on a cluster this raises, since executors don't see each other's folders."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
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
    """df computed once, in the folder that all executors share. A checkpoint keeps the estimate of its size, and that of a join is the product of both sides': in a loop of joins its digits double with
    every round, until planning takes longer than the work. Once an estimate is beyond 2**60 bytes the rows go on without any."""
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() <= 1 << 60:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), done._jdf.schema(), False), spark)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each of nodes (id) over edges (a, b). Each round every node takes the smallest component among its neighbours', then its component's component;
    the number of rounds grows with the logarithm of the longest path on usual graphs."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        seen = both.join(state.withColumnsRenamed({"id": "b", "component": "c"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        hooked = state.join(seen, "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("next"))
        jump = hooked.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = cut(hooked.join(jump, "next").select("id", F.least("next", "far").alias("component"), (F.least("next", "far") != F.col("component")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("id", "component")
        state = new.select("id", "component")


def numbered(rows: DataFrame, order: str, out: str) -> DataFrame:
    """rows with out: the place (from 0) in the order of the column order, whose values differ. Rows are dealt by range; a range's first number comes from the ranges' counts, so no task sees all."""
    dealt = cut(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    start = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))  # one row per range
    within = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return dealt.withColumn("__nth", within).join(start, "__range").withColumn(out, F.col("__start") + F.col("__nth")).drop("__range", "__nth", "__start")


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between places under n as few as connect what they all connect: (smallest place of each connected set, other place)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (label[label] != label).any():
            label = label[label]
    linked = np.flatnonzero(label != np.arange(n))
    return label[linked], linked
