"""Running totals over an order that no task has to see whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import cut


def running_total(df: DataFrame, by: list[str], order: str, value: str, out: str, ties: list[str] | None = None) -> DataFrame:
    """df with out: the sum of value over the rows before this one, among those of equal by, in the order of order (nulls first) and then ties. by must have no nulls.

    Rows are dealt by range of (by, order, ties, place in the input): ranges are even whatever the values are, since no two rows have one place. Each range is summed on its own, and what
    lies before it comes from the ranges' sums, one row per range and key. Both tables are held in the shared folder, so ranges stay the same if an executor is lost."""
    keys = [F.col(order).asc_nulls_first(), *(ties or []), "__kw_at"]
    rows = cut(df.withColumn("__kw_at", F.monotonically_increasing_id()))
    dealt = cut(rows.repartitionByRange(*by, *keys).withColumn("__kw_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "__kw_range").agg(F.sum(value).alias("__kw_sum"))
    start = sums.select(*by, "__kw_range", (F.sum("__kw_sum").over(Window.partitionBy(*by).orderBy("__kw_range")) - F.col("__kw_sum")).alias("__kw_start"))
    within = Window.partitionBy(*by, "__kw_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn(out, F.sum(value).over(within) - F.col(value)).join(start, [*by, "__kw_range"])
    return found.withColumn(out, F.col(out) + F.col("__kw_start")).drop("__kw_at", "__kw_range", "__kw_start")
