"""Column expressions and Arrow kernels for vectors. At rest vectors are ARRAY<FLOAT>; arithmetic is in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; null for a zero vector. The vector, then its norm, are bound by lambdas of one call each, so they are not computed again for every element."""
    bound = F.transform(F.array(double(v)), lambda x: F.struct(x.alias("v"), norm(x).alias("n")))
    return F.element_at(F.transform(bound, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"]))), 1)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector has similarity 0 to any other."""
    n = norm(a) * norm(b)
    return 1.0 - F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(double(a), double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, dim) doubles of a list column without nulls; no copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def to_lists(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(m, np.float64).ravel()))


def units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def map_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def vector_sums(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, n, total) per key: each task adds up its rows' vectors, so a key of any size sends one short row per task."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), double(F.col(vec)).alias("__v")).filter("__v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            keys, m = np.array(b.column(0).to_pylist(), object), matrix(b.column(1))
            for k in set(keys):
                mine = m[keys == k]
                n, total = held.get(k, (0, 0.0))
                held[k] = n + len(mine), total + mine.sum(0)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), b.schema.field(0).type), pa.array([n for n, _ in held.values()], pa.int64()), to_lists(np.stack([t for _, t in held.values()]))], [key, "n", "total"])

    parts = rows.mapInArrow(run, f"`{key}` {kind}, n bigint, total array<double>")
    cells = parts.select(key, "n", F.posexplode("total").alias("pos", "x")).groupBy(key, "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return cells.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total"))


def vector_mean(df: DataFrame, key: str, vec: str, out: str = "centroid") -> DataFrame:
    """(key, n, out): the mean vector per key, not normalised."""
    return vector_sums(df, key, vec).select(key, "n", F.transform("total", lambda x: x / F.col("n")).alias(out))
