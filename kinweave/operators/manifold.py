"""Neighbourhood-preserving reduction (UMAP): a fuzzy graph of nearest neighbours, laid out in few dimensions by stochastic gradient steps in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.vectors import double, map_arrow, matrix, to_lists, vector_sums
from kinweave.operators.graph import cut
from kinweave.operators.imaging import PcaReducer
from kinweave.operators.similarity import knn, nearest_k

#: Rows that one task lays out; more are dealt by hash.
LAID = 8192
#: Times that blocks see each other's moves.
ROUNDS = 10
#: Rows drawn to push each row away for each neighbour that pulls it.
PUSHES = 5
#: A neighbour of more than this share of all links goes to the tasks by itself, so there are fewer than a thousand.
HOT = 1e-3


def curve(min_dist: float) -> tuple[float, float]:
    """a and b for which 1 / (1 + a x^(2b)) is nearest, in squares on 0 to 3, to 1 up to min_dist and exp(min_dist - x) beyond."""
    x = np.linspace(0, 3, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist)))
    p = np.array([0.5, 0.0])  # the logarithm of a, and that of b
    cost = np.inf
    damp = 1e-2
    for _ in range(200):
        u = np.exp(p[0]) * x ** (2 * np.exp(p[1]))
        off = 1 / (1 + u) - want
        slope = -u / (1 + u) ** 2
        j = np.stack([slope, slope * 2 * np.exp(p[1]) * np.log(x)], 1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), -j.T @ off)
        v = np.exp(p[0] + step[0]) * x ** (2 * np.exp(p[1] + step[1]))
        new = ((1 / (1 + v) - want) ** 2).sum()
        if new < cost:
            p, cost, damp = p + step, new, damp / 3
        else:
            damp *= 3
    return float(np.exp(p[0])), float(np.exp(p[1]))


def weights(d: np.ndarray) -> np.ndarray:
    """Memberships of rows' neighbours at distances d: exp(-(d - nearest positive one) / s), 1 at most, with s so that a row's sum is the binary logarithm of their number (found by bisection)."""
    goal = math.log2(d.shape[1]) if d.shape[1] > 1 else 1.0
    nearest = np.where(d > 0, d, np.inf).min(1)
    over = np.maximum(d - np.where(np.isfinite(nearest), nearest, 0)[:, None], 0)
    low, high, s = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        much = np.exp(-over / s[:, None]).sum(1) > goal
        high, low = np.where(much, s, high), np.where(much, low, s)
        s = np.where(np.isfinite(high), (low + high) / 2, s * 2)
    s = np.maximum(s, 1e-3 * np.maximum(d.mean(1), 1e-12))
    return np.exp(-over / s[:, None])


def memberships(near: DataFrame) -> DataFrame:
    """(id, neighbor, w) of (id, neighbor, distance), with the same number of neighbours for each id."""
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))).alias("s")).select("id", F.col("s.neighbor").alias("o"), F.col("s.distance").alias("d"))
    found = map_arrow(lists, "id bigint, o array<bigint>, w array<double>", lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), to_lists(weights(matrix(b.column(2))))], ["id", "o", "w"]))
    return found.select("id", F.explode(F.arrays_zip("o", "w")).alias("s")).select("id", F.col("s.o").alias("neighbor"), F.col("s.w").alias("w"))


def fuzzy(rows: DataFrame, k: int) -> DataFrame:
    """(id, neighbor, w): each row's k nearest others by cosine, with the weight of the union of both rows' memberships. A row has k links of its own, however many rows have it as their neighbour."""
    own = cut(memberships(knn(rows, k, vec_col="v")))
    back = own.select(F.col("neighbor").alias("id"), F.col("id").alias("neighbor"), F.col("w").alias("r"))
    return cut(own.join(back, ["id", "neighbor"], "left").select("id", "neighbor", (F.col("w") + F.coalesce("r", F.lit(0.0)) * (1 - F.col("w"))).alias("w")))


def settle(ids: np.ndarray, y: np.ndarray, others: np.ndarray, w: np.ndarray, seen: np.ndarray, a: float, b: float, epochs: range, total: int, rng: np.random.Generator) -> np.ndarray:
    """y after some epochs of the layout: for each link that is drawn (by its weight) a row moves to the neighbour, where that is now or was seen last, and away from PUSHES rows of the block."""
    at = np.searchsorted(ids, others).clip(0, len(ids) - 1)
    here = ids[at] == others
    for e in epochs:
        alpha = 1 - e / total
        for s in range(others.shape[1]):
            x = np.flatnonzero(rng.random(len(ids)) < w[:, s])
            off = y[x] - np.where(here[x, s][:, None], y[at[x, s]], seen[x, s])
            d = (off * off).sum(1)
            pull = np.where(d > 0, -2 * a * b * np.maximum(d, 1e-12) ** (b - 1) / (1 + a * d**b), 0)
            y[x] += alpha * (pull[:, None] * off).clip(-4, 4)
            for _ in range(PUSHES):
                off = y[x] - y[rng.integers(len(ids), size=len(x))]
                d = (off * off).sum(1)
                y[x] += alpha * ((2 * b / ((1e-3 + d) * (1 + a * d**b)))[:, None] * off).clip(-4, 4)
    return y


def mover(dims: int, a: float, b: float, span: range, epochs: int, seed: list[int]) -> Callable:
    """settle() for the rows of one block as a table."""

    def move(key, t):
        t = t.sort_by("id")
        ids, y, w = t.column("id").to_numpy(), matrix(t.column("y")).copy(), matrix(t.column("w"))
        others = t.column("o").combine_chunks().flatten().to_numpy().reshape(w.shape)
        y = settle(ids, y, others, w, matrix(t.column("seen")).reshape(*w.shape, dims), a, b, span, epochs, np.random.default_rng([*seed, key[0].as_py()]))
        return pa.table({"id": pa.array(ids), "y": to_lists(y)})

    return move


def lay_out(rows: DataFrame, links: DataFrame, dims: int, *, min_dist: float = 0.0, epochs: int = 200, seed: int = 42, block: int = LAID) -> DataFrame:
    """(id, y) for rows (id, v) under links (id, neighbor, w). Starts at the principal components. Rows are dealt in blocks by hash, so those that push are a fair draw of all; blocks run a tenth of the epochs each
    and then learn where the others' rows are. Up to `block` rows are one block."""
    a, b = curve(min_dist)
    n = rows.count()
    blocks, k = math.ceil(n / block), links.groupBy("id").count().agg(F.max("count")).first()[0]
    noise = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 20)) / (1 << 20) * 1e-3
    start = cut(PcaReducer(dims).reduce(rows.withColumn("y", F.col("v")), "y").select("id", "y"))
    scale = start.agg(F.max(F.array_max(F.transform("y", lambda x: F.abs(x))))).first()[0] or 1.0
    grown = F.concat("y", F.array_repeat(F.lit(0.0), dims)) if dims else F.col("y")
    place = cut(start.select("id", F.transform(F.slice(grown, 1, dims), lambda x, i: F.round(x * (10 / scale), 4) + noise(i)).alias("y")))
    degree = links.groupBy("neighbor").agg(F.count("*").alias("n"))
    hot = cut(degree.filter(F.col("n") > HOT * n * k).select("neighbor"))
    hot_links, cold_links = cut(links.join(F.broadcast(hot), "neighbor", "left_semi")), cut(links.join(F.broadcast(hot), "neighbor", "left_anti"))
    rounds = ROUNDS if blocks > 1 else 1
    for r in range(rounds):
        span = range(epochs * r // rounds, epochs * (r + 1) // rounds)
        there = place.withColumnsRenamed({"id": "neighbor", "y": "seen"})
        few = F.broadcast(there.join(F.broadcast(hot), "neighbor", "left_semi"))
        drawn = cold_links.join(there, "neighbor").unionByName(hot_links.join(few, "neighbor"))
        lists = drawn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("neighbor", "w", "seen"))).alias("s"))
        tasks = lists.join(place, "id").select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int").alias("p"), "id", "y", F.col("s.neighbor").alias("o"), F.col("s.w").alias("w"), F.flatten("s.seen").alias("seen"))

        place = cut(tasks.groupBy("p").applyInArrow(mover(dims, a, b, span, epochs, [seed, r]), "id bigint, y array<double>"))
    return place


@dataclass(frozen=True)
class Fitted:
    """What a reduction was fitted on: base (id, v, y), kept as a table."""

    base: DataFrame
    neighbors: int

    def transform(self, rows: DataFrame, vec_col: str = "emb") -> DataFrame:
        """rows (id, vec_col) with vec_col where the mean, weighted by membership, of their nearest fitted rows lies; null for a vector that is null or not finite."""
        k = min(self.neighbors, self.base.count())
        near = nearest_k(usable(rows, vec_col), self.base, k, id_col="id", vec_col="v", key_col="base_id", target_col="v")
        w = memberships(near.select("id", F.col("base_id").alias("neighbor"), "distance"))
        parts = w.join(self.base.select(F.col("base_id").alias("neighbor"), "y"), "neighbor").select("id", F.concat(F.transform("y", lambda x: x * F.col("w")), F.array("w")).alias("y"))
        means = vector_sums(parts, "id", "y").select("id", F.transform(F.slice("total", 1, F.size("total") - 1), lambda x: x / F.element_at("total", -1)).alias("__y"))
        return rows.join(means, "id", "left").withColumn(vec_col, F.col("__y")).drop("__y")

    def save(self, path: str) -> None:
        self.base.withColumn("neighbors", F.lit(self.neighbors)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        base = spark.read.parquet(path)
        return cls(base.drop("neighbors"), base.select("neighbors").first()[0])


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """(id, v) of the rows with a vector of finite numbers."""
    return rows.select("id", double(F.col(vec_col)).alias("v")).filter("v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")


@dataclass(frozen=True)
class UmapReducer:
    """Vectors of rows (id, vec) in fewer dimensions, by cosine neighbourhoods. Fewer than three usable rows pass through; there are never more components or neighbours than usable rows less one. A fixed seed gives a
    fixed result, whatever the partitions of the rows."""

    components: int = 50
    neighbors: int = 15
    min_dist: float = 0.0
    epochs: int = 200
    seed: int = 42
    block: int = LAID

    def fit(self, rows: DataFrame, vec_col: str = "emb") -> Fitted | None:
        own = cut(usable(rows, vec_col))
        n = own.count()
        if n < 3:
            return None
        k, dims = min(self.neighbors, n - 1), min(self.components, n - 1)
        found = lay_out(own, fuzzy(own, k), dims, min_dist=self.min_dist, epochs=self.epochs, seed=self.seed, block=self.block)
        return Fitted(cut(own.join(found, "id").withColumnRenamed("id", "base_id")), k)

    def reduce(self, rows: DataFrame, vec_col: str) -> DataFrame:
        model = self.fit(rows, vec_col)
        if model is None:
            return rows
        return rows.join(model.base.select(F.col("base_id").alias("id"), F.col("y").alias("__y")), "id", "left").withColumn(vec_col, F.col("__y")).drop("__y")
