"""Vector joins: nearest centroid, all pairs in blocks, neighbours within a radius, nearest neighbours."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.vectors import double, map_arrow, matrix, units
from kinweave.operators.graph import cut, numbered, shared_dir
from kinweave.sources.tables import file_system

#: Numbers of a centroid table that is sent to the tasks (64 MB); a larger one is joined in blocks.
MOST_NUMBERS = 8_000_000
#: Rows of a block of the all-pairs product.
BLOCK = 2048


#: Distances that a task holds at once.
ROOM = 1 << 22


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Euclidean ones are 0 where rounding errors are all that is left, so equal vectors are at distance 0."""
    if metric == "cosine":
        return 1.0 - units(a) @ units(b).T
    x, y = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    squares = x + y - 2 * a @ b.T
    squares[squares < 1e-13 * (x + y)] = 0
    return np.sqrt(squares)


def least_k(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest finite values of each row of m; of equal ones the first columns. Never more than k for a row."""
    k = min(k, m.shape[1])
    kth = np.partition(m, k - 1, axis=1)[:, k - 1]
    x, y = np.nonzero((m <= kth[:, None]) & np.isfinite(m))
    tie = m[x, y] == kth[x]
    room = k - np.bincount(x[~tie], minlength=len(m))
    nth = np.cumsum(tie)
    before = np.concatenate(([0], np.cumsum(np.bincount(x[tie], minlength=len(m)))))[:-1]
    keep = ~tie | (nth - before[x] <= room[x])
    return x[keep], y[keep]


def nearest_k(rows: DataFrame, targets: DataFrame, k: int, *, id_col: str, vec_col: str, key_col: str, target_col: str) -> DataFrame:
    """(id, key, distance, rank): the k cosine-nearest targets of each row; ties by the smaller key. A table of targets up to MOST_NUMBERS numbers goes to the tasks and each batch is compared with it;
    a larger one is dealt in blocks that meet every block of rows, and k candidates of each block are kept."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    key_kind = targets.schema[key_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{key_col}` {key_kind}, distance double"
    left = rows.select(id_col, double(F.col(vec_col)).alias("v")).filter("v IS NOT NULL")
    right = cut(targets.select(key_col, double(F.col(target_col)).alias("t")).filter("t IS NOT NULL"))
    shape = right.agg(F.count("*").alias("n"), F.max(F.size("t")).alias("d")).first()
    n, dim = shape["n"], shape["d"] or 0
    if not n:
        return spark.createDataFrame([], schema + ", rank int")

    def best(ids: pa.Array, v: np.ndarray, keys: pa.Array, t: np.ndarray) -> pa.Table:
        out, step = [], max(1, ROOM // max(1, len(t)))
        for a in range(0, len(v), step):
            d = distances(v[a : a + step], t, "cosine")
            x, y = least_k(d, k)
            out.append(pa.RecordBatch.from_arrays([ids.take(pa.array(x + a)), keys.take(pa.array(y)), pa.array(d[x, y])], [id_col, key_col, "distance"]))
        return pa.Table.from_batches(out)

    if n * dim <= MOST_NUMBERS:
        table = right.orderBy(key_col).toArrow().combine_chunks()
        keys, t = table.column(0).chunk(0), matrix(table.column(1))
        found = map_arrow(left, schema, lambda b: best(b.column(0), matrix(b.column(1)), keys, t))
    else:
        parts = math.ceil(n * dim / MOST_NUMBERS)
        blocks = right.withColumn("b", F.pmod(F.xxhash64(key_col), F.lit(parts)).cast("int"))
        dealt = left.withColumn("s", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({id_col: a.column(id_col).slice(0, 0), key_col: b.column(key_col).slice(0, 0), "distance": pa.array([], pa.float64())})
            a, b = a.combine_chunks(), b.sort_by(key_col).combine_chunks()
            return best(a.column(id_col).chunk(0), matrix(a.column("v")), b.column(key_col).chunk(0), matrix(b.column("t")))

        found = dealt.groupBy("b", "s").cogroup(blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("b", "s")).applyInArrow(meet, schema)
    if k == 1:
        if n * dim <= MOST_NUMBERS:
            return found.withColumn("rank", F.lit(1))
        return found.groupBy(id_col).agg(F.min(F.struct("distance", key_col)).alias("m")).select(id_col, f"m.{key_col}", "m.distance", F.lit(1).alias("rank"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("distance", key_col))).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, targets: DataFrame, *, id_col: str, vec_col: str, key_col: str, target_col: str) -> DataFrame:
    """(id, key, distance): the cosine-nearest target of each row; of equal distances the smallest key."""
    return nearest_k(rows, targets, 1, id_col=id_col, vec_col=vec_col, key_col=key_col, target_col=target_col).drop("rank")


def _in_blocks(t: pa.Table, i: int, j: int, fn: Callable) -> pa.Table:
    t = t.sort_by("id")
    ids, v, p = t.column("id").to_numpy(), matrix(t.column("v")), t.column("p").to_numpy()
    return fn(ids[p == i], v[p == i], ids[p == j], v[p == j], i == j)


#: Pairs of blocks of one task at most.
MOST_PAIRS = 32


@dataclass(frozen=True)
class Stored:
    """Blocks of rows (id, v), each a file of the shared folder in the order of ids. A task reads the blocks that it compares, so no row is sent more than once whatever the number of blocks."""

    spark: SparkSession
    folder: str
    names: list[str | None]

    def tasks(self, jobs: list[tuple[int, np.ndarray]], schema: str, fn: Callable[[Callable, int, np.ndarray], Iterable[pa.Table]]) -> DataFrame:
        """fn(read, i, js) of each of jobs (i, js), in a task of its own; read gives a block's ids and vectors."""
        if not jobs:
            return self.spark.createDataFrame([], schema)
        sent, names, folder = self.spark.sparkContext.broadcast(jobs), self.spark.sparkContext.broadcast(self.names), self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, at = file_system(folder)

            def read(p: int) -> tuple[np.ndarray, np.ndarray]:
                with system.open_input_file(f"{at}/{names.value[p]}") as f:
                    t = pa.ipc.open_file(f).read_all()
                return t.column("id").to_numpy(), matrix(t.column("v"))

            for b in batches:
                for k in b.column(0).to_pylist():
                    for t in fn(read, *sent.value[k]):
                        yield from t.to_batches(max_chunksize=1 << 16)

        return self.spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, schema)

    def jobs(self, near: np.ndarray, most: int = MOST_PAIRS) -> list[tuple[int, np.ndarray]]:
        """The pairs i <= j of blocks that are near and have rows, some of one i together."""
        full = np.array([n is not None for n in self.names])
        near = np.triu(near) & full[:, None] & full[None, :]
        each = int(min(most, max(1, near.sum() // 512)))
        return [(i, js[k : k + each]) for i in range(len(near)) for js in [np.flatnonzero(near[i])] for k in range(0, len(js), each)]

    def products(self, near: np.ndarray, schema: str, fn: Callable) -> DataFrame:
        """fn(ids a, vectors a, ids b, vectors b, whether both are one block) of the pairs of blocks that are near: a table, or several."""

        def each(read: Callable, i: int, js: np.ndarray) -> Iterator[pa.Table]:
            first = read(i)
            for j in js:
                found = fn(*first, *(first if j == i else read(j)), bool(j == i))
                yield from [found] if isinstance(found, pa.Table) else found

        return self.tasks(self.jobs(near), schema, each)

    def drop(self) -> None:
        system, at = file_system(self.folder)
        system.delete_dir(at)


def stored(rows: DataFrame, parts: int) -> Stored:
    """Write rows (id, v, p) as blocks p = 0, 1, ...; a file has a name of its own, and counts if its task ended well."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/kinweave-blocks-{uuid.uuid4().hex}"

    def keep(key: tuple, t: pa.Table) -> pa.Table:
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        t, name = t.select(["id", "v"]).sort_by("id").combine_chunks(), f"{key[0].as_py()}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{at}/{name}") as out, pa.ipc.new_file(out, t.schema) as file:
            file.write_table(t)
        return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "name": [name]})

    names: list[str | None] = [None] * parts
    for r in rows.groupBy("p").applyInArrow(keep, "p int, name string").collect():
        names[r["p"]] = r["name"]
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)  # of no rows
    return Stored(spark, folder, names)


#: Cells of a metric partition at most; the table of their distances is made on the driver (8 MB).
MOST_CELLS = 1024
#: Rows from which each pivot is chosen.
SAMPLE = 8


@dataclass(frozen=True)
class Blocks:
    """Rows (id, v, p) dealt into blocks by the nearest of some pivots, with what is known of the distances between blocks: no row of block i is nearer to one of block j than apart[i, j], and a row is no nearer to one of
    block j than to its pivot at[j] less reach[j]."""

    rows: DataFrame
    apart: np.ndarray
    at: np.ndarray
    reach: np.ndarray

    @cached_property
    def stored(self) -> Stored:
        return stored(self.rows, len(self.apart))

    def near(self, most: np.ndarray | float) -> np.ndarray:
        """The pairs of blocks that may hold rows within most (of both blocks; a distance of the metric by which they were dealt)."""
        return ~(self.apart > most)

    def pairs(self, near: np.ndarray, schema: str, fn: Callable) -> DataFrame:
        """fn as for pair_blocks for the pairs of blocks that are near."""
        return self.stored.products(near, schema, fn)


def euclidean(most: np.ndarray | float, metric: str) -> np.ndarray | float:
    """What a distance is at most between vectors (of length one, for cosine) as a euclidean one. A vector of zeros has cosine distance 1 to all and is nearer than that tells, never farther."""
    return np.sqrt(2 * np.maximum(most, 0)) if metric == "cosine" else most


def metric_blocks(rows: DataFrame, id_col: str, vec_col: str, metric: str = "euclidean", *, block: int = BLOCK, extra: int = 0) -> Blocks:
    """Deal rows into blocks of at most about `block` rows. Pivots are chosen farthest first from the rows of the smallest hashes; each row goes to its nearest one, and a cell that is too large is split by hash. By the triangle
    inequality two blocks are apart by the distance of their pivots less the largest distances of their rows from them. extra: so many numbers at the end of a vector are no part of it."""
    own = cut(rows.select(F.col(id_col).alias("id"), double(F.col(vec_col)).alias("v")).filter("v IS NOT NULL"))
    cells = max(1, min(MOST_CELLS, math.ceil(own.count() / block)))
    place = lambda m: units(m[:, : m.shape[1] - extra]) if metric == "cosine" else m[:, : m.shape[1] - extra]
    sample = place(matrix(own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * cells if cells > 1 else 1).select("v").toArrow().column("v")))
    pivots = sample[:1]
    if len(sample):
        least = distances(sample, pivots, "euclidean")[:, 0]
        for _ in range(cells - 1):
            pivots = np.vstack((pivots, sample[least.argmax()]))
            least = np.minimum(least, distances(sample, pivots[-1:], "euclidean")[:, 0])
    else:
        return Blocks(own.withColumn("p", F.lit(0)), np.zeros((1, 1)), np.zeros((1, 0)), np.zeros(1))
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    kind = own.schema["id"].dataType.simpleString()

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        m, cell, far = place(matrix(b.column(1))), [], []
        step = max(1, ROOM // len(sent.value))
        for a in range(0, len(m), step):
            d = distances(m[a : a + step], sent.value, "euclidean")
            cell.append(d.argmin(1))
            far.append(d[np.arange(len(d)), cell[-1]])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(far))], ["id", "v", "cell", "far"])

    dealt = cut(map_arrow(own, f"id {kind}, v array<double>, cell int, far double", deal))
    seen = {r["cell"]: (r["n"], r["far"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    number, first, home, radius = 0, [], [], []
    for c in range(len(pivots)):
        n, far = seen.get(c, (0, 0.0))
        parts = max(1, math.ceil(n / block))
        first.append((c, number, parts))
        home += [c] * parts
        radius += [far] * parts
        number += parts
    table = rows.sparkSession.createDataFrame(first, "cell int, first int, parts int")
    named = dealt.join(F.broadcast(table), "cell").select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("p"))
    at, r = pivots[home], np.array(radius)
    between, slack = distances(at, at, "euclidean"), 1e-6 * (1 + np.abs(pivots).max())
    return Blocks(named, between - r[:, None] - r[None, :] - slack, at, r + slack)


def pair_blocks(rows: DataFrame, id_col: str, vec_col: str, schema: str, fn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], pa.Table], block: int = BLOCK, *, within: float | None = None, metric: str = "euclidean", extra: int = 0, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """fn(ids a, vectors a, ids b, vectors b, whether both are one block) for every pair of blocks of at most about `block` rows, each in the order of ids. rows are computed once and written once as blocks, which the
    tasks read (see Stored); what leaves a task is fn's result. within: only pairs of rows that near matter, and pairs of blocks that can't have any are skipped (see metric_blocks). then: what is made of the result at once; the blocks are dropped after it."""
    if within is not None:
        blocks = metric_blocks(rows, id_col, vec_col, metric, block=block, extra=extra)
        kept, near = blocks.stored, blocks.near(euclidean(within, metric))
    else:
        kept = all_blocks(rows, id_col, vec_col, block)
        near = np.ones((len(kept.names),) * 2, bool)
    found = kept.products(near, schema, fn)
    if then:
        found = cut(then(found))
        kept.drop()
    return found


def all_blocks(rows: DataFrame, id_col: str, vec_col: str, block: int = BLOCK) -> Stored:
    """rows as blocks of successive ids."""
    own = cut(rows.select(F.col(id_col).alias("id"), double(F.col(vec_col)).alias("v")).filter("v IS NOT NULL"))
    parts = max(1, math.ceil(own.count() / block))
    dealt = own.withColumn("p", F.lit(0)) if parts == 1 else numbered(own, "id", "nth").select("id", "v", F.expr(f"CAST(nth DIV {block} AS INT)").alias("p"))
    return stored(dealt, parts)


def group_blocks(rows: DataFrame, group_col: str, id_col: str, vec_col: str, schema: str, fn: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], pa.Table], block: int = BLOCK) -> DataFrame:
    """As pair_blocks within each group (a whole number), which fn gets first: a group of any size is dealt over as many tasks as it has pairs of blocks."""
    own = cut(rows.select(F.col(group_col).cast("bigint").alias("g"), F.col(id_col).alias("id"), double(F.col(vec_col)).alias("v")).filter("g IS NOT NULL AND v IS NOT NULL"))
    sizes = own.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = own.join(sizes, "g").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "id", "v", "p", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"))
    return dealt.groupBy("g", "i", "j").applyInArrow(lambda key, t: _in_blocks(t, key[1].as_py(), key[2].as_py(), lambda *x: fn(key[0].as_py(), *x)), schema)


def pairwise(rows: DataFrame, *, id_col: str = "id", vec_col: str = "emb", metric: str = "cosine", at_most: float | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, distance) of all pairs a < b, or those within at_most: then blocks that are farther apart aren't compared."""

    def fn(ia, va, ib, vb, same):
        step = max(1, (ROOM >> 4) // max(1, len(ib)))
        for k in range(0, len(ia), step):
            d = distances(va[k : k + step], vb, metric)
            keep = np.arange(k, k + len(d))[:, None] < np.arange(len(ib)) if same else np.ones(d.shape, bool)
            if at_most is not None:
                keep &= d <= at_most
            x, y = np.nonzero(keep)
            i, j = ia[x + k], ib[y]
            yield pa.table({"a": pa.array(np.minimum(i, j)), "b": pa.array(np.maximum(i, j)), "distance": pa.array(d[x, y])})

    return pair_blocks(rows, id_col, vec_col, "a bigint, b bigint, distance double", fn, block, within=at_most, metric=metric)


def eps_neighbors(rows: DataFrame, eps: float, *, id_col: str = "id", vec_col: str = "emb", metric: str = "euclidean") -> DataFrame:
    """(a, b, distance) for pairs a < b within eps."""
    return pairwise(rows, id_col=id_col, vec_col=vec_col, metric=metric, at_most=eps)


def knn(rows: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "emb", metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(id, neighbor, distance, rank) of the k nearest others; ties by the smaller neighbour. Every pair of blocks sends at most k candidates per row, however many are equally near. Each row's k-th
    neighbour within its own block bounds how far its neighbours can be; blocks that are farther apart than all their rows' bounds aren't compared."""
    schema = "id bigint, neighbor bigint, distance double"

    def fn(ia, va, ib, vb, same):
        d = distances(va, vb, metric)
        if same:
            np.fill_diagonal(d, np.inf)
        out = []
        for ids, others, m in ((ia, ib, d),) if same else ((ia, ib, d), (ib, ia, d.T)):
            if m.size:
                x, y = least_k(m, k)
                out.append(pa.table({"id": pa.array(ids[x]), "neighbor": pa.array(others[y]), "distance": pa.array(m[x, y])}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "neighbor": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

    blocks = metric_blocks(rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")), "id", "v", metric, block=block)
    n = len(blocks.apart)
    if n == 1:
        found = blocks.pairs(np.ones((1, 1), bool), schema, fn)
    else:
        own = cut(blocks.pairs(np.eye(n, dtype=bool), schema, fn))
        kth = own.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
        bounds = blocks.rows.select("id", "p").join(kth, "id", "left").groupBy("p").agg(F.max(F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf")))).alias("d"))
        most = np.full(n, -1.0)  # a block without rows has no bound
        for r in bounds.collect():
            most[r["p"]] = r["d"]
        near = blocks.near(euclidean(np.maximum(most[:, None], most[None, :]), metric)) & (most >= 0)[:, None] & (most >= 0)[None, :]
        np.fill_diagonal(near, False)
        found = own.unionByName(blocks.pairs(near, schema, fn))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def closest_pair(centroids: DataFrame, *, key_col: str = "label", vec_col: str = "centroid") -> DataFrame:
    """(l1, l2, distance) of the closest two rows; ties by the smallest keys. Each pair of blocks sends one row."""

    def fn(ia, va, ib, vb, same):
        d = distances(va, vb, "cosine")
        x, y = np.nonzero(np.triu(np.ones(d.shape, bool), 1) if same else np.ones(d.shape, bool))
        lo, hi, v = np.minimum(ia[x], ib[y]), np.maximum(ia[x], ib[y]), d[x, y]
        first = np.lexsort((hi, lo, v))[:1]
        return pa.table({"l1": pa.array(lo[first]), "l2": pa.array(hi[first]), "distance": pa.array(v[first])})

    return pair_blocks(centroids.select(F.col(key_col).cast("bigint").alias("k"), F.col(vec_col).alias("c")), "k", "c", "l1 bigint, l2 bigint, distance double", fn).orderBy("distance", "l1", "l2").limit(1)


def top_clusters(rows: DataFrame, centroids: DataFrame, k: int = 3, *, id_col: str = "id", vec_col: str = "emb", key_col: str = "label") -> DataFrame:
    """(id, key, distance, rank) of the k nearest centroids of each row."""
    targets = centroids.select(F.col(key_col).alias("key"), F.col("centroid").alias("c"))
    return nearest_k(rows, targets, k, id_col=id_col, vec_col=vec_col, key_col="key", target_col="c")
