"""Hard negatives: for anchors and their best positives, rows of other labels whose inner product with the anchor lies in a window below the positive's.

Vectors are whole numbers and scores their exact inner products. Candidates are dealt out evenly; a task builds a cover tree over each chunk of its rows after augmenting them by the norm: a candidate x
becomes (x, sqrt(M * M - |x| * |x|)) with M the largest norm of the chunk, a query q becomes (q, 0). All candidates then have one length, so the nearest are those of the largest inner product,
and a node with centre c whose rows lie within radius r of it holds only inner products from q.c - |q| r to q.c + |q| r. Covering radii halve from level to level. The descent for a query's window takes
nodes best first (by the largest score that they can hold inside the window), skips those that lie outside the window or can't reach the k-th score found so far, and verifies the rows of leaves by
their exact scores. A task goes on with what it has found from chunk to chunk and returns at most k rows for each window; the best k of all tasks are the result. No pair leaves a task otherwise.

The queries (anchors, of which there are a stated share) are broadcast up to MOST_NUMBERS numbers; more are dealt in blocks that meet every part of the rows.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part, nor do rows with a component of 2**31 / scale or more, whose scores don't fit a long. Shorter vectors
are filled with zeros. Rows are told apart by id: a row is no positive of an anchor of the same id, repeated rows count each, a repeated anchor is answered as often as it occurs. A null id comes last
among equal scores and is returned as null. Ties go to the smaller id. No anchors, no positives or no negatives in the window give no rows. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import bounded, cut, forget, release

#: Rows of a chunk, which one tree holds, and of a task's part.
CHUNK, PART = 4096, 8192
#: Rows under which a node isn't split.
LEAF = 24
#: Numbers of queries (vectors and found rows) that are sent to every task.
MOST_NUMBERS = 4_000_000
#: Queries whose products with a node's rows are computed at once.
BATCH = 128
_LAST = (1 << 63) - 1
_FOUND = "q bigint, w bigint, id bigint, score bigint"


class Node:
    """Its children are rows by themselves (the first `singles` of points) and nodes (their centres follow)."""

    __slots__ = ("kids", "points", "products", "radii", "rows", "singles")

    def __init__(self, rows: np.ndarray, singles: int, radii: np.ndarray, kids: list[Node]):
        self.rows, self.singles, self.radii, self.kids = rows, singles, radii, kids
        self.points = self.products = None


def augmented(v: np.ndarray) -> np.ndarray:
    squares = (v * v).sum(1)
    return np.hstack((v, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))[:, None]))


def cover_tree(v: np.ndarray) -> Node | None:
    """The tree over rows v. Each level's centres are more than its radius apart within a node and cover the node's rows within it; a node's own centre stays a centre below it."""
    if not len(v):
        return None
    points = augmented(v.astype(np.float64))
    lengths = (points * points).sum(1)

    def apart(centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(lengths[rows] + lengths[centre] - 2 * (points[rows] @ points[centre]), 0))

    everything = np.arange(len(v))
    root = Node(everything[:1], 0, apart(0, everything).max(keepdims=True), [])
    todo = [(root, 0, everything, float(root.radii[0]))]
    root.kids = [None]
    while todo:
        above, place, rows, level = todo.pop()
        if len(rows) <= LEAF or level < 1e-6:
            above.kids[place] = Node(rows, len(rows), np.zeros(0), [])
            continue
        level /= 2
        centre, groups, rest = int(rows[0]), [], rows
        while len(rest):
            d = apart(centre, rest)
            near = d <= level
            near[rest == centre] = True
            groups.append((centre, rest[near], float(d[near].max())))
            rest = rest[~near]
            centre = int(rest[0]) if len(rest) else -1
        alone = [g[0] for g in groups if len(g[1]) == 1]
        wide = [g for g in groups if len(g[1]) > 1]
        node = above.kids[place] = Node(np.array(alone + [g[0] for g in wide]), len(alone), np.array([g[2] for g in wide]), [None] * len(wide))
        # the covering radius of a level bounds the next one; rows that are all at one place end there
        todo += [(node, i, np.concatenate(([g[0]], g[1][g[1] != g[0]])), min(level, 2 * g[2])) for i, g in enumerate(wide)]
    return root


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as longs: by BLAS where doubles are exact, else in whole numbers."""
    most = math.sqrt(float((a.astype(np.float64) ** 2).sum(1).max(initial=0)) * float((b.astype(np.float64) ** 2).sum(1).max(initial=0)))
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Searched:
    """What has been found so far for windows. Queries are (id, label, vector); windows (query, low, high, number)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.v, self.k, self.same = ids, labels, v, k, same
        self.low, self.high = low.tolist(), high.tolist()
        self.windows = [[] for _ in ids]
        for w, q in enumerate(of.tolist()):
            self.windows[q].append(w)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in of]
        self.kth = [-(1 << 63)] * len(of)
        self.looked, self.skipped = 0, 0

    def _take(self, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.found[w][0], scores)), np.concatenate((self.found[w][1], ids))
        if len(s) > self.k:
            keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[keep], i[keep]
            order = np.lexsort((i, -s))[: self.k]
            s, i = s[order], i[order]
            self.kth[w] = int(s[-1])
        elif len(s) == self.k:
            self.kth[w] = int(s.min())
        self.found[w] = s, i

    def chunk(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        """Search a chunk of rows."""
        wide = max(v.shape[1], self.v.shape[1])
        v, q = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (v, self.v))
        root = cover_tree(v)
        if root is None:
            return
        norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        for a in range(0, len(q), BATCH):
            touched: list[Node] = []

            def products(node: Node, batch: np.ndarray = q[a : a + BATCH], touched: list[Node] = touched) -> np.ndarray:
                if node.products is None:
                    node.products = _exact(batch, v[node.rows])
                    touched.append(node)
                return node.products

            for at in range(a, min(a + BATCH, len(q))):
                for w in self.windows[at]:
                    self._descend(w, at, at - a, root, products, norms[at], ids, labels)
            for node in touched:
                node.products = None

    def _descend(self, w: int, q: int, line: int, root: Node, products, norm: float, ids: np.ndarray, labels: np.ndarray) -> None:
        low, high = self.low[w], self.high[w]
        heap: list[tuple[float, int, Node]] = [(-math.inf, 0, root)]
        n = 1
        while heap:
            bound, _, node = heapq.heappop(heap)
            if -bound < self.kth[w]:
                break
            s = products(node)[line]
            if node.singles:
                own, rows = s[: node.singles], node.rows[: node.singles]
                self.looked += node.singles
                fit = (own >= max(low, self.kth[w])) & (own <= high)
                mine = labels[rows] == self.labels[q]
                fit &= mine & (ids[rows] != self.ids[q]) if self.same else ~mine
                if fit.any():
                    self._take(w, own[fit], ids[rows[fit]])
            if len(node.radii):
                reach = norm * node.radii * (1 + 1e-9) + 1e-6 * (1 + norm)
                top = np.minimum(s[node.singles :] + reach, high)
                inside = (s[node.singles :] + reach >= max(low, self.kth[w])) & (s[node.singles :] - reach <= high)
                self.skipped += int((~inside).sum())
                for i in np.flatnonzero(inside).tolist():
                    heapq.heappush(heap, (-float(top[i]), n, node.kids[i]))
                    n += 1

    def rows(self, queries: np.ndarray, windows: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        """What was found; queries and windows: their numbers in the result."""
        n = np.array([len(s) for s, _ in self.found], np.int64)
        flat = [np.concatenate([f[k] for f in self.found] or [np.zeros(0, np.int64)]) for k in (1, 0)]
        return pa.RecordBatch.from_arrays([pa.array(queries[of].repeat(n)), pa.array(windows.repeat(n)), *(pa.array(x, pa.int64()) for x in flat)], ["q", "w", "id", "score"])


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, longest length) whole numbers; shorter rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat, dim = column.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Queries:
    """Windows of queries as arrays, from a table (q, qid, qlabel, qv, w, low, high) with a row for each window."""

    def __init__(self, t: pa.Table, k: int, same: bool):
        t = t.sort_by([("q", "ascending"), ("w", "ascending")])
        q = t.column("q").to_numpy()
        self.q, first, self.of = np.unique(q, return_index=True, return_inverse=True)
        one = t.take(pa.array(first))
        self.ids, self.labels, self.v = one.column("qid").to_numpy(), one.column("qlabel").to_numpy(), _numbers(one.column("qv"))
        self.w, self.low, self.high, self.k, self.same = *(t.column(c).to_numpy() for c in ("w", "low", "high")), k, same

    def begin(self) -> Searched:
        return Searched(self.ids, self.labels, self.v, self.of, self.low, self.high, self.k, self.same)


def search(rows: DataFrame, windows: DataFrame, k: int, same: bool, *, most_numbers: int = MOST_NUMBERS, part: int = PART) -> DataFrame:
    """(q, w, id, score, rank): of each window the k rows (id, label, v) of the highest scores from low to high, with the query's label (and another id) or with other labels. windows: (q, qid, qlabel,
    qv, w, low, high)."""
    spark = rows.sparkSession
    bounded(spark)
    windows, n = cut(windows), max(1, math.ceil(rows.count() / part))
    size = windows.agg(F.count("*").alias("n"), F.max(F.size("qv")).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], _FOUND + ", rank int")
    numbers = size["n"] * ((size["d"] or 0) + 4 * k)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for b in batches:
            for a in range(0, b.num_rows, CHUNK):
                some = b.slice(a, CHUNK)
                if n and n + some.num_rows > CHUNK:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                held.append(some)
                n += some.num_rows
        if n:
            yield pa.Table.from_batches(held)

    def over(queries: Queries, tables: Iterator[pa.Table]) -> pa.RecordBatch:
        found = queries.begin()
        for t in tables:
            found.chunk(t.column("id").to_numpy(), t.column("label").to_numpy(), _numbers(t.column("v")))
        return found.rows(queries.q, queries.w, queries.of)

    if numbers <= most_numbers:
        sent = spark.sparkContext.broadcast(Queries(windows.toArrow(), k, same))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            yield over(sent.value, chunks(batches))
            release()

        found = rows.repartition(n).mapInArrow(run, _FOUND)
    else:
        blocks = math.ceil(numbers / most_numbers)
        deal = lambda df, key, name, own, other, parts: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(name)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        left, right = deal(rows, "id", n, "p", "b", blocks), deal(windows, "q", blocks, "b", "p", n)

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("q", "w", "id", "score")})
            return pa.Table.from_batches([over(Queries(b, k, same), chunks(iter(a.combine_chunks().to_batches())))])

        found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(meet, _FOUND)
    rank = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def prepared(rows: DataFrame, id_col: str, label: Column, vec_col: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(2**31) / scale))
    own = label.cast("bigint") if isinstance(rows.select(label).schema[0].dataType, T.IntegralType) else F.xxhash64(label)
    return rows.filter(label.isNotNull() & F.col(vec_col).isNotNull() & fine).select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("id"), own.alias("label"), whole.alias("v"))


def mine(rows: DataFrame, anchor: Column, *, id_col: str = "id", label: Column | None = None, vec_col: str = "emb", scale: int = 256, positives: int = 5, negatives: int = 10, least: tuple[int, int] = (30, 100), most: tuple[int, int] = (90, 100), most_numbers: int = MOST_NUMBERS, part: int = PART) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which anchor (a condition on "id") holds and each of its first `positives` rows of the same label,
    the first `negatives` rows of other labels with least <= negative_score / positive_score <= most (fractions, taken exactly in whole numbers)."""
    own = cut(prepared(rows, id_col, F.col("label") if label is None else label, vec_col, scale))
    anchors = cut(own.filter(anchor & (F.col("id") != _LAST)).select(F.col("id").alias("qid"), F.col("label").alias("qlabel"), F.col("v").alias("qv"), F.monotonically_increasing_id().alias("q")))
    everything = anchors.select("q", "qid", "qlabel", "qv", F.lit(0).cast("bigint").alias("w"), F.lit(-_LAST).alias("low"), F.lit(_LAST).alias("high"))
    found = cut(search(own, everything, positives, True, most_numbers=most_numbers, part=part).select("q", F.col("id").alias("positive"), F.col("score").alias("w"), F.col("rank").alias("nth")))
    # whole numbers: the least score not below, and the largest not above, the fractions of the positive's
    low = F.expr(f"{least[0]} * w DIV {least[1]} + IF({least[0]} * w DIV {least[1]} * {least[1]} < {least[0]} * w, 1, 0)")  # DIV cuts toward 0
    high = F.expr(f"{most[0]} * w DIV {most[1]} - IF({most[0]} * w DIV {most[1]} * {most[1]} > {most[0]} * w, 1, 0)")
    windows = found.select("q", "w").distinct().join(anchors, "q").select("q", "qid", "qlabel", "qv", "w", low.alias("low"), high.alias("high")).filter("low <= high")
    got = search(own, windows, negatives, False, most_numbers=most_numbers, part=part).select("q", "w", F.col("id").alias("negative"), F.col("score").alias("negative_score"), "rank")
    named = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    pairs = found.join(anchors.select("q", "qid"), "q")
    return pairs.join(got, ["q", "w"]).select(F.col("qid").alias("anchor_id"), named("positive").alias("positive_id"), "rank", named("negative").alias("negative_id"), F.col("w").alias("positive_score"), "negative_score")
