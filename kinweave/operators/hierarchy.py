"""Hierarchical density clustering whose tree, hierarchy and condensed tree are tables.

1. Rows get places 0, 1, ... in the order of their ids, so identifiers of any size are exact everywhere.
2. A minimum spanning tree of mutual reachability: in rounds of block joins every component sends its lightest edge (of equal weights the one of the smaller places).
3. The single-linkage hierarchy: edges are ranked by weight and cut into bands. Level by level half of the bands' lighter edges are contracted (connected components) and the heavier ones renamed, for all
   halves at once; then each band is merged in a task of its own, whatever shape the tree has, and what a merge joins from earlier bands is looked up by the component's smallest place.
4. The condensed tree: merges of both sides large enough split a cluster, any other one drops rows from it. Rows find their merge, and merges their cluster, by doubling jumps along parents.
5. Selection by excess of mass: a cluster is worth the larger of its stability and what the clusters below are worth together. Chains of such functions compose (max(a, b + x) stays of that form), so the
   tree is contracted in about log rounds, however deep it is.

Up to one_task rows all of this is done in one task by the same rules. The root is never a cluster; clusters are numbered by their smallest id. A row's probability is its density over the largest one at
which the selected cluster itself loses rows or splits, 1 at most; rows of infinite density (copies) have 1.

Defined results: rows with a null or non-finite vector (or a null in it) are noise with probability 0 and take no part. Fewer than two rows that take part are noise. Repeated ids are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.vectors import double, matrix
from kinweave.operators.graph import components, cut, numbered
from kinweave.operators.similarity import ROOM, Blocks, all_blocks, distances, least_k, metric_blocks

#: Edges of a band, which is merged in one task.
BAND = 1 << 19
#: Nearest rows of each row, beyond those of its core distance, along which components grow before all pairs are passed; rows of a block of that pass; edges that a task holds before it drops those that no tree needs.
NEAREST, SIDE, HELD = 8, 1024, 1 << 18
#: A cluster is kept if its stability is the sum of those below it but for rounding.
SLACK = 1e-9
_MOST = 1e300
_EDGES = "a bigint, b bigint, d double"


def usable(v: Column) -> Column:
    """Whether a vector has finite numbers only."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def placed(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, pos) of the rows that take part."""
    own = rows.select(F.col(id_col).alias("id"), double(F.col(vec_col)).alias("v")).filter(usable(F.col("v")))
    return cut(numbered(own, "id", "pos"))


def core_distances(points: DataFrame, samples: Sequence[int]) -> DataFrame:
    """points (pos, v) with c1, c2, ...: for each of samples the distance to the so-manieth nearest row, the row itself being the first; 0 if there are fewer. One pass for all of them."""
    k = max(samples) - 1
    if k < 1:
        return points.withColumns({f"c{s}": F.lit(0.0) for s in samples})

    blocks = metric_blocks(points.select("pos", "v"), "pos", "v", block=SIDE)
    cores = cut(nearest_rows(blocks, k).select("pos", *[F.get("far", F.lit(s - 2)).alias(f"c{s}") if s > 1 else F.lit(0.0).alias(f"c{s}") for s in samples]))
    blocks.stored.drop()
    return points.join(cores, "pos", "left").fillna(0.0, [f"c{s}" for s in samples])


def _reach(va: np.ndarray, ca: np.ndarray, vb: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Mutual reachability, to nine digits after the point, so that both ways to build a tree see the same ties."""
    return np.round(np.maximum(np.maximum(distances(va, vb, "euclidean"), ca[:, None]), cb[None, :]), 9)


def prim(v: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of the least edges by (weight, smaller place, larger place). No two edges are equal in this order, so there is one such tree."""
    n = len(v)
    best, low, high, out = np.full(n, np.inf), np.full(n, n), np.full(n, n), np.ones(n, bool)
    a, b, w = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1)
    at, places = 0, np.arange(n)
    for k in range(n - 1):
        out[at] = False
        d = _reach(v[at : at + 1], core[at : at + 1], v, core)[0]
        lo, hi = np.minimum(places, at), np.maximum(places, at)
        closer = out & ((d < best) | ((d == best) & ((lo < low) | ((lo == low) & (hi < high)))))
        best[closer], low[closer], high[closer] = d[closer], lo[closer], hi[closer]
        left = np.flatnonzero(out)
        least = left[best[left] == best[left].min()]
        at = int(least[np.lexsort((high[least], low[least]))[0]])
        a[k], b[k], w[k] = low[at], high[at], best[at]
    return a, b, w


def nearest_rows(blocks: Blocks, k: int) -> DataFrame:
    """(pos, near, far) of rows (id: their place) dealt into blocks: the k nearest others by (distance, place) and their distances. A task keeps k for each row of its block, goes through the other blocks from the
    nearest, and leaves out the rows whose k-th neighbour is nearer than the block."""
    at, reach = blocks.at, blocks.reach

    def fn(read, i, js):
        ids, v = read(i)
        low = distances(v, at, "euclidean") - reach
        low[:, i] = -np.inf
        best, other = np.full((len(v), k), np.inf), np.full((len(v), k), np.iinfo(np.int64).max)
        for j in js[np.argsort(low[:, js].min(0), kind="stable")]:
            rows = np.flatnonzero(low[:, j] <= best[:, -1])
            if not len(rows):
                continue
            theirs, w = (ids, v) if j == i else read(j)
            step = max(1, (ROOM >> 3) // len(w))
            for s in range(0, len(rows), step):
                r = rows[s : s + step]
                d = distances(v[r], w, "euclidean")
                if j == i:
                    d[np.arange(len(r)), r] = np.inf
                kth = best[r, -1]
                if np.isinf(kth).any():
                    x, y = least_k(d, k)  # of equal ones the first, which have the smaller places
                else:
                    x, y = np.nonzero(d < kth[:, None])
                    zero = np.flatnonzero(kth == 0)  # copies beyond k
                    if len(zero):
                        p, q = np.nonzero((d[zero] == 0) & (theirs[None, :] < other[r[zero], -1][:, None]))
                        x, y = np.concatenate((x, zero[p])), np.concatenate((y, q))
                if not len(x):
                    continue
                mine = np.unique(x)
                row = np.concatenate((np.repeat(mine, k), x))
                far, near = np.concatenate((best[r[mine]].ravel(), d[x, y])), np.concatenate((other[r[mine]].ravel(), theirs[y]))
                order = np.lexsort((near, far, row))
                first = np.searchsorted(row[order], mine)
                kept = order[(first[:, None] + np.arange(k)).ravel()]
                best[r[mine]], other[r[mine]] = far[kept].reshape(-1, k), near[kept].reshape(-1, k)
        known = np.isfinite(best)
        starts = pa.array(np.concatenate(([0], np.cumsum(known.sum(1)))).astype(np.int32))
        yield pa.table({"pos": pa.array(ids, pa.int64()), "near": pa.ListArray.from_arrays(starts, pa.array(other[known].astype(np.int32))), "far": pa.ListArray.from_arrays(starts, pa.array(best[known]))})

    kept = blocks.stored
    full = np.array([p for p, n in enumerate(kept.names) if n is not None], np.int64)
    return kept.tasks([(int(i), full) for i in full], "pos bigint, near array<int>, far array<double>", fn)


def _hooked(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label after each component x takes that of y; of two that take each other's the smaller one stays."""
    to = np.arange(len(label))
    to[x] = y
    two = (to[to] == np.arange(len(to))) & (np.arange(len(to)) < to)
    to[two] = np.flatnonzero(two)
    while (to[to] != to).any():
        to = to[to]
    return to[label]


def forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges between nodes a and b, under n, are the lightest forest by (w, low, high), and each node's component. floor: edges of a node that aren't given may weigh so much or more; then only edges stay
    which are known to be in every such tree, because all that leaves a component on one of their sides is heavier. Of weight 0 the edges of the smallest places must be given."""
    order = np.lexsort((high, low, w))
    a, b, w = a[order], b[order], w[order]
    label, out, alive = np.arange(n), [], np.arange(len(order))
    lone = np.ones(n, bool)
    while len(alive):
        x, y = label[a[alive]], label[b[alive]]
        alive = alive[x != y]
        x, y = label[a[alive]], label[b[alive]]
        best = np.full(n, -1)
        best[y[::-1]] = alive[::-1]
        back = np.full(n, -1)
        back[x[::-1]] = alive[::-1]
        best = np.where((best < 0) | ((back >= 0) & (back < best)), back, best)
        c = np.flatnonzero(best >= 0)
        if floor is not None:
            least = np.full(n, np.inf)
            np.minimum.at(least, label, floor)
            weight = w[best[c]]
            c = c[(weight < least[c]) | ((weight == 0) & lone[c])]
        if not len(c):
            break
        e = best[c]
        p, q = label[a[e]], label[b[e]]
        out.append(np.unique(e))
        label = _hooked(label, c, np.where(p == c, q, p))
        lone[:] = False
    chosen = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[chosen], label


def contracted(found: DataFrame, n: int, samples: Sequence[int], k: int) -> DataFrame:
    """(s, a, b, d) for each of samples, from nearest_rows: the edges of its tree that follow from the k nearest rows alone, and (s, place, component, null) of every row."""

    def whole(key, t):
        s = key[0].as_py()
        t = t.sort_by("pos")
        near, far = t.column("near").combine_chunks(), t.column("far").combine_chunks()
        size = np.diff(near.offsets.to_numpy())
        b, d, first = near.flatten().to_numpy(), far.flatten().to_numpy(), np.concatenate(([0], np.cumsum(size)))[:-1]
        a = np.repeat(np.arange(n, dtype=np.int32), size)
        core = np.zeros(n)
        if s > 1:
            some = size >= s - 1
            core[some] = d[first[some] + s - 2]
        w = np.round(np.maximum(np.maximum(d, core[a]), core[b]), 9)
        floor = np.full(n, np.inf)
        if n - 1 > k:
            floor = np.where(size < k, 0.0, np.round(np.maximum(d[np.minimum(first + k, len(d)) - 1], core), 9))
        low, high = np.minimum(a, b), np.maximum(a, b)
        chosen, label = forest(n, a, b, w, low, high, floor)
        pairs = pa.table({"a": pa.array(low[chosen].astype(np.int64)), "b": pa.array(high[chosen].astype(np.int64)), "d": pa.array(w[chosen])})
        homes = pa.table({"a": pa.array(np.arange(n)), "b": pa.array(label), "d": pa.nulls(n, pa.float64())})
        both = pa.concat_tables((pairs, homes))
        return both.add_column(0, "s", pa.array(np.full(both.num_rows, s, np.int32)))

    each = F.explode(F.array(*[F.lit(s) for s in samples])).alias("s")
    return found.select(each, "pos", "near", "far").groupBy("s").applyInArrow(whole, "s int, " + _EDGES)


def between(blocks: Blocks, trees: dict[int, tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """(s, t, a, b, d): of each tree s, whose rows have components and core distances by place (none: 0), edges among which are all that join the components in the tree. One pass over all pairs of blocks: a task t keeps
    the lightest forest of the lightest edges between every two components that it sees, and an edge that is in no such forest is in no tree."""
    spark = blocks.rows.sparkSession
    sent = spark.sparkContext.broadcast(trees)

    def lightest(s, ia, ib, sq, xa, xb):
        label, core = sent.value[s]
        la, lb = label[ia], label[ib]
        oa, ob = np.argsort(la, kind="stable"), np.argsort(lb, kind="stable")
        ca, sa = np.unique(la[oa], return_index=True)
        cb, sb = np.unique(lb[ob], return_index=True)
        if len(ca) == len(cb) == 1 and ca[0] == cb[0]:
            return None
        m = sq
        if len(ca) > 1:
            ia, la, xa, m = ia[oa], la[oa], xa[oa], m[oa]
        if len(cb) > 1:
            ib, lb, xb, m = ib[ob], lb[ob], xb[ob], m[:, ob]
        squares = m
        if core is not None:
            m = np.maximum(m, (core[ia] ** 2)[:, None])
            np.maximum(m, (core[ib] ** 2)[None, :], out=m)
        least = m.min().reshape(1, 1) if len(ca) == len(cb) == 1 else np.minimum.reduceat(np.minimum.reduceat(m, sa, axis=0), sb, axis=1)
        least = np.where(ca[:, None] == cb[None, :], -np.inf, (np.sqrt(np.maximum(least, 0)) + 2e-9) ** 2 + 1e-13 * (xa.max() + xb.max()))
        if least.size > 1:
            least = np.repeat(np.repeat(least, np.diff(np.append(sa, len(ia))), 0), np.diff(np.append(sb, len(ib))), 1)
        x, y = np.nonzero(m <= least)
        d = squares[x, y]
        d = np.sqrt(np.where(d < 1e-13 * (xa[x] + xb[y]), 0, d))
        if core is not None:
            d = np.maximum(np.maximum(d, core[ia[x]]), core[ib[y]])
        d, p, q = np.round(d, 9), la[x], lb[y]
        low, high = np.minimum(ia[x], ib[y]), np.maximum(ia[x], ib[y])
        order = np.lexsort((high, low, d, np.maximum(p, q), np.minimum(p, q)))
        p, q = np.minimum(p, q)[order], np.maximum(p, q)[order]
        first = order[np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])))] if len(order) else order
        return low[first], high[first], d[first]

    def kept(s, edges):
        """Of edges the lightest forest between components."""
        low, high, d = (np.concatenate(x) for x in zip(*edges, strict=True))
        label = sent.value[s][0]
        names, place = np.unique(np.concatenate((label[low], label[high])), return_inverse=True)
        chosen, _ = forest(len(names), place[: len(low)], place[len(low) :], d, low, high)
        return low[chosen], high[chosen], d[chosen]

    def fn(read, i, js):
        ia, va = read(i)
        xa = (va * va).sum(1)
        edges, held = {s: [] for s in sent.value}, dict.fromkeys(sent.value, 0)
        for j in js:
            ib, vb = (ia, va) if j == i else read(j)
            labels = [label for label, _ in sent.value.values()]
            if all((c := label[ia[0]]) == label[ib[0]] and (label[ia] == c).all() and (label[ib] == c).all() for label in labels):
                continue
            xb = xa if j == i else (vb * vb).sum(1)
            sq = (-2 * va) @ vb.T
            sq += xa[:, None]
            sq += xb
            for s, mine in edges.items():
                new = lightest(s, ia, ib, sq, xa, xb)
                if new is None or not len(new[0]):
                    continue
                mine.append(new)
                held[s] += len(new[0])
                if held[s] > HELD:
                    mine[:] = [kept(s, mine)]
                    held[s] = len(mine[0][0])
        for s, mine in edges.items():
            if mine:
                low, high, d = kept(s, mine)
                yield pa.table({"s": pa.array(np.full(len(d), s, np.int32)), "t": pa.array(np.full(len(d), i, np.int32)), "a": pa.array(low.astype(np.int64)), "b": pa.array(high.astype(np.int64)), "d": pa.array(d)})

    near = np.ones(blocks.apart.shape, bool)
    schema = "s int, t int, " + _EDGES
    found = cut(blocks.stored.tasks(blocks.stored.jobs(near), schema, fn))
    while found.count() > 4 * HELD and not found.groupBy("s").agg(F.countDistinct("t").alias("t")).filter("t > 1").isEmpty():  # of several tasks together

        def fewer(key, t):
            low, high, d = kept(key[0].as_py(), [tuple(t.column(c).to_numpy() for c in ("a", "b", "d"))])
            return pa.table({"s": pa.array(np.full(len(d), key[0].as_py(), np.int32)), "t": pa.array(np.full(len(d), key[1].as_py(), np.int32)), "a": pa.array(low), "b": pa.array(high), "d": pa.array(d)})

        found = cut(found.withColumn("t", F.expr("t DIV 16")).groupBy("s", "t").applyInArrow(fewer, schema))
    return found


def in_passes(points: DataFrame, n: int, sizes: Sequence[int], samples: Sequence[int], least: dict[int, int], schema: str) -> DataFrame:
    """What grid finds, of as many rows as one task holds edges and the driver holds component and core distance: two passes over pairs of blocks, for all of samples together, whatever the number of rounds. The first
    finds nearest rows, the second the edges that join what these leave apart. Each tree is merged and condensed in a task."""
    spark, k = points.sparkSession, max(samples) - 1 + NEAREST
    blocks = metric_blocks(points.select("pos", "v"), "pos", "v", block=SIDE)
    found = cut(nearest_rows(blocks, k))
    known = cut(contracted(found, n, samples, k))
    trees = {}
    for s in samples:
        label = known.filter((F.col("s") == s) & F.col("d").isNull()).select(F.col("a").cast("int"), F.col("b").cast("int")).toArrow()
        own = np.zeros(n, np.int32)
        own[label.column("a").to_numpy()] = label.column("b").to_numpy()
        core = None
        if s > 1:
            some = found.filter(F.size("far") >= s - 1).select(F.col("pos").cast("int").alias("a"), F.col("far")[s - 2].alias("d")).toArrow()
            core = np.zeros(n)
            core[some.column("a").to_numpy()] = some.column("d").to_numpy()
        if (own != own[0]).any():
            trees[s] = own, core
    edges = known.filter("d IS NOT NULL")
    if trees:
        edges = edges.unionByName(between(blocks, trees).drop("t"))
    blocks.stored.drop()

    def whole(key, t):
        s, out = key[0].as_py(), []
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "d"))
        chosen, _ = forest(n, a, b, w, a, b)
        tree = merged_tree(a[chosen], b[chosen], w[chosen])
        for size in sizes:
            label, share = condensed_task(*tree, least[size])
            rows = np.flatnonzero(label >= 0)
            out.append(pa.table({"min_samples": pa.array(np.full(len(rows), s, np.int32)), "min_cluster_size": pa.array(np.full(len(rows), size, np.int32)), "pos": pa.array(rows), "label": pa.array(label[rows].astype(np.int32)), "probability": pa.array(share[rows])}))
        return pa.concat_tables(out)

    return cut(edges.groupBy("s").applyInArrow(whole, schema))


def spanning_edges(points: DataFrame, core: str) -> DataFrame:
    """(a, b, d) of the same tree over points (pos, v, core column), in rounds; a task compares its block with all others and sends one edge for each component of it, and none if there is one component only."""
    state, found = cut(points.select("pos", "v", F.col(core).alias("core"), F.col("pos").alias("c"))), []

    def lightest(read, i, js):
        ia, va = read(i)
        comp, w, other = va[:, -1], np.full(len(ia), np.inf), np.zeros(len(ia), np.int64)
        for j in js:  # in the order of places, so the first of equal ones makes the least edge
            ib, vb = read(j)
            if comp.min() == comp.max() == vb[:, -1].min() == vb[:, -1].max():
                continue
            d = _reach(va[:, :-2], va[:, -2], vb[:, :-2], vb[:, -2])
            d[comp[:, None] == vb[:, -1][None, :]] = np.inf
            k = d.argmin(1)
            least = d[np.arange(len(k)), k]
            closer = least < w
            w[closer], other[closer] = least[closer], ib[k[closer]]
        low, high = np.minimum(ia, other), np.maximum(ia, other)
        order = np.lexsort((high, low, w, comp))
        first = order[np.concatenate(([True], comp[order][1:] != comp[order][:-1]))]
        first = first[np.isfinite(w[first])]
        yield pa.table({"c": pa.array(comp[first].astype(np.int64)), "a": pa.array(low[first]), "b": pa.array(high[first]), "d": pa.array(w[first])})

    while True:
        packed = state.select("pos", F.concat("v", F.array("core", F.col("c").cast("double"))).alias("v"))  # places are exact as doubles
        kept = all_blocks(packed, "pos", "v", SIDE)
        full = np.arange(len(kept.names))
        sent = kept.tasks([(int(i), full) for i in full], "c bigint, " + _EDGES, lightest)
        chosen = cut(sent.groupBy("c").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.*").distinct())
        kept.drop()
        if chosen.isEmpty():
            break
        found.append(chosen.select("a", "b", "d"))
        home = state.select(F.col("pos").alias("x"), "c")
        links = chosen.join(home.withColumnsRenamed({"x": "a", "c": "ca"}), "a").join(home.withColumnsRenamed({"x": "b", "c": "cb"}), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(state.select(F.col("c").alias("id")).distinct(), links)
        state = cut(state.join(merged.withColumnsRenamed({"id": "c", "component": "n"}), "c").select("pos", "v", "core", F.col("n").alias("c")))
        if state.agg(F.min("c") == F.max("c")).first()[0]:
            break
    edges = points.sparkSession.createDataFrame([], _EDGES)
    for f in found:
        edges = edges.unionByName(f)
    return edges


def merged_band(e: np.ndarray, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> dict[str, list]:
    """Merge a band's edges in the order of their ranks. Ends are components by their smallest place, wa and wb their numbers of rows. Of each merge: its number of rows, both sides (rank of a merge of this
    band, -1 - place of a single row, or None for a component of earlier bands), their numbers of rows and smallest places; last tells whether no later merge of the band has the same smallest place."""
    parent: dict[int, int] = {}
    weight: dict[int, int] = {}
    node: dict[int, int | None] = {}
    for x, w in (*zip(a.tolist(), wa.tolist(), strict=True), *zip(b.tolist(), wb.tolist(), strict=True)):
        if x not in parent:
            parent[x], weight[x], node[x] = x, w, -1 - x if w == 1 else None

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: dict[str, list] = {c: [] for c in ("size", "left", "right", "lsize", "rsize", "x", "y")}
    newest: dict[int, int] = {}
    for k, (rank, p, q) in enumerate(zip(e.tolist(), a.tolist(), b.tolist(), strict=True)):
        x, y = find(p), find(q)
        x, y = (x, y) if x < y else (y, x)
        for c, value in zip(out, (weight[x] + weight[y], node[x], node[y], weight[x], weight[y], x, y), strict=True):
            out[c].append(value)
        parent[y], weight[x], node[x] = x, weight[x] + weight[y], rank
        newest[x] = k
    last = [False] * len(e)
    for k in newest.values():
        last[k] = True
    return out | {"last": last}


def dendrogram(edges: DataFrame, n: int, band: int = BAND) -> DataFrame:
    """(e, d, size, left, right, lsize, rsize): the merges of n rows by rank e, from the spanning tree's edges. left and right are merges' ranks, or -1 - place for a row."""
    ranked = numbered(edges.withColumn("o", F.struct("d", "a", "b")), "o", "e").drop("o")
    bands = math.ceil(max(1, n - 1) / band)
    depth = (bands - 1).bit_length()
    state = cut(ranked.select("e", "a", "b", "d", F.lit(1).cast("bigint").alias("wa"), F.lit(1).cast("bigint").alias("wb"), F.expr(f"e DIV {band}").alias("k")))
    for level in range(depth):  # the lighter half of every part is contracted for the heavier half
        part, heavy = F.shiftright("k", depth - level), F.shiftright("k", depth - level - 1).bitwiseAND(F.lit(1)) == 1
        ends = state.withColumns({"a1": part * n + F.col("a"), "b1": part * n + F.col("b")})
        light = cut(ends.filter(~heavy).select("a1", "b1", "wa", "wb"))
        nodes = light.select(F.col("a1").alias("id"), F.col("wa").alias("w")).unionByName(light.select(F.col("b1").alias("id"), F.col("wb").alias("w"))).distinct()
        whole = components(nodes.select("id"), light.select(F.col("a1").alias("a"), F.col("b1").alias("b")))
        weights = nodes.join(whole, "id").groupBy("component").agg(F.sum("w").alias("w"))
        named = cut(whole.join(weights, "component").select("id", (F.col("component") % n).alias("c"), "w"))
        moved = ends.filter(heavy)
        for end, w in (("a", "wa"), ("b", "wb")):
            other = named.withColumnsRenamed({"id": end + "1", "c": "__c", "w": "__w"})
            moved = moved.join(other, end + "1", "left").withColumns({end: F.coalesce("__c", end), w: F.coalesce("__w", w)}).drop("__c", "__w")
        state = cut(ends.filter(~heavy).select(*state.columns).unionByName(moved.select(*state.columns)))

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("e")
        found = merged_band(*(t.column(c).to_numpy() for c in ("e", "a", "b", "wa", "wb")))
        kinds = {"last": pa.bool_()}
        return pa.table({"e": t.column("e"), "d": t.column("d"), "k": t.column("k")} | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in found.items()})

    merges = state.groupBy("k").applyInArrow(merge, "e bigint, d double, k bigint, size bigint, left bigint, right bigint, lsize bigint, rsize bigint, x bigint, y bigint, last boolean")
    columns = ["e", "d", "size", "left", "right", "lsize", "rsize"]
    if not depth:
        return cut(merges.select(*columns))
    merges = cut(merges)
    # of a component from earlier bands the last merge with its smallest place; a place has two rows a band at most
    ends = merges.filter("last").select(F.col("x").alias("z"), "k", F.col("e").alias("made"), F.lit(None).cast("bigint").alias("for"), F.lit(None).cast("string").alias("side"))
    for side, z in (("left", "x"), ("right", "y")):
        ends = ends.unionByName(merges.filter(F.col(side).isNull()).select(F.col(z).alias("z"), "k", F.lit(None).cast("bigint").alias("made"), F.col("e").alias("for"), F.lit(side).alias("side")))
    before = F.last("made", ignorenulls=True).over(Window.partitionBy("z").orderBy("k").rangeBetween(Window.unboundedPreceding, -1))
    asked = ends.withColumn("of", before).filter("side IS NOT NULL").groupBy(F.col("for").alias("e")).agg(*[F.max(F.when(F.col("side") == s, F.col("of"))).alias("of_" + s) for s in ("left", "right")])
    filled = merges.join(asked, "e", "left").withColumns({s: F.coalesce(s, "of_" + s) for s in ("left", "right")})
    return cut(filled.select(*columns))


def _density(d: Column) -> Column:
    return F.when(d > 0, 1 / d).otherwise(F.lit(float("inf")))


def _gain(at: Column, birth: Column) -> Column:
    return F.when(at == birth, F.lit(0.0)).otherwise(F.least(at, F.lit(_MOST)) - birth)


def jumped(state: DataFrame) -> DataFrame:
    """(node, to) from (node, to, done): where each node comes by going on from to until it is done. Each round doubles the way."""
    state = cut(state)
    while not state.filter("NOT done").isEmpty():
        far = state.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("done").alias("over"))
        state = cut(state.filter("done").unionByName(state.filter("NOT done").join(far, "to").select("node", F.col("far").alias("to"), F.col("over").alias("done"))))
    return state.select("node", "to")


def worths(clusters: DataFrame) -> DataFrame:
    """(c, worth) of clusters (c, parent, stability), each of which has two below it or none: the larger of its stability and what the two are worth together."""
    none = F.lit(None).cast("double")
    below = clusters.filter("parent IS NOT NULL").select(F.col("parent").alias("c")).distinct().withColumn("inner", F.lit(True))
    state = clusters.join(below, "c", "left").select("c", "parent", "stability", F.when(F.col("inner").isNull(), F.col("stability")).alias("worth"), none.alias("p"), none.alias("q"), F.lit(None).cast("bigint").alias("to"))
    state = cut(state)
    while not state.filter("worth IS NULL").isEmpty():
        kids = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("c")).agg(F.count("worth").alias("known"), F.sum("worth").alias("total"), F.min(F.when(F.col("worth").isNull(), F.col("c"))).alias("open"))
        one = F.col("to").isNull() & F.col("worth").isNull() & (F.col("known") == 1)
        raked = state.join(kids, "c", "left").select("c", "parent", "stability", F.coalesce("worth", F.when(F.col("known") == 2, F.greatest("stability", "total"))).alias("worth"), F.when(one, F.col("stability")).otherwise(F.col("p")).alias("p"), F.when(one, F.col("total")).otherwise(F.col("q")).alias("q"), F.when(one, F.col("open")).otherwise(F.col("to")).alias("to"))
        raked = cut(raked)
        far = raked.select(F.col("c").alias("to"), F.col("worth").alias("w2"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("to").alias("to2"))
        on = F.col("worth").isNull() & F.col("w2").isNull() & F.col("to2").isNotNull()
        state = cut(raked.join(far, "to", "left").select("c", "parent", "stability", F.coalesce("worth", F.greatest("p", F.col("q") + F.col("w2")) * F.when(F.col("w2").isNotNull(), 1.0)).alias("worth"), F.when(on, F.greatest("p", F.col("q") + F.col("p2"))).otherwise(F.col("p")).alias("p"), F.when(on, F.col("q") + F.col("q2")).otherwise(F.col("q")).alias("q"), F.when(on, F.col("to2")).otherwise(F.col("to")).alias("to")))
    return state.select("c", "worth")


def condensed(merges: DataFrame, n: int, least: int) -> DataFrame:
    """(pos, label, probability) of the rows in clusters of at least `least`, from the hierarchy's merges; other rows are noise and not returned."""
    spark = merges.sparkSession
    nothing = spark.createDataFrame([], "pos bigint, label int, probability double")
    if n < least or n < 2:
        return nothing
    split = (F.col("lsize") >= least) & (F.col("rsize") >= least)
    up = cut(merges.select(F.col("e").alias("parent"), F.col("d").alias("pd"), F.col("size").alias("psize"), split.alias("psplit"), F.explode(F.array(F.struct(F.col("left").alias("node"), F.col("lsize").alias("size")), F.struct(F.col("right").alias("node"), F.col("rsize").alias("size")))).alias("s")).select("s.node", "s.size", "parent", "pd", "psize", "psplit"))
    # the first merge above each row that is large enough
    fell = jumped(up.filter(F.col("size") < least).select("node", F.col("parent").alias("to"), (F.col("psize") >= least).alias("done"))).filter("node < 0")
    large = cut(merges.filter(F.col("size") >= least).select(F.col("e").alias("node"), "d", "size", split.alias("split")).join(up.select("node", "parent", "pd", "psplit"), "node", "left"))
    top = F.col("parent").isNull() | F.col("psplit")
    heads = cut(jumped(large.select("node", F.when(top, F.col("node")).otherwise(F.col("parent")).alias("to"), top.alias("done"))).withColumnRenamed("to", "c"))
    over = heads.select(F.col("node").alias("parent"), F.col("c").alias("above"))
    clusters = large.filter(top).select(F.col("node").alias("c"), "size", "parent", F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(_density(F.col("pd"))).alias("birth")).join(over, "parent", "left")
    clusters = cut(clusters.select("c", "size", "birth", F.col("above").alias("parent")))
    ends = fell.join(heads.select(F.col("node").alias("to"), "c"), "to").join(large.select(F.col("node").alias("to"), _density(F.col("d")).alias("at")), "to")
    rows = cut(ends.select((-1 - F.col("node")).alias("pos"), "c", "at"))
    losses = rows.groupBy("c", "at").agg(F.count("*").alias("n")).unionByName(clusters.filter("parent IS NOT NULL").select(F.col("parent").alias("c"), F.col("birth").alias("at"), F.col("size").alias("n")))
    summed = losses.join(clusters.select("c", "birth"), "c").groupBy("c").agg(F.sum(F.col("n") * _gain(F.col("at"), F.col("birth"))).alias("stability"), F.max("at").alias("death"))
    known = cut(clusters.join(summed, "c").select("c", "parent", "stability", "death"))
    worth = cut(worths(known))
    inner = worth.join(known.filter("parent IS NOT NULL").select("c", "parent"), "c").groupBy(F.col("parent").alias("c")).agg(F.sum("worth").alias("inner"))
    chosen = F.col("parent").isNotNull() & (F.col("inner").isNull() | (F.col("stability") >= F.col("inner") * (1 - SLACK)))
    # the topmost chosen one among each cluster and those above it
    state = cut(known.join(inner, "c", "left").select("c", F.col("parent").alias("to"), F.when(chosen, F.col("c")).alias("home")))
    while not state.filter("to IS NOT NULL").isEmpty():
        far = state.select(F.col("c").alias("to"), F.col("to").alias("far"), F.col("home").alias("higher"))
        state = cut(state.join(far, "to", "left").select("c", F.col("far").alias("to"), F.coalesce("higher", "home").alias("home")))
    member = cut(rows.join(state.filter("home IS NOT NULL").select("c", "home"), "c").select("pos", "at", F.col("home").alias("c")))
    named = numbered(member.groupBy("c").agg(F.min("pos").alias("first")), "first", "label").join(known.select("c", "death"), "c")
    share = F.when((F.col("death") == 0) | (F.col("at") == F.lit(float("inf"))), F.lit(1.0)).otherwise(F.least("at", "death") / F.col("death"))
    return member.join(named.select("c", F.col("label").cast("int").alias("label"), "death"), "c").select("pos", "label", share.alias("probability"))


def condensed_task(d: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, lsize: np.ndarray, rsize: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and probability of every place, by the rules of condensed(), from the merges in the order of their ranks."""
    n = len(d) + 1
    label, share = np.full(n, -1), np.zeros(n)
    if n < max(2, least):
        return label, share
    with np.errstate(divide="ignore"):
        at = np.where(d > 0, 1 / np.where(d > 0, d, 1), np.inf)
    split = (lsize >= least) & (rsize >= least)
    cluster, where = np.zeros(n - 1, np.int64), np.zeros(n, np.int64)  # of a merge the topmost one of its cluster, if it is large; of a row the merge in which it falls out
    births, parents, death = {n - 2: 0.0}, {n - 2: -1}, {n - 2: 0.0}
    stability = {n - 2: 0.0}
    cluster[n - 2] = n - 2
    falls = np.full(n - 1, -1)  # of small merges
    for e in range(n - 2, -1, -1):
        large = size[e] >= least
        c = int(cluster[e]) if large else -1
        for node, rows in ((int(left[e]), int(lsize[e])), (int(right[e]), int(rsize[e]))):
            to = e if large else int(falls[e])
            if large:
                gain = 0.0 if at[e] == births[c] else min(at[e], _MOST) - births[c]
                if split[e]:
                    births[node], parents[node], stability[node], death[node], cluster[node] = float(at[e]), c, 0.0, 0.0, node
                if split[e] or rows < least:
                    stability[c] += rows * gain
                    death[c] = max(death[c], float(at[e]))
                else:
                    cluster[node] = c
            if node < 0:
                where[-1 - node] = to
            elif rows < least:
                falls[node] = to
    inner: dict[int, float] = {}
    chosen, worth = {}, {}
    for c in sorted(births):  # what is below comes first
        below = inner.get(c)
        chosen[c] = parents[c] >= 0 and (below is None or stability[c] >= below * (1 - SLACK))
        worth[c] = stability[c] if below is None else max(stability[c], below)
        if parents[c] >= 0:
            inner[parents[c]] = inner.get(parents[c], 0.0) + worth[c]
    home: dict[int, int] = {}
    for c in sorted(births, reverse=True):
        above = home.get(parents[c], -1)
        home[c] = above if above >= 0 else c if chosen[c] else -1
    of = np.array([home[int(cluster[e])] for e in where])
    kept = np.flatnonzero(of >= 0)
    names, first, place = np.unique(of[kept], return_index=True, return_inverse=True)
    number = np.empty(len(names), np.int64)
    number[np.argsort(first)] = np.arange(len(names))  # in the order of the smallest places
    label[kept] = number[place]
    own, top = at[where[kept]], np.array([death[c] for c in names.tolist()])[place] if len(names) else np.zeros(0)
    share[kept] = np.where(np.isinf(own) | (top == 0), 1.0, np.minimum(np.where(np.isinf(own), 0, own), top) / np.where(top == 0, 1, top))
    return label, share


def tree_task(v: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, ...]:
    """(d, size, left, right, lsize, rsize) of all merges of few rows."""
    return merged_tree(*prim(v, core))


def merged_tree(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a, w))
    ones = np.ones(len(a), np.int64)
    found = merged_band(np.arange(len(a)), a[order], b[order], ones, ones)
    return (w[order], *(np.array(found[c], np.int64) for c in ("size", "left", "right", "lsize", "rsize")))


def grid(rows: DataFrame, sizes: Sequence[int], samples: Sequence[int], *, id_col: str = "id", vec_col: str = "emb", one_task: int = 8192, band: int = BAND) -> DataFrame:
    """(min_samples, min_cluster_size, id, label, probability) of all rows for every setting: one pass for all core distances, one tree for each min_samples, from which every min_cluster_size is
    condensed. Of fewer rows than three times min_cluster_size a third (2 at least) is the size. Up to one_task rows go to one task, up to two bands through in_passes, and more through tables."""
    spark = rows.sparkSession
    points = placed(rows, id_col, vec_col)
    n = points.count()
    least = {s: min(s, max(2, n // 3)) for s in sizes}
    settings = "min_samples int, min_cluster_size int, pos bigint, label int, probability double"
    found = spark.createDataFrame([], settings)
    if n > max(2, one_task) and n <= 2 * band:
        found = in_passes(points, n, sizes, samples, least, settings)
    elif n >= 2:
        cored = core_distances(points.select("pos", "v"), samples)
        if n <= one_task:

            def whole(t: pa.Table) -> pa.Table:
                t, out = t.sort_by("pos"), []
                v = matrix(t.column("v"))
                for k in samples:
                    tree = tree_task(v, t.column(f"c{k}").to_numpy())
                    for s in sizes:
                        label, share = condensed_task(*tree, least[s])
                        kept = np.flatnonzero(label >= 0)
                        out.append(pa.table({"min_samples": pa.array(np.full(len(kept), k, np.int32)), "min_cluster_size": pa.array(np.full(len(kept), s, np.int32)), "pos": pa.array(kept), "label": pa.array(label[kept].astype(np.int32)), "probability": pa.array(share[kept])}))
                return pa.concat_tables(out)

            found = cored.groupBy(F.lit(0).alias("g")).applyInArrow(whole, settings)
        else:
            cored = cut(cored)
            for k in samples:
                merges = dendrogram(spanning_edges(cored, f"c{k}"), n, band)
                for s in sizes:
                    found = found.unionByName(condensed(merges, n, least[s]).select(F.lit(k).alias("min_samples"), F.lit(s).alias("min_cluster_size"), "pos", "label", "probability"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("min_samples"), F.lit(s).alias("min_cluster_size")) for k in samples for s in sizes])).alias("g")
    everyone = points.select("id", "pos").unionByName(rows.select(F.col(id_col).alias("id"), double(F.col(vec_col)).alias("v")).filter(~F.coalesce(usable(F.col("v")), F.lit(False))).select("id", F.lit(None).cast("bigint").alias("pos")))
    asked = everyone.select("id", "pos", each).select("id", "pos", "g.*")
    if n < 2:
        return asked.select("min_samples", "min_cluster_size", "id", F.lit(-1).alias("label"), F.lit(0.0).alias("probability"))
    joined = asked.join(found, ["min_samples", "min_cluster_size", "pos"], "left")
    return joined.select("min_samples", "min_cluster_size", "id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
