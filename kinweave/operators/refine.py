"""Cluster refinement: merge close clusters, split wide ones, give noise to near clusters, score confidence, fill the review queue."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.vectors import double, euclidean_distance, l2_normalize, matrix, units, vector_mean, vector_sums
from kinweave.operators.clustering import centroid_probability, linked
from kinweave.operators.graph import cut, numbered
from kinweave.operators.similarity import BLOCK, MOST_NUMBERS, group_blocks, nearest


#: Clusters up to which merging is done at once; more go through components.
FEW_CLUSTERS = 8192
#: Clusters of a component that one task merges.
MOST_MERGED = 16384


@dataclass(frozen=True)
class RefineConfig:
    merge_threshold: float = 0.3
    split_threshold: float = 0.8
    reassign_threshold: float = 0.6
    review_threshold: float = 0.4
    split_least: int = 4
    seed: int = 42


def merge_plan(labels: list[int], counts: np.ndarray, totals: np.ndarray, threshold: float, formed: list | None = None) -> dict[int, int]:
    """Old label to new one: the closest pair of mean vectors under threshold is merged, the larger label into the smaller, again and again (ties: the smaller labels). Works on sums: points are never read again.
    Of each label only the nearest later one is kept, so memory grows with the number of labels, not with that of their pairs. formed gets (label that stays, label that goes, sum) of each merge."""
    n, totals, home = len(labels), totals.astype(float).copy(), list(range(len(labels)))
    unit, alive = units(totals), np.ones(len(labels), bool)
    near, far = np.full(n, -1), np.full(n, np.inf)

    def look(rows: np.ndarray) -> None:
        """Find the nearest later label of some."""
        for a in range(0, len(rows), 256):
            some = rows[a : a + 256]
            d = 1.0 - unit[some] @ unit.T
            d[:, ~alive] = np.inf
            d[np.arange(n)[None, :] <= some[:, None]] = np.inf
            near[some] = d.argmin(1)
            far[some] = d[np.arange(len(some)), near[some]]

    look(np.arange(n))
    while n > 1:
        i = int(far.argmin())
        j = int(near[i])
        if not far[i] < threshold:
            break
        totals[i] += totals[j]
        unit[i] = units(totals[i : i + 1])[0]
        alive[j], far[j], home[j] = False, np.inf, i
        if formed is not None:
            formed.append((labels[i], labels[j], totals[i].copy()))
        stale = alive & ((near == i) | (near == j))
        stale[i] = True
        look(np.flatnonzero(stale))
        before = np.flatnonzero(alive[:i])  # labels before i for which it may be nearer now
        if len(before):
            d = 1.0 - unit[before] @ unit[i]
            closer = (d < far[before]) | ((d == far[before]) & (i < near[before]))
            near[before[closer]], far[before[closer]] = i, d[closer]
    for k in range(n):  # a label's home is a smaller one, which is settled before it
        home[k] = home[home[k]] if home[k] != k else k
    return {labels[k]: labels[home[k]] for k in range(n)}


def _merge_components(current: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """merge_plan within each component (parts: id, component) of current (label, total). Rows: of each label its home and, for one that stays, its sum; of each merge the sum that it formed, with id -1 less the label that goes."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("label")
        labels, totals, formed = t.column("label").to_pylist(), matrix(t.column("total")), []
        home = merge_plan(labels, np.ones(len(labels)), totals, threshold, formed)
        last = dict(zip(labels, totals, strict=True)) | {i: v for i, _, v in formed}
        rows = [(k, home[k], last[k].tolist() if home[k] == k else None) for k in labels] + [(-1 - j, i, v.tolist()) for i, j, v in formed]
        return pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "home": pa.array([r[1] for r in rows], pa.int64()), "total": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})

    own = current.join(parts.withColumnRenamed("id", "label"), "label")
    return own.groupBy("component").applyInArrow(run, "id bigint, home bigint, total array<double>")


def merge_homes(sums: DataFrame, threshold: float, *, most: int = MOST_MERGED, block: int = BLOCK) -> DataFrame:
    """(label, home): merge_plan's result for sums (label bigint, total) of any number, without the driver.

    Clusters are dealt by components of links under the threshold, and each component is merged in its task. A mean of two can be nearer to a third than either was, so every sum that was formed on the way is held
    against those of all components; components that any of them links are merged as one, from the start. When none does, no step of the one greedy loop could have joined two components, and its steps within each are
    those done. If a component has over `most` clusters a smaller threshold comes first: the loop's steps up to the first distance beyond it are the same, so the loop goes on from there. Only where thresholds that
    differ by a thousandth still leave a larger component (clusters all equally near) does one task take more than `most`."""
    reach = lambda t: float(np.sqrt(2 * max(t, 0.0)) * (1 + 1e-9) + 1e-7)  # noqa: E731  of unit vectors, and a little beyond
    unit = lambda df, key: df.select(F.col(key).alias("id"), F.coalesce(l2_normalize(F.col("total")), double(F.col("total"))).alias("v"))
    largest = lambda parts: parts.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    homes = cut(sums.select("label", F.col("label").alias("home")))
    current, low, at = cut(sums.select("label", "total")), 0.0, threshold
    while not current.isEmpty():
        parts = cut(linked(unit(current, "label"), reach(at), block=block))
        while True:
            if largest(parts) > most and at - low > threshold * 1e-3:
                at = (low + at) / 2
                parts = cut(linked(unit(current, "label"), reach(at), block=block))
                continue
            merged = cut(_merge_components(current, parts, at))
            formed = unit(current, "label").unionByName(unit(merged.filter("id < 0"), "id"))
            again = cut(linked(formed, reach(at), block=block).filter("id >= 0"))
            if again.select("component").distinct().count() == parts.select("component").distinct().count():
                break
            parts = again
        stay = merged.filter("id >= 0")
        homes = cut(homes.join(stay.select(F.col("id").alias("home"), F.col("home").alias("__next")), "home").select("label", F.col("__next").alias("home")))
        current = cut(stay.filter("id = home").select(F.col("id").alias("label"), "total"))
        if at >= threshold:
            break
        low, at = at, threshold
    return homes


def merge_clusters(rows: DataFrame, threshold: float, *, id_col: str = "id", vec_col: str = "emb", few: int = FEW_CLUSTERS, most: int = MOST_MERGED) -> DataFrame:
    """rows with labels merged: the closest two mean vectors under threshold again and again, the larger label into the smaller. Up to `few` clusters, of a checked size, are merged at once on the driver, more by
    merge_homes. Clusters whose sum has a null, a NaN or an infinity stay as they are."""
    sums = cut(vector_sums(rows.filter("label >= 0"), "label", vec_col).filter("NOT exists(total, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))").select(F.col("label").cast("bigint").alias("label"), "n", "total"))
    shape = sums.agg(F.count("*").alias("n"), F.max(F.size("total")).alias("d")).first()
    if shape["n"] < 2:
        return rows
    if shape["n"] <= few and shape["n"] * shape["d"] <= MOST_NUMBERS:
        table = sums.orderBy("label").toArrow()
        home = merge_plan(table.column("label").to_pylist(), table.column("n").to_numpy(), matrix(table.column("total")), threshold)
        plan = rows.sparkSession.createDataFrame([(k, v) for k, v in home.items() if k != v] or [(-9, -9)], "label int, __new int")
    else:
        plan = merge_homes(sums, threshold, most=most).filter("label <> home").select(F.col("label").cast("int").alias("label"), F.col("home").cast("int").alias("__new"))
    return rows.join(plan, "label", "left").select(*[F.coalesce("__new", "label").cast("int").alias("label") if c == "label" else F.col(c) for c in rows.columns])


def two_means(v: np.ndarray, seed: int, tries: int = 10, rounds: int = 100) -> np.ndarray:
    """Side (0 or 1) of each row in the best of several two-means runs; the first row's side is 0."""
    rng, best, side = np.random.default_rng(seed), np.inf, np.zeros(len(v), int)
    for _ in range(tries):
        first = int(rng.integers(len(v)))
        weight = ((v - v[first]) ** 2).sum(1)
        if weight.sum() == 0:
            return side
        centers = np.stack([v[first], v[int(rng.choice(len(v), p=weight / weight.sum()))]])
        for _ in range(rounds):
            d = ((v[:, None, :] - centers[None]) ** 2).sum(2)
            own = d.argmin(1)
            new = np.stack([v[own == k].mean(0) if (own == k).any() else centers[k] for k in (0, 1)])
            if np.allclose(new, centers):
                break
            centers = new
        cost = d.min(1).sum()
        if cost < best - 1e-12:
            best, side = cost, own
    return side if side[0] == 0 else 1 - side


def cluster_diameter(rows: DataFrame, *, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """(label, n, max_distance): largest cosine distance of two rows of a label (0 for one row). A label of any size is dealt over as many tasks as it has pairs of blocks."""

    def widest(label, ia, va, ib, vb, same):
        d = 1.0 - units(va) @ units(vb).T
        return pa.table({"label": pa.array([label], pa.int64()), "n": pa.array([len(va) if same else 0], pa.int64()), "d": pa.array([float(d.max()) if d.size and (not same or len(va) > 1) else 0.0])})

    found = group_blocks(rows.filter("label >= 0"), "label", id_col, vec_col, "label bigint, n bigint, d double", widest)
    return found.groupBy(F.col("label").cast("int").alias("label")).agg(F.sum("n").alias("n"), F.max("d").alias("max_distance"))


def _centers(rows: DataFrame, seed: int, sample: int) -> DataFrame:
    """(label, a, b): centres of the best of several two-means runs over the sample rows of each label with the smallest hashes."""
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    chosen = rows.withColumn("__place", place).filter(F.col("__place") <= sample).drop("__place")

    def halve(t: pa.Table) -> pa.Table:
        v = matrix(t.sort_by("id").column("v"))
        side = two_means(v, seed)
        a, b = v[side == 0].mean(0), v[side == 1].mean(0) if (side == 1).any() else v[side == 0].mean(0)
        return pa.table({"label": t.column("label").slice(0, 1), "a": pa.array([a.tolist()]), "b": pa.array([b.tolist()])})

    return chosen.groupBy("label").applyInArrow(halve, "label int, a array<double>, b array<double>")


def halves(rows: DataFrame, *, seed: int = 42, sample: int = 2048) -> DataFrame:
    """(id, label, side) of rows (id, label, v): two means of each label. Runs start on a sample; then all rows move, summed in their tasks, until no centre does, so a label may have any size. The side of a
    label's smallest id is 0."""
    rows = cut(rows)
    centers = cut(_centers(rows, seed, sample))
    while True:
        sides = rows.join(centers, "label").select("id", "label", "v", (euclidean_distance(F.col("v"), F.col("b")) < euclidean_distance(F.col("v"), F.col("a"))).cast("int").alias("side"))
        sums = vector_sums(sides.withColumn("key", F.col("label").cast("bigint") * 2 + F.col("side")), "key", "v")
        means = sums.select(F.floor(F.col("key") / 2).cast("int").alias("label"), (F.col("key") % 2).alias("side"), F.transform("total", lambda x: x / F.col("n")).alias("c"))
        new = means.groupBy("label").agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("y"))
        new = cut(centers.join(new, "label", "left").select("label", F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"), F.greatest(euclidean_distance(F.col("a"), F.coalesce("x", "a")), euclidean_distance(F.col("b"), F.coalesce("y", "b"))).alias("moved")))
        if (new.agg(F.max("moved")).first()[0] or 0.0) <= 1e-9:
            break
        centers = new.drop("moved")
    sides = cut(sides.select("id", "label", "side"))
    first = sides.groupBy("label").agg(F.min_by("side", "id").alias("zero"))
    return sides.join(first, "label").select("id", "label", F.when(F.col("side") == F.col("zero"), 0).otherwise(1).alias("side"))


def split_clusters(rows: DataFrame, threshold: float, *, least: int = 4, seed: int = 42, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """rows with clusters of at least `least` rows and a diameter over threshold split by two means where both sides have two rows; new labels follow the largest one in the order of the old."""
    wide = cut(cluster_diameter(rows, id_col=id_col, vec_col=vec_col).filter((F.col("n") >= least) & (F.col("max_distance") > threshold)).select("label"))
    if wide.isEmpty():
        return rows
    own = rows.join(wide, "label", "left_semi").select(F.col(id_col).alias("id"), F.col("label").cast("int").alias("label"), double(F.col(vec_col)).alias("v"))
    found = cut(halves(own, seed=seed))
    accepted = found.groupBy("label").agg(F.count_if(F.expr("side = 0")).alias("x"), F.count_if(F.expr("side = 1")).alias("y")).filter("x >= 2 AND y >= 2")
    moved = found.filter("side = 1").join(number_splits(accepted.select("label"), rows), "label").select(F.col("id").alias(id_col), "new_label")
    return rows.join(moved, id_col, "left").select(*[F.coalesce("new_label", "label").cast("int").alias("label") if c == "label" else F.col(c) for c in rows.columns])


def number_splits(accepted: DataFrame, rows: DataFrame) -> DataFrame:
    """(label, new_label): the largest label of rows plus 1, 2, ... in label order."""
    top = rows.agg(F.max("label")).first()[0] or 0
    return numbered(accepted, "label", "nth").select("label", (F.col("nth") + (top + 1)).cast("int").alias("new_label"))


def reassign_noise(rows: DataFrame, threshold: float, *, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """rows with noise given to the nearest centroid if nearer than threshold (ties: the smallest label). Centroids are those before any reassignment."""
    centroids = vector_mean(rows.filter("label >= 0"), "label", vec_col)
    found = nearest(rows.filter("label < 0"), centroids, id_col=id_col, vec_col=vec_col, key_col="label", target_col="centroid").filter(F.col("distance") < threshold)
    found = found.select(id_col, F.col("label").alias("__new"))
    return rows.join(found, id_col, "left").select(*[F.coalesce("__new", "label").cast("int").alias("label") if c == "label" else F.col(c) for c in rows.columns])


def confidence(rows: DataFrame, *, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """(id, label, confidence): probability times the closeness to the centroid by cosine; noise 0.05."""
    near = centroid_probability(rows, metric="cosine", id_col=id_col, vec_col=vec_col).select("id", F.col("probability").alias("closeness"))
    joined = rows.select(F.col(id_col).alias("id"), "label", "probability").join(near, "id")
    return joined.select("id", "label", F.when(F.col("label") < 0, 0.05).otherwise(F.col("probability") * F.col("closeness")).alias("confidence"))


def in_review(label: Column, conf: Column, threshold: float) -> Column:
    return (label == -1) | (conf < threshold)


def refine(rows: DataFrame, config: RefineConfig = RefineConfig(), *, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """(id, label, confidence, in_review) from rows (id, emb, label, probability)."""
    merged = cut(merge_clusters(rows, config.merge_threshold, id_col=id_col, vec_col=vec_col))
    split = cut(split_clusters(merged, config.split_threshold, least=config.split_least, seed=config.seed, id_col=id_col, vec_col=vec_col))
    final = confidence(reassign_noise(split, config.reassign_threshold, id_col=id_col, vec_col=vec_col), id_col=id_col, vec_col=vec_col)
    return final.withColumn("in_review", in_review(F.col("label"), F.col("confidence"), config.review_threshold))
