"""Statistics of all pairs' cosine distances and the thresholds that follow from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scalars import clip
from kinweave.functions.vectors import units
from kinweave.operators.similarity import ROOM, all_blocks

PERCENTILES = (5, 25, 50, 75, 95, 15)
_BINS = 1 << 16
#: Pairs of blocks of one task at most: each task sends its counts by bin.
_PAIRS = 256


def _bin(d: np.ndarray) -> np.ndarray:
    """The bin of distances from -0.5 to 2.5."""
    x = d + 0.5
    x *= _BINS / 3
    return x.astype(np.int32)


@dataclass(frozen=True)
class ThresholdConfig:
    enabled: bool = True
    default_merge: float = 0.3
    default_split: float = 0.8
    default_review: float = 0.4
    fixed_merge: float | None = None
    fixed_split: float | None = None
    fixed_review: float | None = None
    least_rows: int = 3


def distance_stats(rows: DataFrame, *, id_col: str = "id", vec_col: str = "emb", few: int = 1 << 18) -> DataFrame:
    """One row: num_pairs, mean, std (population), min, max, and exact percentiles with linear interpolation. The pairs are passed in blocks that the tasks read: first counts by fine bins of distance, then, as long
    as the cells that hold the wanted ranks have more than few values, counts by finer cells of those bins alone, and in the end their values. What comes to the driver has a bound whatever the number of pairs."""
    spark = rows.sparkSession
    kept = all_blocks(rows, id_col, vec_col)
    jobs = kept.jobs(np.ones((len(kept.names),) * 2, bool), _PAIRS)

    def tiles(read, i, js):
        """The distances of a block's rows, some at a time, in the same way in every pass; pairs with a vector that isn't finite are none."""
        own = lambda v: (u := units(v))[np.isfinite(u).all(1)]
        va = own(read(i)[1])
        for j in js:
            vb = va if j == i else own(read(j)[1])
            step = max(1, (ROOM >> 5) // max(1, len(vb)))
            for k in range(0, len(va), step):
                d = va[k : k + step] @ vb.T
                np.subtract(1.0, d, out=d)
                d = d[np.arange(k, k + len(d))[:, None] < np.arange(len(vb))] if j == i else d.ravel()
                if len(d):
                    yield d

    def count(read, i, js):
        n, total, s, q, a, b = np.zeros(_BINS, np.int64), 0, 0.0, 0.0, np.inf, -np.inf
        for d in tiles(read, i, js):
            n += np.bincount(_bin(d), minlength=_BINS)
            total, s, q, a, b = total + len(d), s + float(d.sum()), q + float(d @ d), min(a, float(d.min())), max(b, float(d.max()))
        at = np.flatnonzero(n)
        if total:
            yield pa.table({"bin": pa.array([-1], pa.int64()), "n": pa.array([total], pa.int64()), "s": [s], "q": [q], "a": [a], "b": [b]})
            nothing = pa.nulls(len(at), pa.float64())
            yield pa.table({"bin": pa.array(at), "n": pa.array(n[at]), "s": nothing, "q": nothing, "a": nothing, "b": nothing})

    def counted(choose: Callable, low: np.ndarray, high: np.ndarray, parts: int) -> dict[tuple[int, int], tuple]:
        """Of each interval and each of its parts: number, least and greatest of the values that choose gives, with their intervals."""

        def finer(read, i, js):
            for d in tiles(read, i, js):
                d, k = choose(d)
                if not len(d):
                    continue
                width = np.where(high > low, high - low, 1.0)
                c, place = np.unique(np.clip(((d - low[k]) / width[k] * parts).astype(np.int64), 0, parts - 1) + k * parts, return_inverse=True)
                least, most = np.full(len(c), np.inf), np.full(len(c), -np.inf)
                np.minimum.at(least, place, d)
                np.maximum.at(most, place, d)
                yield pa.table({"cell": pa.array(c), "n": pa.array(np.bincount(place, minlength=len(c)).astype(np.int64)), "a": pa.array(least), "b": pa.array(most)})

        found = kept.tasks(jobs, "cell bigint, n bigint, a double, b double", finer)
        found = found.groupBy("cell").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).orderBy("cell").collect()
        return {divmod(r["cell"], parts): (r["n"], r["a"], r["b"]) for r in found}

    found = kept.tasks(jobs, "bin bigint, n bigint, s double, q double, a double, b double", count)
    found = found.groupBy("bin").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "s"), (F.sum, "q"), (F.min, "a"), (F.max, "b"))]).orderBy("bin").collect()
    names = ["num_pairs", "mean", "std", "min", "max", *[f"p{p}" for p in PERCENTILES]]
    schema = "num_pairs bigint, " + ", ".join(f"{n} double" for n in names[1:])
    if not found:
        kept.drop()
        return spark.createDataFrame([(0, *[None] * (len(names) - 1))], schema)
    total, mean = found[0]["n"], found[0]["s"] / found[0]["n"]
    std = max(0.0, found[0]["q"] / total - mean * mean) ** 0.5
    at = {p: (total - 1) * p / 100 for p in PERCENTILES}
    ranks = sorted({int(x) for x in at.values()} | {min(total - 1, int(x) + 1) for x in at.values()})
    place, ends = np.array([r["bin"] for r in found[1:]]), np.cumsum([r["n"] for r in found[1:]])
    bins = np.searchsorted(ends, ranks, "right")  # of each rank
    each = np.unique(bins)
    index = np.full(_BINS, -1, np.int8)  # a dozen at most
    index[place[each]] = np.arange(len(each))

    def of_bins(d):
        k = index[_bin(d)]
        keep = k >= 0
        return d[keep], k[keep].astype(np.int64)

    def within(low: np.ndarray, high: np.ndarray) -> Callable:
        def of_intervals(d):
            d = of_bins(d)[0]
            k = np.searchsorted(low, d, "right") - 1
            d, k = d[k >= 0], k[k >= 0]
            inside = d <= high[k]
            return d[inside], k[inside]

        return of_intervals

    def homes(cells: dict, before: dict[int, int], of: dict[int, list[int]]) -> dict[int, tuple]:
        """Of each rank the cell that holds it: (least, greatest, values before it, values in it)."""
        out = {}
        for k, own_ranks in of.items():
            upto = before[k]
            mine = sorted(c for c in cells if c[0] == k)
            ends = upto + np.cumsum([cells[c][0] for c in mine])
            for r in own_ranks:
                j = int(np.searchsorted(ends, r, "right"))
                n, least, most = cells[mine[j]]
                out[r] = (least, most, int(ends[j]) - n, n)
        return out

    low = place[each] / _BINS * 3 - 0.5
    cells = counted(of_bins, low, low + 3 / _BINS, max(2, _BINS // len(each)))
    home = homes(cells, {k: int(ends[x]) - found[x + 1]["n"] for k, x in enumerate(each)}, {k: [r for r, x in zip(ranks, bins, strict=True) if x == each[k]] for k in range(len(each))})
    while True:
        wide = sorted({h for h in home.values() if h[0] < h[1]})
        low, high = np.array([h[0] for h in wide]), np.array([h[1] for h in wide])
        if sum(h[3] for h in wide) <= few or not wide:
            break
        cells = counted(within(low, high), low, high, max(2, _BINS // len(wide)))
        finer = homes(cells, {k: h[2] for k, h in enumerate(wide)}, {k: [r for r in ranks if home[r] == h] for k, h in enumerate(wide)})
        if all(finer[r] == home[r] for r in finer):  # neighbouring numbers can't be parted further
            break
        home |= finer
    value = {r: h[0] for r, h in home.items() if h[0] == h[1]}
    if wide:

        def pick(read, i, js):
            held, choose = [], within(low, high)
            for d in tiles(read, i, js):
                held.append(choose(d)[0])
            v, times = np.unique(np.concatenate(held) if held else np.zeros(0), return_counts=True)
            yield pa.table({"d": pa.array(v), "n": pa.array(times, pa.int64())})

        table = kept.tasks(jobs, "d double, n bigint", pick).groupBy("d").agg(F.sum("n").alias("n")).toArrow().sort_by("d")
        d, times = table.column("d").to_numpy(), table.column("n").to_numpy()
        for r in ranks:
            if r not in value:
                least, most, before, _ = home[r]
                mine = (d >= least) & (d <= most)
                value[r] = float(d[mine][np.searchsorted(np.cumsum(times[mine]), r - before, "right")])
    kept.drop()
    percentile = [value[int(at[p])] + (value[min(total - 1, int(at[p]) + 1)] - value[int(at[p])]) * (at[p] - int(at[p])) for p in PERCENTILES]
    return spark.createDataFrame([(total, float(mean), float(std), found[0]["a"], found[0]["b"], *map(float, percentile))], schema)


def thresholds(stats: DataFrame, config: ThresholdConfig = ThresholdConfig(), rows: int | None = None) -> DataFrame:
    """One row: merge, split, review and reassign thresholds. Fixed values count as they are; reassign is twice merge. With too few rows, or disabled, the defaults."""
    if not config.enabled or (rows is not None and rows < config.least_rows):
        return stats.sparkSession.createDataFrame([(config.default_merge, config.default_split, config.default_review, 2 * config.default_merge)], "merge_threshold double, split_threshold double, review_threshold double, reassign_threshold double")

    def chosen(fixed: float | None, adaptive: Column) -> Column:
        return F.coalesce(F.lit(fixed).cast("double"), adaptive)

    merge = chosen(config.fixed_merge, clip(F.col("mean") - 1.5 * F.col("std"), 0.1, 0.5))
    split, review = chosen(config.fixed_split, clip(F.col("p75"), 0.4, 1.2)), chosen(config.fixed_review, clip(F.col("p15"), 0.2, 0.7))
    return stats.select(merge.alias("merge_threshold"), split.alias("split_threshold"), review.alias("review_threshold"), (merge * 2).alias("reassign_threshold"))


def threshold_report(stats: DataFrame, config: ThresholdConfig = ThresholdConfig()) -> DataFrame:
    """One row: report, a JSON text with statistics and thresholds."""
    both = stats.crossJoin(thresholds(stats, config))
    s, t = [c for c in stats.columns], ["merge_threshold", "split_threshold", "review_threshold", "reassign_threshold"]
    return both.select(F.to_json(F.struct(F.lit(config.enabled).alias("enabled"), F.struct(*s).alias("statistics"), F.struct(*t).alias("thresholds"))).alias("report"))
