"""Density clustering: DBSCAN and hierarchical density clustering (excess of mass), membership probabilities, summary, and the dispatch between both."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scalars import clip, safe_ratio
from kinweave.functions.vectors import cosine_distance, double, euclidean_distance, vector_mean
from kinweave.operators import hierarchy
from kinweave.operators.graph import components, cut, numbered, spanning
from kinweave.operators.similarity import BLOCK, distances, pair_blocks


@dataclass(frozen=True)
class ClusterConfig:
    min_cluster_size: int = 2
    min_samples: int = 1
    eps: float = 0.5
    db_min_samples: int = 2
    noise_fallback_ratio: float = 0.6
    fallback: str | None = "dbscan"
    #: Rows up to which a hierarchy is built in one task; more go through rounds of joins.
    one_task: int = 8192


def linked(points: DataFrame, eps: float, *, block: int = BLOCK) -> DataFrame:
    """(id, component): the smallest id reachable from each of points (id bigint, v) by steps of at most eps. Of each pair of blocks a spanning set of links leaves the task."""

    def links(ia, va, ib, vb, same):
        x, y = np.nonzero(distances(va, vb, "euclidean") <= eps)
        ids = ia if same else np.concatenate((ia, ib))
        a, b = spanning(len(ids), x, y if same else y + len(ia))
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    points = cut(points)
    return components(points.select("id"), pair_blocks(points, "id", "v", "a bigint, b bigint", links, block, within=eps, then=lambda f: f))


def dbscan(rows: DataFrame, eps: float = 0.5, min_samples: int = 2, *, id_col: str = "id", vec_col: str = "emb", block: int = BLOCK) -> DataFrame:
    """(id, label): core rows have min_samples rows within eps, themselves included; labels number the connected sets of core rows by their smallest id; a border row joins the smallest of its
    neighbours' labels; -1 is noise.

    Three passes over the pairs of blocks that may hold rows within eps: numbers of neighbours, links between core rows (of each pair of blocks a spanning set), and border rows' labels. No pair leaves a task, so dense data send as much as sparse."""
    points = cut(rows.select(F.col(id_col).cast("bigint").alias("id"), double(F.col(vec_col)).alias("v")))
    within = lambda va, vb: distances(va, vb, "euclidean") <= eps

    def degrees(ia, va, ib, vb, same):
        near = within(va, vb)
        if same:
            return pa.table({"id": pa.array(ia), "n": pa.array(near.sum(1))})
        return pa.table({"id": pa.array(np.concatenate((ia, ib))), "n": pa.array(np.concatenate((near.sum(1), near.sum(0))))})

    degree = pair_blocks(points, "id", "v", "id bigint, n bigint", degrees, block, within=eps, then=lambda f: f.groupBy("id").agg(F.sum("n").alias("n")))
    core = cut(degree.filter(F.col("n") >= min_samples).select("id"))

    parts = linked(points.join(core, "id", "left_semi"), eps, block=block)
    names = numbered(parts.select("component").distinct(), "component", "label")
    cores = cut(parts.join(names, "component").select("id", F.col("label").cast("int").alias("label")))
    labelled = points.join(cores, "id", "left").select("id", F.concat("v", F.array(F.coalesce("label", F.lit(-1)).cast("double"))).alias("v"))

    def borders(ia, va, ib, vb, same):
        near, out = within(va[:, :-1], vb[:, :-1]), []
        for ids, mine, theirs, m in ((ia, va[:, -1], vb[:, -1], near), (ib, vb[:, -1], va[:, -1], near.T))[: 1 if same else 2]:
            least = np.where(m & (theirs >= 0)[None, :], theirs[None, :], np.inf).min(1, initial=np.inf)
            keep = (mine < 0) & np.isfinite(least)
            out.append(pa.table({"id": pa.array(ids[keep]), "label": pa.array(least[keep].astype(np.int64))}))
        return pa.concat_tables(out)

    border = pair_blocks(labelled, "id", "v", "id bigint, label bigint", borders, block, within=eps, extra=1, then=lambda f: f.groupBy("id").agg(F.min("label").cast("int").alias("near")))
    ids = rows.select(F.col(id_col).alias("id"))
    return ids.join(cores, "id", "left").join(border, "id", "left").select("id", F.coalesce("label", "near", F.lit(-1)).cast("int").alias("label"))


def centroid_probability(rows: DataFrame, *, metric: str = "euclidean", id_col: str = "id", vec_col: str = "emb", label_col: str = "label", noise: float = 0.05) -> DataFrame:
    """(id, label, probability): clip(1 - d / (1.5 * max(largest d of the label, 1e-6)), 0.1, 1) with d the distance to the label's mean vector; noise gets `noise`. The largest distance is a
    grouped maximum joined back, so a label may have any share of the rows."""
    distance = euclidean_distance if metric == "euclidean" else cosine_distance
    own = rows.filter(F.col(label_col) >= 0).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), double(F.col(vec_col)).alias("v"))
    d = own.join(vector_mean(own, "label", "v").select("label", "centroid"), "label").select("id", "label", distance(F.col("v"), F.col("centroid")).alias("d"))
    widest = d.groupBy("label").agg(F.greatest(F.max("d"), F.lit(1e-6)).alias("w"))
    found = d.join(widest, "label").select("id", "label", clip(1.0 - F.col("d") / (F.col("w") * 1.5), 0.1, 1.0).alias("probability"))
    rest = rows.filter(F.col(label_col) < 0).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.lit(noise).alias("probability"))
    return found.unionByName(rest)


def summary(rows: DataFrame) -> DataFrame:
    """One row: n_faces, n_clusters, n_noise, noise_ratio, avg_probability of rows (label, probability)."""
    one = rows.agg(F.count("*").alias("n_faces"), F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), F.count_if(F.col("label") < 0).alias("n_noise"), F.avg("probability").alias("avg_probability"))
    return one.select("n_faces", "n_clusters", "n_noise", safe_ratio(F.col("n_noise"), F.col("n_faces")).alias("noise_ratio"), "avg_probability")


def sizes(rows: DataFrame) -> DataFrame:
    return rows.filter("label >= 0").groupBy("label").agg(F.count("*").alias("n"))


def hdbscan(rows: DataFrame, config: ClusterConfig = ClusterConfig(), *, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """(id, label, probability): hierarchical density clustering, see hierarchy."""
    found = hierarchy.grid(rows, [config.min_cluster_size], [config.min_samples], id_col=id_col, vec_col=vec_col, one_task=config.one_task)
    return found.select("id", "label", "probability")


def cluster(rows: DataFrame, config: ClusterConfig = ClusterConfig(), *, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """(id, label, probability): no row gives none, one row is label 0 with probability 1; hierarchical clustering otherwise, and DBSCAN instead if that leaves more noise than allowed."""
    spark = rows.sparkSession
    some = rows.select(F.col(id_col).cast("bigint").alias("id")).limit(2).collect()
    if len(some) < 2:
        return spark.createDataFrame([(r["id"], 0, 1.0) for r in some], "id bigint, label int, probability double")
    found = cut(hdbscan(rows, config, id_col=id_col, vec_col=vec_col))
    if summary(found).first()["noise_ratio"] > config.noise_fallback_ratio and config.fallback == "dbscan":
        labels = dbscan(rows, config.eps, config.db_min_samples, id_col=id_col, vec_col=vec_col)
        return centroid_probability(rows.join(labels.withColumnRenamed("id", id_col), id_col), id_col=id_col, vec_col=vec_col)
    return found
