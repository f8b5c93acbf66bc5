"""Known identities: classification of faces, learning from corrections, merging into what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.scalars import person_name
from kinweave.functions.vectors import double, l2_normalize, vector_mean
from kinweave.operators.graph import numbered
from kinweave.operators.similarity import nearest


def classify_known(faces: DataFrame, identities: DataFrame, threshold: float = 0.4, *, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """(id, pos, distance): the position of the nearest identity if it is nearer than threshold, else null. identities: (pos, identity_id, centroid)."""
    found = nearest(faces, identities, id_col=id_col, vec_col=vec_col, key_col="pos", target_col="centroid")
    return found.select(id_col, F.when(F.col("distance") < threshold, F.col("pos")).alias("pos"), "distance")


def learn(faces: DataFrame, corrections: DataFrame, *, id_col: str = "id", vec_col: str = "emb") -> DataFrame:
    """(pos, identity_id, label, n, centroid) from corrections (id, label) with label >= 0 of faces that exist: the unit mean vector of each label, in label order."""
    own = faces.join(corrections.filter("label >= 0").select(id_col, F.col("label").alias("__label")), id_col).select(F.col("__label").alias("label"), F.col(vec_col).alias("__v"))
    means = numbered(vector_mean(own, "label", "__v"), "label", "pos")
    return means.select(F.col("pos").cast("int").alias("pos"), person_name(F.col("label")).alias("identity_id"), "label", "n", l2_normalize(F.col("centroid")).alias("centroid"))


def merge_identities(known: DataFrame, learned: DataFrame, threshold: float = 0.3) -> DataFrame:
    """known with learned upserted: a learned identity nearer than threshold to one of the original centroids is averaged into it (unit length again; several in label order), any other is added.
    (pos, identity_id, centroid); new positions follow the old ones in label order."""
    found = nearest(learned, known, id_col="label", vec_col="centroid", key_col="pos", target_col="centroid").filter(F.col("distance") < threshold)
    hits = learned.select("label", F.col("centroid").alias("new")).join(found.select("label", "pos"), "label")
    folded = hits.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("label", "new"))).alias("news"))
    base = known.join(folded, "pos", "left")
    average = lambda acc, s: l2_normalize(F.zip_with(acc, s["new"], lambda a, b: (a + b) / 2))
    updated = base.select("pos", "identity_id", F.when(F.col("news").isNull(), double(F.col("centroid"))).otherwise(F.aggregate("news", double(F.col("centroid")), average)).alias("centroid"))
    rest = learned.join(found.select("label"), "label", "left_anti")
    start = known.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    added = numbered(rest, "label", "nth").select((F.col("nth") + start).cast("int").alias("pos"), "identity_id", double(F.col("centroid")).alias("centroid"))
    return updated.unionByName(added)


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """current with changes written over it by key; of several changes of a key the one with the largest order. Both have the same columns."""
    rows = current.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__side"), F.desc(order)))
    return rows.withColumn("__rn", last).filter("__rn = 1").drop("__rn", "__side")


def next_label(*labels: DataFrame) -> DataFrame:
    """One row: the label after the largest in all given tables, 0 if there is none."""
    union = labels[0].select("label")
    for x in labels[1:]:
        union = union.unionByName(x.select("label"))
    return union.agg(F.coalesce(F.max("label") + 1, F.lit(0)).cast("int").alias("next_label"))


def combine(faces: DataFrame, known: DataFrame, clustered: DataFrame, *, id_col: str = "id", known_probability: float = 0.95) -> DataFrame:
    """(id, label, probability): known faces keep their position, clustered labels from 0 on are moved behind the largest known one, all others are noise (-1, 0)."""
    hit = known.filter("pos IS NOT NULL").select(id_col, "pos")
    offset = hit.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("offset"))
    rows = faces.select(id_col).join(hit, id_col, "left").join(clustered.select(id_col, F.col("label").alias("__l"), F.col("probability").alias("__p")), id_col, "left").crossJoin(F.broadcast(offset))
    moved = F.when(F.col("__l") >= 0, F.col("__l") + F.col("offset")).otherwise(F.coalesce(F.col("__l"), F.lit(-1)))
    return rows.select(id_col, F.coalesce("pos", moved).cast("int").alias("label"), F.when(F.col("pos").isNotNull(), F.lit(known_probability)).otherwise(F.coalesce("__p", F.lit(0.0))).alias("probability"))


def update_labels(metadata: DataFrame, assigned: DataFrame, *, id_col: str = "id") -> DataFrame:
    """metadata with cluster_label and cluster_confidence of assigned (id, label, confidence); rows without an assignment keep theirs, and no row is added."""
    new = assigned.select(id_col, F.col("label").alias("__l"), F.col("confidence").alias("__c"))
    rest = [c for c in metadata.columns if c not in ("cluster_label", "cluster_confidence")]
    old = lambda c, kind: F.col(c) if c in metadata.columns else F.lit(None).cast(kind)
    return metadata.join(new, id_col, "left").select(*rest, F.coalesce("__l", old("cluster_label", "int")).alias("cluster_label"), F.coalesce("__c", old("cluster_confidence", "double")).alias("cluster_confidence"))
