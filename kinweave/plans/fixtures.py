"""Views over the test tables that stand for faces, detections, images and ground truth, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.scalars import content_hash
from kinweave.functions.vectors import double, l2_normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", double(F.col("embedding")).alias("emb"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, emb) with planted clusters: each label's first vector, plus three tenths of the own one, of length one."""
    rows = raw(spark, sf_dir)
    anchor = rows.groupBy("label").agg(F.min_by("emb", "id").alias("av"))
    v = F.zip_with("av", "emb", lambda x, y: x + F.lit(0.3) * y)
    return rows.join(F.broadcast(anchor), "label").select("id", "label", l2_normalize(v).alias("emb"))  # one row per label


DETECTIONS = """
    WITH b AS (
      SELECT vec_id, vec_id % 125 AS img, CAST((vec_id*37)%200 AS DOUBLE) AS x1, CAST((vec_id*41)%200 AS DOUBLE) AS y1, CAST(10+(vec_id*53)%150 AS DOUBLE) AS w, CAST(10+(vec_id*71)%150 AS DOUBLE) AS h,
             CAST((vec_id*13)%101-50 AS DOUBLE)/CAST(100 AS DOUBLE) AS jx, CAST((vec_id*19)%121-60 AS DOUBLE)/CAST(100 AS DOUBLE) AS jy,
             CAST(30+(vec_id*29)%70 AS DOUBLE)/CAST(100 AS DOUBLE) AS det_score, CAST((vec_id*97)%400 AS DOUBLE) AS lap_var
      FROM embeddings)
    SELECT vec_id, img, x1, y1, x1+w AS x2, y1+h AS y2, det_score, lap_var, x1+w*CAST(0.3 AS DOUBLE) AS lex, y1+h*CAST(0.35 AS DOUBLE) AS ley,
           x1+w*CAST(0.7 AS DOUBLE) AS rex, y1+h*CAST(0.35 AS DOUBLE)+jy*h AS rey, x1+w*CAST(0.5 AS DOUBLE)+jx*w AS nx, y1+h*CAST(0.6 AS DOUBLE) AS ny
    FROM b
"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETECTIONS.replace("FROM embeddings", "FROM {e}"), e=table(spark, sf_dir, "embeddings"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".pdf", ".webp"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/photos/"), "source", F.lit("/"), (F.col("doc_id") % 400).cast("string"), ext)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("image_path"), content_hash(F.col("text")).alias("image_hash"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id").cast("string")
    key = F.when(F.col("id") % 3 == 0, F.concat(F.lit("f"), i)).when(F.col("id") % 3 == 1, F.concat(F.lit("/photos/p"), i, F.lit(".jpg"))).otherwise(F.concat(F.lit("p"), i, F.lit(".jpg")))
    label = F.when(F.col("id") % 7 == 0, ((F.col("label") + 1) % 10).cast("int")).otherwise(F.col("label"))
    return raw(spark, sf_dir).filter(F.col("id") % 11 != 0).select(key.alias("key"), label.alias("gt_label"))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """faces with face_id and image_path as in truth."""
    i = F.col("id").cast("string")
    return raw(spark, sf_dir).select("id", F.concat(F.lit("f"), i).alias("face_id"), F.concat(F.lit("/photos/p"), i, F.lit(".jpg")).alias("image_path"), "label")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """faces with every thirteenth made noise, and a probability."""
    return faces(spark, sf_dir).withColumns({"label": F.when(F.col("id") % 13 == 0, F.lit(-1)).otherwise(F.col("label")).cast("int"), "probability": (F.lit(50.0) + F.col("id") % 51) / F.lit(100.0)})


#: DuckDB: common table expressions of the same.
FACES = """
    anchor AS (SELECT label, arg_min(embedding, vec_id) AS av FROM embeddings GROUP BY label),
    planted AS (SELECT e.vec_id AS id, e.label, list_transform(list_zip(av::DOUBLE[], e.embedding::DOUBLE[]), lambda p: p[1]+0.3::DOUBLE*p[2]) AS v FROM embeddings e JOIN anchor USING (label)),
    faces AS (SELECT id, label, list_transform(v, lambda x: x/sqrt(list_dot_product(v,v))) AS emb FROM planted)"""
LABELLED = FACES + """,
    labelled AS (SELECT id, emb, (CASE WHEN id % 13 = 0 THEN -1 ELSE label END)::INT AS label, (50.0::DOUBLE + id % 51) / 100.0::DOUBLE AS probability FROM faces)"""
CENTROIDS = """,
    cells AS (SELECT label, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM {rows} WHERE label >= 0),
    means AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY label, pos),
    centroids AS (SELECT label, list(m ORDER BY pos) AS c FROM means GROUP BY label)"""
IMAGES = """
    images AS (SELECT doc_id, concat('/photos/', source, '/', CAST(doc_id % 400 AS VARCHAR), CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.pdf' ELSE '.webp' END) AS image_path, sha256(text) AS image_hash FROM documents)"""
TRUTH = """
    truth AS (SELECT CASE vec_id % 3 WHEN 0 THEN concat('f', CAST(vec_id AS VARCHAR)) WHEN 1 THEN concat('/photos/p', CAST(vec_id AS VARCHAR), '.jpg') ELSE concat('p', CAST(vec_id AS VARCHAR), '.jpg') END AS key,
        CASE WHEN vec_id % 7 = 0 THEN CAST((label+1)%10 AS INT) ELSE label END AS gt_label FROM embeddings WHERE vec_id % 11 <> 0),
    named AS (SELECT vec_id AS id, concat('f', CAST(vec_id AS VARCHAR)) AS face_id, concat('/photos/p', CAST(vec_id AS VARCHAR), '.jpg') AS image_path, label FROM embeddings)"""
