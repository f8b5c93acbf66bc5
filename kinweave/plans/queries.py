"""One query per operator over the test tables, each with its SQL where SQL can express it. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.functions import vectors as V
from kinweave.operators import clustering, evaluate, identities, quality, refine, report, similarity, thresholds
from kinweave.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded, and never -0.0."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out


def q6(x: str) -> str:
    return f"(round({x}, 6) + 0.0::DOUBLE)"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def cells(df: DataFrame, key: str, vec: str, *more: str) -> DataFrame:
    """A vector column as one row per element."""
    return df.select(key, *more, F.posexplode(vec).alias("pos", "x")).select(key, *more, (F.col("pos") + 1).cast("bigint").alias("pos"), r6("x"))


UNNEST = "unnest({v}) AS x, generate_subscripts({v}, 1)::BIGINT AS pos"


# --- scalar functions

@query("SELECT doc_id, sha256(text) AS image_hash FROM documents")
def content_hash(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", S.content_hash(F.col("text")).alias("image_hash"))


@query("SELECT doc_id, concat(substr(sha256(text), 1, 16), '_', lpad(CAST(doc_id % 50 AS VARCHAR), 3, '0')) AS face_id FROM documents")
def face_id(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", S.face_id(S.content_hash(F.col("text")), F.col("doc_id") % 50).alias("face_id"))


@query("WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM n), c AS (SELECT vec_id, " + UNNEST.format(v="u") + f" FROM u) SELECT vec_id, pos, {q6('x')} AS x FROM c")
def l2_normalize(spark, sf):
    rows = X.table(spark, sf, "embeddings").select("vec_id", F.transform(V.double(F.col("embedding")), lambda x: x * 3).alias("v"))
    return cells(rows.select("vec_id", V.l2_normalize(F.col("v")).alias("u")), "vec_id", "u")


_FIRST = "SELECT e.vec_id, {f} AS distance FROM embeddings e, (SELECT embedding AS f FROM embeddings ORDER BY vec_id LIMIT 1)"


def _to_first(spark, sf, distance):
    rows = X.raw(spark, sf)
    first = rows.agg(F.min_by("emb", "id").alias("f"))
    return rows.crossJoin(F.broadcast(first)).select(F.col("id").alias("vec_id"), r6(distance(F.col("emb"), F.col("f")), "distance"))


@query(_FIRST.format(f=q6("list_cosine_distance(e.embedding::DOUBLE[], f::DOUBLE[])")))
def cosine_distance(spark, sf):
    return _to_first(spark, sf, V.cosine_distance)


@query(_FIRST.format(f=q6("list_distance(e.embedding::DOUBLE[], f::DOUBLE[])")))
def euclidean_distance(spark, sf):
    return _to_first(spark, sf, V.euclidean_distance)


_QUALITY = f"""
    WITH d AS ({X.DETECTIONS}),
    g AS (SELECT *, x2-x1 AS width, y2-y1 AS height, sqrt((rex-lex)*(rex-lex)+(rey-ley)*(rey-ley)) AS apart FROM d),
    p AS (SELECT *, least(width, height) AS m, abs(nx-(lex+rex)/2)/apart AS ratio, abs(degrees(atan2(rey-ley, rex-lex))) AS tilt FROM g),
    s AS (SELECT *, (CASE WHEN m < 20 THEN 0.0 WHEN m < 40 THEN 0.3 WHEN m < 80 THEN 0.7 ELSE 1.0 END)::DOUBLE AS size_score,
        (CASE WHEN lap_var < 15 THEN 0.1 WHEN lap_var < 50 THEN 0.5 WHEN lap_var < 150 THEN 0.8 ELSE 1.0 END)::DOUBLE AS blur_score,
        (CASE WHEN apart < 1e-6 THEN 0.1 WHEN ratio > 0.5::DOUBLE OR tilt > 75 THEN 0.1 WHEN ratio > 0.3::DOUBLE OR tilt > 45 THEN 0.4 WHEN ratio > 0.15::DOUBLE OR tilt > 20 THEN 0.7 ELSE 1.0 END)::DOUBLE AS pose_score,
        (CASE WHEN width < 1 OR height < 1 THEN 0.0 WHEN width/height BETWEEN 0.6::DOUBLE AND 1.4::DOUBLE THEN 1.0 WHEN width/height BETWEEN 0.4::DOUBLE AND 1.8::DOUBLE THEN 0.6 ELSE 0.2 END)::DOUBLE AS aspect_score FROM p),
    c AS (SELECT *, size_score*0.25::DOUBLE + blur_score*0.25::DOUBLE + pose_score*0.2::DOUBLE + least(det_score, 1.0::DOUBLE)*0.2::DOUBLE + aspect_score*0.1::DOUBLE AS composite,
        list_filter([CASE WHEN size_score < 0.5 THEN 'size' END, CASE WHEN blur_score < 0.3 THEN 'blur' END, CASE WHEN pose_score < 0.3 THEN 'pose' END, CASE WHEN det_score < 0.3 THEN 'confidence' END, CASE WHEN aspect_score < 0.3 THEN 'aspect' END], lambda x: x IS NOT NULL) AS reasons FROM s),
    q AS (SELECT *, len(reasons) = 0 AS passed FROM c)
"""


def _scored(spark, sf):
    return quality.scored(X.detections(spark, sf))


@query(_QUALITY + "SELECT vec_id, size_score FROM q")
def quality_size(spark, sf):
    return _scored(spark, sf).select("vec_id", "size_score")


@query(_QUALITY + "SELECT vec_id, blur_score FROM q")
def quality_blur(spark, sf):
    return _scored(spark, sf).select("vec_id", "blur_score")


@query(_QUALITY + "SELECT vec_id, pose_score FROM q")
def quality_pose(spark, sf):
    return _scored(spark, sf).select("vec_id", "pose_score")


@query(_QUALITY + "SELECT vec_id, aspect_score FROM q")
def quality_aspect(spark, sf):
    return _scored(spark, sf).select("vec_id", "aspect_score")


@query(_QUALITY + f"SELECT vec_id, {q6('composite')} AS composite FROM q")
def quality_composite(spark, sf):
    return _scored(spark, sf).select("vec_id", r6("composite"))


@query(_QUALITY + "SELECT vec_id, array_to_string(reasons, ',') AS reasons, passed FROM q")
def quality_reasons(spark, sf):
    return _scored(spark, sf).select("vec_id", F.array_join("reasons", ",").alias("reasons"), "passed")


@query(_QUALITY + f"SELECT vec_id, {q6('CASE WHEN passed THEN 1.0 ELSE greatest(0.2::DOUBLE, composite) END')} AS penalty FROM q")
def confidence_penalty(spark, sf):
    return _scored(spark, sf).select("vec_id", r6(S.confidence_penalty(F.col("passed"), F.col("composite")), "penalty"))


@query(_QUALITY + f"SELECT vec_id, {q6('composite')} AS composite FROM q WHERE NOT (NOT passed AND composite < 0.5)")
def quality_gate(spark, sf):
    """With the gate at 0.5, where it bites on these rows."""
    return quality.gate(_scored(spark, sf), 0.5).select("vec_id", r6("composite"))


@query(f"WITH d AS ({X.DETECTIONS}) SELECT vec_id, det_score FROM d WHERE det_score >= 0.5::DOUBLE")
def det_filter(spark, sf):
    return X.detections(spark, sf).filter(F.col("det_score") >= 0.5).select("vec_id", "det_score")


@query(f"WITH d AS ({X.DETECTIONS}) SELECT vec_id, x2-x1 AS width, y2-y1 AS height, (x2-x1)*(y2-y1) AS area, least(x2-x1, y2-y1) AS min_side FROM d")
def bbox_geometry(spark, sf):
    return quality.geometry(X.detections(spark, sf)).select("vec_id", "width", "height", "area", "min_side")


@query(f"WITH d AS ({X.DETECTIONS}) SELECT vec_id, greatest(0, trunc(x1-20.5)::INT) AS cx1, greatest(0, trunc(y1-20.5)::INT) AS cy1, least(250, trunc(x2-20.5)::INT) AS cx2, least(220, trunc(y2-20.5)::INT) AS cy2 FROM d")
def bbox_clamp(spark, sf):
    moved = X.detections(spark, sf).withColumns({c: F.col(c) - 20.5 for c in ("x1", "y1", "x2", "y2")})
    return quality.clamp(moved, 250, 220).select("vec_id", "cx1", "cy1", "cx2", "cy2")


@query(f"WITH d AS ({X.DETECTIONS}), r AS (SELECT img, vec_id, det_score, (row_number() OVER (PARTITION BY img ORDER BY det_score DESC, vec_id) - 1)::INT AS face_index FROM d) SELECT img, vec_id, face_index FROM r WHERE face_index < 3 AND det_score >= 0.5::DOUBLE")
def face_index(spark, sf):
    return quality.rank_faces(X.detections(spark, sf), most=3).select("img", "vec_id", "face_index")


@query(f"WITH d AS ({X.DETECTIONS}) SELECT vec_id, CASE WHEN det_score > 0.65::DOUBLE THEN 'high' WHEN det_score > 0.35::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM d")
def confidence_band(spark, sf):
    return X.detections(spark, sf).select("vec_id", S.confidence_band(F.col("det_score")).alias("band"))


_TARGET = (38.2946, 51.6963, 73.5318, 51.5014)  # fixed values: the template's eye positions in a crop of 112 pixels


@query(f"""
    WITH d AS ({X.DETECTIONS}), e AS (SELECT vec_id, lex, ley, rex, rey, sqrt((rex-lex)*(rex-lex)+(rey-ley)*(rey-ley)) AS n,
        atan2(51.5014::DOUBLE-51.6963::DOUBLE, 73.5318::DOUBLE-38.2946::DOUBLE)-atan2(rey-ley, rex-lex) AS t, sqrt(pow(73.5318::DOUBLE-38.2946::DOUBLE, 2)+pow(51.5014::DOUBLE-51.6963::DOUBLE, 2)) AS m FROM d),
    f AS (SELECT *, m/n*cos(t) AS a, m/n*sin(t) AS b FROM e)
    SELECT vec_id, {q6('a')} AS m00, {q6('-b')} AS m01, {q6('(38.2946::DOUBLE+73.5318::DOUBLE)/2 - (a*(lex+rex)/2 - b*(ley+rey)/2)')} AS m02, {q6('b')} AS m10, {q6('a')} AS m11, {q6('(51.6963::DOUBLE+51.5014::DOUBLE)/2 - (b*(lex+rex)/2 + a*(ley+rey)/2)')} AS m12 FROM f""")
def similarity_transform(spark, sf):
    found = S.similarity_transform([F.col(c) for c in ("lex", "ley", "rex", "rey")], list(_TARGET))
    return X.detections(spark, sf).select("vec_id", *[r6(c, n) for c, n in zip(found, ("m00", "m01", "m02", "m10", "m11", "m12"), strict=True)])


@query(f"""
    WITH d AS ({X.DETECTIONS}), e AS (SELECT vec_id, (lex+rex+nx)/3 AS mx, (ley+rey+ny)/3 AS my, nx, ny FROM d)
    SELECT vec_id, {q6('((nx-mx)*cos(radians(5.0)) - (ny-my)*sin(radians(5.0)))*1.05::DOUBLE + mx')} AS px, {q6('((nx-mx)*sin(radians(5.0)) + (ny-my)*cos(radians(5.0)))*1.05::DOUBLE + my')} AS py FROM e""")
def perturb_landmarks(spark, sf):
    mx, my = (F.col("lex") + F.col("rex") + F.col("nx")) / 3, (F.col("ley") + F.col("rey") + F.col("ny")) / 3
    x, y = S.perturb_point(F.col("nx"), F.col("ny"), mx, my, 5.0, 1.05)
    return X.detections(spark, sf).select("vec_id", r6(x, "px"), r6(y, "py"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf):
    return X.table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT vec_id, CASE WHEN label - 2 >= 0 THEN 'Person_' || lpad(CAST(label - 2 AS VARCHAR), 3, '0') ELSE 'noise' END AS name, CASE WHEN label - 2 >= 0 THEN label - 2 END AS parsed FROM embeddings")
def person_name(spark, sf):
    rows = X.table(spark, sf, "embeddings").select("vec_id", S.person_name(F.col("label") - 2).alias("name"))
    return rows.select("vec_id", "name", S.person_number(F.col("name")).alias("parsed"))


@query("SELECT event_id, (event_id % 14)::INT AS step, floor((event_id % 14) * 100.0::DOUBLE / 13)::INT AS percent FROM events")
def progress_pct(spark, sf):
    step = (F.col("event_id") % 14).cast("int")
    return X.table(spark, sf, "events").select("event_id", step.alias("step"), S.progress_percent(step).alias("percent"))


_LINE = "CASE event_id % 4 WHEN 0 THEN '12:00 | INFO     | ' WHEN 1 THEN '12:00 | WARNING  | ' WHEN 2 THEN '12:00 | ERROR    | ' ELSE '12:00 DEBUG ' END || event_type"


@query(f"WITH l AS (SELECT event_id, {_LINE} AS line FROM events) SELECT event_id, CASE WHEN contains(line, 'ERROR') THEN 'error' WHEN contains(line, 'WARNING') THEN 'warning' WHEN contains(line, '| INFO') THEN 'info' ELSE 'other' END AS level FROM l")
def log_level(spark, sf):
    return X.table(spark, sf, "events").select("event_id", F.expr(_LINE).alias("line")).select("event_id", S.log_level(F.col("line")).alias("level"))


@query("WITH p AS (SELECT page_id, url, list_extract(string_split(url, '/'), -1) AS base FROM pages) SELECT page_id, base, CASE WHEN regexp_matches(base, '^.+\\.[^.]+$') THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS stem, CASE WHEN regexp_matches(base, '^.+\\.[^.]+$') THEN lower(regexp_extract(base, '(\\.[^.]*)$', 1)) ELSE '' END AS suffix FROM p")
def path_parts(spark, sf):
    u = F.col("url")
    return X.table(spark, sf, "pages").select("page_id", S.basename(u).alias("base"), S.stem(u).alias("stem"), S.suffix(u).alias("suffix"))


# --- sources

@query("WITH " + X.IMAGES + " SELECT DISTINCT image_path FROM images WHERE lower(regexp_extract(image_path, '\\.([^./]*)$', 1)) IN ('jpg','jpeg','png','bmp','tiff','tif','webp')")
def scan_images(spark, sf):
    from kinweave.sources.images import with_extension

    return with_extension(X.images(spark, sf), "image_path", S.IMAGE_EXTENSIONS).select("image_path").distinct()


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS filename, length(html) AS size_bytes FROM pages")
def file_info(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", S.basename(F.col("url")).alias("filename"), F.length("html").cast("bigint").alias("size_bytes"))


@query("WITH " + X.IMAGES + ", e AS (SELECT lower(regexp_extract(image_path, '\\.([^./]*)$', 1)) AS ext FROM images) SELECT ext, count(*) AS n FROM e WHERE ext IN ('jpg', 'jpeg', 'png', 'webp') GROUP BY ext")
def list_by_ext(spark, sf):
    from kinweave.sources.images import with_extension

    rows = with_extension(X.images(spark, sf), "image_path", ("jpg", "jpeg", "png", "webp"))
    return rows.groupBy(F.substring(S.suffix(F.col("image_path")), 2, 9).alias("ext")).agg(F.count("*").alias("n"))


@query("WITH " + X.TRUTH + " SELECT key, gt_label FROM truth")
def gt_from_json(spark, sf):
    from kinweave.sources.tables import truth_from_json

    parts = X.truth(spark, sf).groupBy((F.xxhash64("key") % 8).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "gt_label")))).alias("value"))
    return truth_from_json(parts)


# --- incremental runs, joins, upserts

@query("WITH " + X.IMAGES + ", done AS (SELECT DISTINCT image_hash FROM images WHERE doc_id < 500) SELECT doc_id, image_path FROM images WHERE image_hash NOT IN (SELECT image_hash FROM done)")
def incremental_anti(spark, sf):
    from kinweave.sources.images import unprocessed

    rows = X.images(spark, sf)
    return unprocessed(rows, rows.filter("doc_id < 500").select("image_hash")).select("doc_id", "image_path")


@query("WITH " + X.IMAGES + ", done AS (SELECT DISTINCT image_hash FROM images WHERE doc_id < 500) SELECT doc_id FROM images WHERE image_hash IN (SELECT image_hash FROM done)")
def processed_semi(spark, sf):
    from kinweave.sources.images import processed

    rows = X.images(spark, sf)
    return processed(rows, rows.filter("doc_id < 500").select("image_hash")).select("doc_id")


@query("WITH " + X.FACES + " SELECT id, label, (SELECT count(*) FROM faces) AS faces FROM faces WHERE id = 7")
def lookup_face(spark, sf):
    from kinweave.sources.tables import lookup

    return lookup(X.raw(spark, sf).select("id", "label"), "id", 7, "faces")


@query("SELECT vec_id AS id, label FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id < 50")
def append_faces(spark, sf):
    rows = X.raw(spark, sf).select("id", "label")
    return rows.unionByName(rows.filter("id < 50"))


_CORRECTIONS = "SELECT vec_id AS id, ((label + 3) % 10)::INT AS label, vec_id AS seq FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id, (-2)::INT, vec_id + 1 FROM embeddings WHERE vec_id % 15 = 0"


def _corrections(spark, sf):
    rows = X.raw(spark, sf)
    first = rows.filter("id % 5 = 0").select("id", ((F.col("label") + 3) % 10).cast("int").alias("label"), F.col("id").alias("seq"))
    return first.unionByName(rows.filter("id % 15 = 0").select("id", F.lit(-2).cast("int").alias("label"), (F.col("id") + 1).alias("seq")))


@query(f"WITH c AS ({_CORRECTIONS}), b AS (SELECT vec_id AS id, label, (-1)::BIGINT AS seq FROM embeddings UNION ALL SELECT * FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM b) SELECT id, label FROM r WHERE rn = 1")
def upsert_corrections(spark, sf):
    current = X.raw(spark, sf).select("id", "label", F.lit(-1).cast("bigint").alias("seq"))
    return identities.upsert(current, _corrections(spark, sf), "id", "seq").select("id", "label")


@query("WITH m AS (SELECT max(label) AS a FROM embeddings) SELECT (greatest(a, 12) + 1)::INT AS next_label FROM m")
def next_label(spark, sf):
    return identities.next_label(X.raw(spark, sf), spark.createDataFrame([(12,)], "label int"))


@query("SELECT DISTINCT label FROM embeddings")
def distinct_labels(spark, sf):
    return X.raw(spark, sf).select("label").distinct()


@query("WITH " + X.LABELLED + " SELECT DISTINCT label FROM labelled WHERE label <> -1")
def labels_except_noise(spark, sf):
    return X.labelled(spark, sf).filter("label <> -1").select("label").distinct()


@query("WITH " + X.LABELLED + f" SELECT id, label AS cluster_label, CASE WHEN id % 2 = 0 THEN {q6('probability')} END AS cluster_confidence FROM labelled")
def update_labels(spark, sf):
    rows = X.labelled(spark, sf).select("id", F.col("label").alias("cluster_label"))
    new = X.labelled(spark, sf).filter("id % 2 = 0").select("id", "label", r6("probability", "confidence"))
    extra = new.unionByName(spark.createDataFrame([(10**9, 3, 0.5)], "id bigint, label int, confidence double"))
    return identities.update_labels(rows, extra)


@query("WITH " + X.LABELLED + """, k AS (SELECT id, (id % 4)::INT AS pos FROM labelled WHERE id % 6 = 0), o AS (SELECT max(pos) + 1 AS o FROM k)
    SELECT l.id, coalesce(k.pos, CASE WHEN label >= 0 THEN label + o ELSE -1 END)::INT AS label, CASE WHEN k.pos IS NOT NULL THEN 0.95::DOUBLE ELSE """ + q6("probability") + " END AS probability FROM labelled l LEFT JOIN k ON k.id = l.id, o")
def combine_known_unknown(spark, sf):
    rows = X.labelled(spark, sf).select("id", "label", r6("probability"))
    known = rows.filter("id % 6 = 0").select("id", (F.col("id") % 4).cast("int").alias("pos"))
    return identities.combine(rows, known, rows.filter("id % 6 <> 0"))


# --- vectors: centroids, nearest, pairs

@query("WITH " + X.LABELLED + X.CENTROIDS.format(rows="labelled") + f" SELECT label, pos::BIGINT AS pos, {q6('m')} AS x FROM means")
def centroids(spark, sf):
    return cells(V.vector_mean(X.labelled(spark, sf).filter("label >= 0"), "label", "emb"), "label", "centroid")


_KNOWN = "known AS (SELECT (label)::INT AS pos, c AS centroid FROM centroids WHERE label < 6)"


def _known(spark, sf):
    means = V.vector_mean(X.faces(spark, sf), "label", "emb").filter("label < 6")
    return means.select(F.col("label").alias("pos"), S.person_name(F.col("label")).alias("identity_id"), "centroid")


@query("WITH " + X.FACES + X.CENTROIDS.format(rows="faces") + f", {_KNOWN}, d AS (SELECT id, pos, list_cosine_distance(emb, centroid) AS d FROM faces, known), b AS (SELECT id, arg_min(pos, d * 1000 + pos * 1e-9) AS pos, min(d) AS d FROM d GROUP BY id) SELECT id, CASE WHEN d < 0.4 THEN pos END AS pos, {q6('d')} AS distance FROM b")
def classify_known(spark, sf):
    return rounded(identities.classify_known(X.faces(spark, sf), _known(spark, sf), 0.4))


_LEARNED = "corr AS (SELECT id, ((label + 3) % 10)::INT AS label FROM faces WHERE id % 5 = 0), lc AS (SELECT corr.label, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM corr JOIN faces USING (id)), lm AS (SELECT label, pos, avg(x) AS m FROM lc GROUP BY label, pos), ln AS (SELECT label, list(m ORDER BY pos) AS v FROM lm GROUP BY label), learned AS (SELECT label, list_transform(v, lambda x: x/sqrt(list_dot_product(v, v))) AS centroid FROM ln)"


def _learned(spark, sf):
    changes = X.faces(spark, sf).filter("id % 5 = 0").select("id", ((F.col("label") + 3) % 10).cast("int").alias("label"))
    return identities.learn(X.faces(spark, sf).drop("label"), changes)


@query("WITH " + X.FACES + f", {_LEARNED}, c AS (SELECT label, " + UNNEST.format(v="centroid") + f" FROM learned) SELECT 'Person_' || lpad(CAST(label AS VARCHAR), 3, '0') AS identity_id, pos, {q6('x')} AS x FROM c")
def learn_centroids(spark, sf):
    return cells(_learned(spark, sf), "identity_id", "centroid")


@query("WITH " + X.FACES + X.CENTROIDS.format(rows="faces") + f", {_KNOWN}, {_LEARNED}" + """,
    near AS (SELECT label, arg_min(pos, d) AS pos, min(d) AS d FROM (SELECT l.label, k.pos, list_cosine_distance(l.centroid, k.centroid) AS d FROM learned l, known k) GROUP BY label),
    upd AS (SELECT k.pos, CASE WHEN l.label IS NULL THEN k.centroid ELSE list_transform(list_zip(k.centroid, l.centroid), lambda p: (p[1]+p[2])/2) END AS v, l.label IS NULL AS same FROM known k LEFT JOIN near n ON n.pos = k.pos AND n.d < 0.3 LEFT JOIN learned l ON l.label = n.label),
    ins AS (SELECT l.label, l.centroid, (5 + row_number() OVER (ORDER BY l.label))::INT AS pos FROM learned l JOIN near n USING (label) WHERE NOT n.d < 0.3),
    alls AS (SELECT pos, CASE WHEN same THEN v ELSE list_transform(v, lambda x: x/sqrt(list_dot_product(v, v))) END AS c FROM upd UNION ALL SELECT pos, centroid FROM ins),
    x AS (SELECT pos AS identity, """ + UNNEST.format(v="c") + f" FROM alls) SELECT identity, pos, {q6('x')} AS x FROM x")
def merge_identities(spark, sf):
    merged = identities.merge_identities(_known(spark, sf), _learned(spark, sf), 0.3)
    return cells(merged.select(F.col("pos").alias("identity"), "centroid"), "identity", "centroid")


@query("WITH " + X.LABELLED + X.CENTROIDS.format(rows="labelled") + f", d AS (SELECT id, c.label AS l, list_cosine_distance(emb, c) AS d FROM labelled x, centroids c WHERE x.label = -1), b AS (SELECT id, arg_min(l, d) AS l, min(d) AS d FROM d GROUP BY id) SELECT x.id, (CASE WHEN b.d < 0.1 THEN b.l ELSE x.label END)::INT AS label FROM labelled x LEFT JOIN b USING (id)")
def reassign_noise(spark, sf):
    return refine.reassign_noise(X.labelled(spark, sf), 0.1).select("id", "label")


_PAIRS = "WITH " + X.FACES + ", pairs AS (SELECT a.id AS a, b.id AS b, list_cosine_distance(a.emb, b.emb) AS distance FROM faces a JOIN faces b ON a.id < b.id)"


@query(_PAIRS + f" SELECT a, b, {q6('distance')} AS distance FROM pairs")
def pairwise_cosine(spark, sf):
    return rounded(similarity.pairwise(X.faces(spark, sf)))


@query("WITH " + X.FACES + f" SELECT a.id AS a, b.id AS b, {q6('list_distance(a.emb, b.emb)')} AS distance FROM faces a JOIN faces b ON a.id < b.id WHERE list_distance(a.emb, b.emb) <= 0.4")
def eps_neighbors(spark, sf):
    return rounded(similarity.eps_neighbors(X.faces(spark, sf), 0.4))


@query("WITH " + X.FACES + f", d AS (SELECT a.id, b.id AS neighbor, list_cosine_distance(a.emb, b.emb) AS d FROM faces a JOIN faces b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor)::INT AS rank FROM d) SELECT id, neighbor, {q6('d')} AS distance, rank FROM r WHERE rank <= 15")
def knn(spark, sf):
    return rounded(similarity.knn(X.faces(spark, sf), 15))


@query("WITH " + X.FACES + f" SELECT a.label, count(*) + 0 AS pairs, {q6('max(list_cosine_distance(a.emb, b.emb))')} AS max_distance FROM faces a JOIN faces b ON a.label = b.label AND a.id < b.id GROUP BY a.label")
def cluster_diameter(spark, sf):
    found = refine.cluster_diameter(X.faces(spark, sf))
    return found.select("label", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), r6("max_distance"))


@query("WITH " + X.FACES + X.CENTROIDS.format(rows="faces") + f" SELECT a.label::BIGINT AS l1, b.label::BIGINT AS l2, {q6('list_cosine_distance(a.c, b.c)')} AS distance FROM centroids a JOIN centroids b ON a.label < b.label ORDER BY list_cosine_distance(a.c, b.c), 1, 2 LIMIT 1")
def closest_clusters(spark, sf):
    return rounded(similarity.closest_pair(V.vector_mean(X.faces(spark, sf), "label", "emb")))


@query("WITH " + X.FACES + X.CENTROIDS.format(rows="faces") + f", d AS (SELECT id, c.label AS key, list_cosine_distance(emb, c) AS d FROM faces, centroids c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, key)::INT AS rank FROM d) SELECT id, key, {q6('d')} AS distance, rank FROM r WHERE rank <= 3")
def top3_clusters(spark, sf):
    rows = X.faces(spark, sf)
    return rounded(similarity.top_clusters(rows, V.vector_mean(rows, "label", "emb"), 3))


_STATS = _PAIRS + ", s AS (SELECT count(*) AS num_pairs, avg(distance) AS mean, stddev_pop(distance) AS std, min(distance) AS min, max(distance) AS max, " + ", ".join(f"quantile_cont(distance, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95, 15)) + " FROM pairs)"


@query(_STATS + " SELECT num_pairs, " + ", ".join(f"{q6(c)} AS {c}" for c in ("mean", "std", "min", "max", "p5", "p25", "p50", "p75", "p95", "p15")) + " FROM s")
def distance_stats(spark, sf):
    return rounded(thresholds.distance_stats(X.faces(spark, sf)))


@query(_STATS + f", t AS (SELECT greatest(0.1, least(0.5, mean - 1.5 * std)) AS m, greatest(0.4, least(1.2, p75)) AS s, greatest(0.2, least(0.7, p15)) AS r FROM s) SELECT {q6('m')} AS merge_threshold, {q6('s')} AS split_threshold, {q6('r')} AS review_threshold, {q6('2 * m')} AS reassign_threshold FROM t")
def adaptive_thresholds(spark, sf):
    return rounded(thresholds.thresholds(thresholds.distance_stats(X.faces(spark, sf))))


@query("SELECT vec_id AS id, " + "x, pos FROM (SELECT vec_id, pos, " + q6("x") + " AS x FROM (WITH views AS (SELECT vec_id, unnest([embedding::DOUBLE[], list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda p: p[1] + 0.2::DOUBLE * p[2])]) AS v FROM embeddings), c AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM views), m AS (SELECT vec_id, pos, avg(x) AS m FROM c GROUP BY vec_id, pos), l AS (SELECT vec_id, list(m ORDER BY pos) AS v FROM m GROUP BY vec_id), u AS (SELECT vec_id, list_transform(v, lambda x: x/sqrt(list_dot_product(v, v))) AS u FROM l) SELECT vec_id, unnest(u) AS x, generate_subscripts(u, 1)::BIGINT AS pos FROM u))")
def ensemble_mean(spark, sf):
    from kinweave.operators.imaging import ensemble_mean as mean

    rows = X.raw(spark, sf)
    second = rows.select("id", F.zip_with("emb", F.reverse("emb"), lambda a, b: a + F.lit(0.2) * b).alias("emb"))
    return cells(mean(rows.select("id", "emb").unionByName(second)), "id", "embedding")


# --- clustering and refinement

@query("WITH " + X.LABELLED + f" SELECT count(*) AS n_faces, count(DISTINCT CASE WHEN label >= 0 THEN label END) AS n_clusters, count(*) FILTER (label < 0) AS n_noise, {q6('(count(*) FILTER (label < 0))::DOUBLE / count(*)')} AS noise_ratio, {q6('avg(probability)')} AS avg_probability FROM labelled")
def cluster_summary(spark, sf):
    return rounded(clustering.summary(X.labelled(spark, sf)))


def _probability(distance: str) -> str:
    return X.LABELLED + X.CENTROIDS.format(rows="labelled") + f", d AS (SELECT id, label, probability, {distance}(emb, c) AS d FROM labelled JOIN centroids USING (label)), w AS (SELECT *, greatest(max(d) OVER (PARTITION BY label), 1e-6) AS w FROM d), n AS (SELECT id, label, greatest(0.1, least(1.0, 1 - d / (1.5 * w))) AS p, probability FROM w)"


@query("WITH " + _probability("list_distance") + f" SELECT id, label, {q6('p')} AS probability FROM n UNION ALL SELECT id, label, 0.05::DOUBLE FROM labelled WHERE label < 0")
def dbscan_prob(spark, sf):
    return rounded(clustering.centroid_probability(X.labelled(spark, sf)))


_CONFIDENCE = "WITH " + _probability("list_cosine_distance") + ", conf AS (SELECT id, label, p * probability AS confidence FROM n UNION ALL SELECT id, label, 0.05::DOUBLE FROM labelled WHERE label < 0)"


@query(_CONFIDENCE + f" SELECT id, label, {q6('confidence')} AS confidence FROM conf")
def confidence(spark, sf):
    return rounded(refine.confidence(X.labelled(spark, sf)))


@query(_CONFIDENCE + " SELECT id FROM conf WHERE label = -1 OR confidence < 0.4")
def review_queue(spark, sf):
    rows = refine.confidence(X.labelled(spark, sf))
    return rows.filter(refine.in_review(F.col("label"), F.col("confidence"), 0.4)).select("id")


_REPORTED = _CONFIDENCE + ", rep AS (SELECT id, label, confidence, label = -1 OR confidence < 0.4 AS in_review, id AS ord, concat('f', CAST(id AS VARCHAR)) AS face_id, concat('/photos/', CAST(id % 3 AS VARCHAR), '/p', CAST(id % 40 AS VARCHAR), '.jpg') AS image_path FROM conf)"


def _reported(spark, sf):
    rows = refine.confidence(X.labelled(spark, sf))
    path = F.concat(F.lit("/photos/"), (F.col("id") % 3).cast("string"), F.lit("/p"), (F.col("id") % 40).cast("string"), F.lit(".jpg"))
    return rows.withColumns({"in_review": refine.in_review(F.col("label"), F.col("confidence"), 0.4), "ord": F.col("id"), "face_id": F.concat(F.lit("f"), F.col("id").cast("string")), "image_path": path})


@query(_REPORTED + f" SELECT 'Person_' || lpad(CAST(label AS VARCHAR), 3, '0') AS cluster_name, count(*) AS face_count, count(DISTINCT image_path) AS n_images, {q6('avg(confidence)')} AS avg_confidence, count(*) FILTER (in_review) AS n_review FROM rep WHERE label >= 0 GROUP BY label")
def cluster_report(spark, sf):
    return rounded(report.cluster_report(_reported(spark, sf)))


@query(_REPORTED + " SELECT count(DISTINCT CASE WHEN label >= 0 THEN label END) AS n_clusters, count(*) AS n_faces, count(*) FILTER (in_review) AS n_review, count(*) FILTER (label = -1) AS n_noise FROM rep")
def report_totals(spark, sf):
    return report.report_totals(_reported(spark, sf))


@query(_REPORTED + ", r AS (SELECT *, row_number() OVER (PARTITION BY label, image_path ORDER BY ord) AS rn FROM rep WHERE label >= 0) SELECT label, image_path, face_id FROM r WHERE rn = 1")
def first_image_per_cluster(spark, sf):
    return report.first_images(_reported(spark, sf)).select("label", "image_path", "face_id")


@query(_REPORTED + ", r AS (SELECT *, row_number() OVER (PARTITION BY label, image_path ORDER BY ord) AS rn, list_extract(string_split(image_path, '/'), -1) AS base FROM rep WHERE label >= 0), nm AS (SELECT *, row_number() OVER (PARTITION BY label, base ORDER BY ord) - 1 AS k FROM r WHERE rn = 1) SELECT label, image_path, CASE WHEN k = 0 THEN base ELSE regexp_replace(base, '\\.[^.]*$', '') || '_' || CAST(k AS VARCHAR) || regexp_extract(base, '(\\.[^.]*)$', 1) END AS file_name FROM nm")
def collision_suffix(spark, sf):
    return report.manifest(_reported(spark, sf)).select("label", "image_path", "file_name")


@query(_REPORTED + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ord) AS rn, list_extract(string_split(image_path, '/'), -1) AS base FROM rep WHERE label >= 0) SELECT 'Person_' || lpad(CAST(label AS VARCHAR), 3, '0') AS cluster_name, " + ", ".join(f"coalesce(max(CASE WHEN rn = {i} THEN base END), '') AS t{i}" for i in range(1, 5)) + " FROM r GROUP BY label")
def top4_per_cluster(spark, sf):
    return report.top_per_cluster(_reported(spark, sf), 4)


@query(_REPORTED + f" SELECT id, CASE WHEN label = -1 THEN 'x' WHEN in_review THEN 'D' ELSE 'o' END AS marker, {q6('CASE WHEN label = -1 THEN 30.0::DOUBLE WHEN in_review THEN 80.0::DOUBLE ELSE confidence * 120 + 20 END')} AS size, {q6('CASE WHEN label = -1 THEN 0.5::DOUBLE WHEN in_review THEN 0.8::DOUBLE ELSE greatest(0.3, least(1.0, confidence * 0.8 + 0.2)) END')} AS alpha FROM rep")
def heatmap_points(spark, sf):
    return rounded(report.plot_points(_reported(spark, sf)).select("id", "marker", "size", "alpha"))


@query(_REPORTED + f", xy AS (SELECT label, emb[1] AS x, emb[2] AS y FROM rep JOIN (SELECT id, emb FROM labelled) USING (id) WHERE label >= 0) SELECT 'P' || lpad(CAST(label AS VARCHAR), 3, '0') AS text, {q6('avg(x)')} AS x, {q6('avg(y)')} AS y FROM xy GROUP BY label")
def heatmap_labels(spark, sf):
    rows = X.labelled(spark, sf).select("label", F.element_at("emb", 1).alias("x"), F.element_at("emb", 2).alias("y"))
    return rounded(report.plot_labels(rows))


_PIXEL = "CAST(least({n} - 1, greatest(0, floor(({c} - {c}0) / greatest({c}1 - {c}0, 1e-12) * {n}))) AS INTEGER) AS p{c}"
_PLOTTED = (
    _REPORTED
    + f", pt AS (SELECT label, {q6('emb[1]')} AS x, {q6('emb[2]')} AS y, CASE WHEN label = -1 THEN 'x' WHEN in_review THEN 'D' ELSE 'o' END AS marker, {q6('CASE WHEN label = -1 THEN 30.0::DOUBLE WHEN in_review THEN 80.0::DOUBLE ELSE confidence * 120 + 20 END')} AS size, {q6('CASE WHEN label = -1 THEN 0.5::DOUBLE WHEN in_review THEN 0.8::DOUBLE ELSE greatest(0.3, least(1.0, confidence * 0.8 + 0.2)) END')} AS alpha FROM rep JOIN (SELECT id, emb FROM labelled) USING (id)), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt)"
)


def _plotted(spark, sf):
    at = X.labelled(spark, sf).select("id", F.element_at("emb", 1).cast("double").alias("x"), F.element_at("emb", 2).cast("double").alias("y"))
    rows = report.plot_points(_reported(spark, sf)).select("id", "label", "marker", "size", "alpha").join(at, "id")
    return rounded(rows.drop("id"))


@query(_PLOTTED + f", p AS (SELECT *, {_PIXEL.format(c='x', n=640)}, {_PIXEL.format(c='y', n=480)} FROM pt, e), r AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY alpha DESC, label, ascii(marker), size DESC) AS rn FROM p) SELECT px, py, label, marker, size, alpha FROM r WHERE rn = 1")
def heatmap_pixels(spark, sf):
    return report.plot_pixels(_plotted(spark, sf), 640, 480)


@query(_PLOTTED + f", c AS (SELECT 'P' || lpad(CAST(label AS VARCHAR), 3, '0') AS text, avg(x) AS x, avg(y) AS y FROM pt WHERE label >= 0 GROUP BY label), p AS (SELECT text, {_PIXEL.format(c='x', n=640)}, {_PIXEL.format(c='y', n=480)} FROM c, e), r AS (SELECT *, row_number() OVER (PARTITION BY px // 28, py // 11 ORDER BY length(text), text, px, py) AS rn FROM p) SELECT px, py, text FROM r WHERE rn = 1")
def heatmap_names(spark, sf):
    return report.plot_texts(_plotted(spark, sf), 640, 480)


@query("SELECT label::INT AS label, (19 + row_number() OVER (ORDER BY label))::INT AS new_label FROM (SELECT DISTINCT label FROM embeddings WHERE label % 3 = 1)")
def split_numbering(spark, sf):
    rows = X.raw(spark, sf)
    accepted = rows.filter("label % 3 = 1").select("label").distinct()
    return refine.number_splits(accepted, rows.select("label").unionByName(spark.createDataFrame([(19,)], "label int")))


@query("SELECT event_id, event_type, (SELECT count(*) FROM events) AS total FROM events ORDER BY event_id DESC LIMIT 200")
def last_n(spark, sf):
    """The limit is the feature: the last 200 lines."""
    rows = X.table(spark, sf, "events")
    return rows.select("event_id", "event_type").orderBy(F.desc("event_id")).limit(200).crossJoin(rows.agg(F.count("*").alias("total")))


@query("WITH RECURSIVE " + X.FACES + """, near AS (SELECT a.id AS a, b.id AS b FROM faces a JOIN faces b ON a.id <> b.id WHERE list_distance(a.emb, b.emb) <= 0.6),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= 2),
    reach AS (SELECT id, id AS r FROM core UNION SELECT reach.id, near.b FROM reach JOIN near ON near.a = reach.r JOIN core ON core.id = near.b),
    comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id), lab AS (SELECT c, (row_number() OVER (ORDER BY c) - 1)::INT AS label FROM (SELECT DISTINCT c FROM comp)),
    cl AS (SELECT id, label FROM comp JOIN lab USING (c)), bo AS (SELECT near.a AS id, min(label) AS label FROM near JOIN cl ON cl.id = near.b GROUP BY near.a)
    SELECT f.id, coalesce(cl.label, bo.label, -1)::INT AS label FROM faces f LEFT JOIN cl USING (id) LEFT JOIN bo ON bo.id = f.id""")
def dbscan(spark, sf):
    return clustering.dbscan(X.faces(spark, sf), 0.6, 2)


@query()
def hdbscan(spark, sf):
    return rounded(clustering.hdbscan(X.faces(spark, sf), clustering.ClusterConfig(min_cluster_size=5)))


@query()
def cluster_dispatch(spark, sf):
    return rounded(clustering.cluster(X.faces(spark, sf), clustering.ClusterConfig(min_cluster_size=5, eps=0.6)))


@query("WITH " + X.FACES + " SELECT id, 0::INT AS label FROM faces")
def merge_clusters(spark, sf):
    """Over a threshold that no pair of clusters exceeds, all become the smallest label."""
    return refine.merge_clusters(X.faces(spark, sf), 2.5).select("id", "label")


#: Greedy merging of the closest mean vectors under a threshold, step by step; homes has each label's new one.
_MERGED = """,
    gather AS (SELECT label, pos, sum(x) AS s FROM (SELECT label, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM {rows} WHERE label >= 0) GROUP BY label, pos),
    whole AS (SELECT label, list(s ORDER BY pos) AS t FROM gather GROUP BY label),
    merging AS (
        SELECT 0 AS step, list(label ORDER BY label) AS first, list(label ORDER BY label) AS ls, list(t ORDER BY label) AS ts, list(label ORDER BY label) AS home FROM whole
        UNION ALL
        SELECT step + 1, first, list_filter(ls, lambda l: l <> ls[b.j]),
            list_transform(list_filter(range(1, len(ls) + 1), lambda k: k <> b.j), lambda k: CASE WHEN k = b.i THEN list_transform(list_zip(ts[b.i], ts[b.j]), lambda p: p[1] + p[2]) ELSE ts[k] END),
            list_transform(home, lambda h: CASE WHEN h = ls[b.j] THEN ls[b.i] ELSE h END)
        FROM (SELECT *, list_min(list_filter(flatten(list_transform(range(1, len(ls)), lambda i: list_transform(range(i + 1, len(ls) + 1), lambda j: {{'d': list_cosine_distance(ts[i], ts[j]), 'i': i, 'j': j}}))), lambda p: p.d < {threshold})) AS b FROM merging)
        WHERE b IS NOT NULL
    ),
    homes AS (SELECT unnest(first) AS label, unnest(home) AS home FROM (SELECT * FROM merging ORDER BY step DESC LIMIT 1))"""


@query("WITH RECURSIVE " + X.FACES.strip() + _MERGED.format(rows="faces", threshold=0.9) + " SELECT id, home::INT AS label FROM faces JOIN homes USING (label)")
def merge_close_clusters(spark, sf):
    """At a threshold at which some clusters are merged, one after another, and others stay."""
    return refine.merge_clusters(X.faces(spark, sf), 0.9).select("id", "label")


@query()
def split_clusters(spark, sf):
    return refine.split_clusters(X.faces(spark, sf), 0.1).select("id", "label")


_REFINED = X.LABELLED.replace("labelled AS", "old AS") + X.CENTROIDS.format(rows="old").replace("cells", "cells0").replace("means", "means0").replace("centroids", "centroids0") + """,
    rd AS (SELECT x.id, c.label AS l, list_cosine_distance(emb, c) AS d FROM old x, centroids0 c WHERE x.label = -1), rb AS (SELECT id, arg_min(l, d) AS l, min(d) AS d FROM rd GROUP BY id),
    labelled AS (SELECT x.id, emb, probability, (CASE WHEN rb.d < 0.6 THEN rb.l ELSE x.label END)::INT AS label FROM old x LEFT JOIN rb USING (id))""" + X.CENTROIDS.format(rows="labelled") + """,
    d AS (SELECT id, label, probability, list_cosine_distance(emb, c) AS d FROM labelled JOIN centroids USING (label)), w AS (SELECT *, greatest(max(d) OVER (PARTITION BY label), 1e-6) AS w FROM d),
    conf AS (SELECT id, label, probability * greatest(0.1, least(1.0, 1 - d / (1.5 * w))) AS confidence FROM w UNION ALL SELECT id, label, 0.05::DOUBLE FROM labelled WHERE label < 0)"""


@query("WITH " + _REFINED + f" SELECT id, label, {q6('confidence')} AS confidence, label = -1 OR confidence < 0.4 AS in_review FROM conf")
def refine_fixed(spark, sf):
    """Refinement with thresholds at which nothing is merged or split, so that SQL can follow it."""
    return rounded(refine.refine(X.labelled(spark, sf), refine.RefineConfig(merge_threshold=0.05, split_threshold=1.9)))


@query("WITH RECURSIVE " + X.LABELLED.replace("labelled AS", "given AS").strip() + _MERGED.format(rows="given", threshold=0.9) + ", old AS (SELECT id, emb, probability, coalesce(home, label)::INT AS label FROM given LEFT JOIN homes USING (label))" + _REFINED[len(X.LABELLED) - len("labelled") + len("old"):] + f" SELECT id, label, {q6('confidence')} AS confidence, label = -1 OR confidence < 0.4 AS in_review FROM conf")
def refine_merging(spark, sf):
    """Refinement that merges; nothing is split, so that SQL can follow it."""
    return rounded(refine.refine(X.labelled(spark, sf), refine.RefineConfig(merge_threshold=0.9, split_threshold=1.9)))


# --- evaluation

_MATCHED = "WITH " + X.TRUTH + ", m AS (SELECT n.face_id, n.label AS pred, coalesce(a.gt_label, b.gt_label{c}) AS gt FROM named n LEFT JOIN truth a ON a.key = n.face_id LEFT JOIN truth b ON b.key = n.image_path {j}), v AS (SELECT * FROM m WHERE gt IS NOT NULL)"
_GT = _MATCHED.format(c=", c.gt_label", j="LEFT JOIN truth c ON c.key = list_extract(string_split(n.image_path, '/'), -1)")


def _matched(spark, sf, base=True):
    found = evaluate.match_ground_truth(X.named(spark, sf), X.truth(spark, sf), base=base)
    return found.select("face_id", F.col("label").alias("pred"), F.col("gt_label").alias("gt"))


@query(_GT + " SELECT face_id, pred, gt FROM v")
def gt_match(spark, sf):
    return _matched(spark, sf)


@query(_MATCHED.format(c="", j="") + " SELECT face_id, pred, gt FROM v")
def gt_match_calibration(spark, sf):
    """By face id and path only; a true label 0 counts like any other."""
    return _matched(spark, sf, base=False)


_CONTINGENCY = _GT + ", t AS (SELECT pred, gt, count(*) AS n FROM v WHERE pred >= 0 GROUP BY pred, gt), a AS (SELECT pred, sum(n) AS m FROM t GROUP BY pred), b AS (SELECT gt, sum(n) AS m FROM t GROUP BY gt)"
_PAIRWISE = _GT + """, ids AS (SELECT *, row_number() OVER (ORDER BY face_id) AS i FROM v WHERE pred >= 0), pr AS (SELECT count(*) FILTER (x.pred = y.pred AND x.gt = y.gt) AS tp, count(*) FILTER (x.pred = y.pred AND x.gt <> y.gt) AS fp,
    count(*) FILTER (x.pred <> y.pred AND x.gt = y.gt) AS fn, count(*) FILTER (x.pred <> y.pred AND x.gt <> y.gt) AS tn FROM ids x JOIN ids y ON x.i < y.i), pf AS (SELECT *, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r FROM pr)"""


@query(_PAIRWISE + f" SELECT tp, fp, fn, tn, {q6('p')} AS precision, {q6('r')} AS recall, {q6('2 * p * r / (p + r)')} AS f1 FROM pf")
def pairwise_f1(spark, sf):
    return rounded(evaluate.pairwise(evaluate.contingency(_matched(spark, sf))))


_ARI = "2 * (tp::DOUBLE * tn - fn::DOUBLE * fp) / ((tp::DOUBLE + fn) * (fn + tn) + (tp::DOUBLE + fp) * (fp + tn))"


@query(_PAIRWISE + f" SELECT {q6(_ARI)} AS ari FROM pf")
def ari(spark, sf):
    return rounded(evaluate.adjusted_rand(evaluate.contingency(_matched(spark, sf))))


_NMI = "(SELECT sum(t.n / z.z * ln(t.n * z.z / (a.m::DOUBLE * b.m))) FROM t JOIN a USING (pred) JOIN b ON b.gt = t.gt, z) / (((SELECT -sum(m / z.z * ln(m / z.z)) FROM a, z) + (SELECT -sum(m / z.z * ln(m / z.z)) FROM b, z)) / 2)"


@query(_CONTINGENCY + f", z AS (SELECT sum(n)::DOUBLE AS z FROM t) SELECT {q6(_NMI)} AS nmi")
def nmi(spark, sf):
    return rounded(evaluate.normalized_mutual_information(evaluate.contingency(_matched(spark, sf))))


_PURITY = ", r AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY n DESC, gt) AS rn FROM t), pu AS (SELECT r.pred, a.m::BIGINT AS size, r.gt AS majority_label, r.n AS majority_count FROM r JOIN a USING (pred) WHERE rn = 1)"


@query(_CONTINGENCY + _PURITY + f" SELECT *, {q6('majority_count::DOUBLE / size')} AS purity FROM pu")
def purity(spark, sf):
    return rounded(evaluate.purity(evaluate.contingency(_matched(spark, sf))))


@query(_PAIRWISE + _CONTINGENCY[len(_GT):] + _PURITY + ", z AS (SELECT sum(n)::DOUBLE AS z FROM t)" + f" SELECT (SELECT count(*) FROM v) AS total, (SELECT sum(n) FROM t)::BIGINT AS valid, (SELECT count(*) FROM v WHERE pred < 0) AS noise, 0.0::DOUBLE AS noise_ratio, {q6('p')} AS precision, {q6('r')} AS recall, {q6('2 * p * r / (p + r)')} AS f1, {q6(_ARI)} AS ari, {q6(_NMI)} AS nmi, {q6('(SELECT sum(majority_count)::DOUBLE / sum(size) FROM pu)')} AS purity FROM pf")
def evaluation_report(spark, sf):
    return rounded(evaluate.evaluation_report(_matched(spark, sf)))


@query()
def calibration_grid(spark, sf):
    from kinweave.plans.engine import calibrate

    rows = X.faces(spark, sf).select("id", "emb", F.col("label").alias("gt"))
    return rounded(calibrate(rows))


# --- listings

@query(_REPORTED + ", r AS (SELECT *, row_number() OVER (PARTITION BY label, image_path ORDER BY ord) AS rn FROM rep WHERE label >= 0) SELECT 'Person_' || lpad(CAST(label AS VARCHAR), 3, '0') AS cluster_name, count(*) AS photos FROM r WHERE rn = 1 GROUP BY label")
def cluster_files(spark, sf):
    rows = _reported(spark, sf)
    files = report.manifest(rows).select(S.person_name(F.col("label")).alias("cluster_name"), F.lit("photo").alias("kind"), F.col("file_name").alias("name"))
    return report.cluster_files(report.cluster_report(rows), files).select("cluster_name", F.size("photo_files").cast("bigint").alias("photos"))


@query(_REPORTED + ", r AS (SELECT *, row_number() OVER (PARTITION BY label, image_path ORDER BY ord) AS rn FROM rep WHERE label >= 0) SELECT (SELECT count(DISTINCT label) FROM r) AS n_clusters, (SELECT count(*) FROM r WHERE rn = 1) AS n_photos, (SELECT count(*) FROM rep) AS n_faces, (SELECT count(*) FROM rep WHERE in_review) AS n_review, (SELECT count(*) FROM documents) AS n_input_photos, false AS has_plot")
def output_stats(spark, sf):
    rows = _reported(spark, sf)
    files = report.manifest(rows).select(S.person_name(F.col("label")).alias("cluster_name"), F.lit("photo").alias("kind"), F.col("file_name").alias("name"))
    return report.output_stats(files, report.report_totals(rows), X.table(spark, sf, "documents"))
