"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import alignment, exact, hardneg, langid, media, mixing, neighbours, packing, simhash, substring, tokencount, toxicity, urlfilter
from kinweave.llm.common import residue, table

PACK_TOKENIZER = "word_bpe_49k.json"
COUNT_TOKENIZER = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [urlfilter.Rule("com", "/en/", False), urlfilter.Rule("example.com", "/en/7", True), urlfilter.Rule("net", "/de/", True), urlfilter.Rule("example.net", "/de/8", False), urlfilter.Rule("org", "/es/", False)]
SHARES, SHARE, BLOCK_CHARS = {"src0": 5, "src1": 3, "src2": 2}, 1, 1 << 16


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(residue(F.col("doc_id"), 5) == 0, F.lit(False))
    model = langid.train(docs, residue(F.col("doc_id"), 5) != 0)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), SHARES, default=SHARE, block_chars=BLOCK_CHARS).withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), residue(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(residue(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.spans(table(spark, sf_dir, "documents")).drop("row").withColumnsRenamed({"id": "doc_id", "first_id": "first_doc_id"})


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_TOKENIZER), keep=["doc_id"])


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), size=3, limit=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read(media.store(table(spark, sf_dir, "documents"), keep=["doc_id"]), keep=["doc_id", "n_bytes"])
    return found.withColumn("clips", F.to_json("clips"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_TOKENIZER))
    return packed.drop("ord").withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.judge(table(spark, sf_dir, "documents"), keep="max")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urlfilter.ruled(table(spark, sf_dir, "pages"), URL_RULES)
    found = urlfilter.judge(rows, urlfilter.train(rows))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = neighbours.train(docs, table(spark, sf_dir, "labels"), residue(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(residue(F.col("doc_id"), 5) == 0, F.lit(False))
    return neighbours.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(COUNT_TOKENIZER), keep=["doc_id"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, id_col="vec_id", label=label, vec_col="embedding")


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_mix_sources, op3_toxicity, op4_substring_dedup, op5_token_counts, op6_simhash_near_dedup, op7_media_columns, op8_pack_sequences, op9_exact_dedup, op10_url_filter, op11_quality, op12_token_alignment, op13_hard_negatives)
}

ORACLES = {
    "op2_mix_sources": mixing.schedule_sql(SHARES, SHARE, BLOCK_CHARS),
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
        g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)
    """,
    "op13_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
    """,
}
