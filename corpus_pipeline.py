"""A training-text pipeline of five stages. Each takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next stage's docs. All stages but the last return the
columns of documents.

* language_id: learns from the rows with a known language and drops texts in which no language can be told (no letters, or a profile like none of the languages').
* exact_dedup: of equal texts (A-Z lower-cased) the row with the largest doc_id stays.
* simhash_near_dedup: wide fingerprints of five-word shingles; of each group of documents that are linked by a Jaccard similarity of 0.8 or more the one with the smallest doc_id stays. Rows without a doc_id are
  compared by a hash of their text and come after all others, so one of them stays only where its group has no doc_id. Rows that share a doc_id are one document.
* mix_sources: rows are written in the order of the mixing schedule; rows of one slot by doc_id, then by a hash of their text.
* pack: the rows' pieces in sequences of 4096 tokens, which follow the order of the mix.

A null text has no letters, so language_id drops it, as it does empty texts. Of equal rows exact_dedup leaves one. An empty table gives an empty one at every stage. Further columns of documents go along up to the last stage; names
that begin with __kw_ are taken. A stage's table is deleted once the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import exact, langid, mixing, packing, queries, simhash
from kinweave.llm.common import cut, residue, scratch, table

#: The cosine below which a text is like no language: what chance gives in 1024 dimensions. Texts of a single word reach 0.06 and more.
LEAST_COSINE = 0.03
#: Documents are linked if the Jaccard similarity of their sets of five-word shingles is at least this (as a fraction, counted exactly).
LEAST_JACCARD = (4, 5)
#: Bits of 64 * WORDS in which the fingerprints of documents of a wide group may differ. Texts of Jaccard similarity 0.8 differ in 15 % of the bits on the average (39, give or take 6).
NEAR_BITS, WORDS = 66, 4
#: So many identifiers, with a number each, are broadcast (16 MB); more are joined by a shuffle.
FEW_IDS = 1_000_000
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, residue(F.col("doc_id"), 5) != 0)
    judged = langid.predict(docs.select(F.struct(*docs.columns).alias("__kw_row"), "text"), model)
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_COSINE)).select("__kw_row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.survivors(docs, keep="max")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    behind = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    keyed = docs.withColumn("__kw_key", F.coalesce(F.col("doc_id").cast("bigint"), behind))
    found = simhash.verified_groups(keyed, size=5, least=LEAST_JACCARD, words=WORDS, limit=NEAR_BITS, id_col="__kw_key")
    ids = cut(found.filter("id <> component").select(F.col("id").alias("__kw_key")))
    return keyed.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "__kw_key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mixing.mix(docs, queries.SHARES, default=queries.SHARE, block_chars=queries.BLOCK_CHARS)
    slots = cut(placed.groupBy(F.col("id").alias("__kw_id")).agg(F.min("slot").alias("__kw_slot")))
    slotted = docs.join(F.broadcast(slots) if slots.count() <= FEW_IDS else slots, F.col("doc_id").eqNullSafe(F.col("__kw_id")), "left").drop("__kw_id")
    order = ("__kw_slot", "doc_id", "__kw_hash")  # of the rows alone, so a task that is run again deals them the same way
    return slotted.withColumn("__kw_hash", F.xxhash64("doc_id", "text")).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    try:  # the order in which the last stage wrote the rows
        at = F.concat(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))
        ordered = docs.withColumn("__kw_ord", F.coalesce(at.try_cast("bigint"), F.col("doc_id")))
        ordered.schema  # noqa: B018  analysed here
    except AnalysisException:  # docs aren't files' rows
        ordered = docs.withColumn("__kw_ord", F.col("doc_id"))
    packed = packing.pack(ordered, public_tokenizers.path(queries.PACK_TOKENIZER), order_col="__kw_ord")
    return packed.drop("ord").withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup), ("mix_sources", mix_sources), ("pack", pack)]


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before is not None:
            delete(spark, before)
        before = at
    return docs
