"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

* memtable and flush: every task takes its rows' digests, identifiers and places and writes them sorted by digest, without a shuffle; tasks are dealt to RUNS runs. Beside each run lies its
  filter: a table of bits, one set for each digest, and another for bits that are set more than once.
* compaction: the runs' filters are held against each other. A digest whose bit is set in one run only, and once, occurs once: it isn't merged. All others are merged by digest, partial results
  first, so a digest with a third of all rows sends one row from each task. Of each digest the smallest identifier stays (or the largest: keep="max"), with the number of its rows.
* hits (digests with more than one row) are verified by bytes: a filter of the hits picks the texts, and per digest the smallest and largest text are compared, again with partial
  results first. Where they differ (a collision), the rows of that digest are grouped by the text itself.

Filters have 16 bits for each entry and are broadcast up to MOST_BITS of them (16 MB); with more entries all digests are merged, and texts are picked by a join on the hits: the results are the same.

Null texts count as empty. Texts are equal when identical after lower-casing A-Z only. Null identifiers lose against any other; a group of null identifiers only keeps null. Repeated
rows are counted, and one of them stays (of equal identifiers the last one read). Other columns are carried by survivors() and otherwise not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import ascii_lower, cut, scratch

RUNS = 4
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def normalised(text: Column) -> Column:
    return F.coalesce(ascii_lower(text), F.lit(""))


def filter_bits(entries: int) -> int:
    """Bits of a filter for so many entries: a power of two, or 0 if it would be too large to be broadcast."""
    bits = max(LEAST_BITS, 1 << (entries * BITS_EACH - 1).bit_length())
    return bits if bits <= MOST_BITS else 0


def _place(bits: int) -> tuple[Column, Column]:
    """Word and bit of a digest in a filter."""
    at = F.pmod(F.xxhash64("digest"), F.lit(bits))
    return F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(digest), {bits}L), 64) as int))").alias("bit")


def _passes(rows: DataFrame, table: DataFrame, bits: int, how: str = "inner") -> DataFrame:
    """Rows whose digest is in the filter table (word, bits), or with left_anti: is not."""
    word, bit = _place(bits)
    joined = rows.join(F.broadcast(table), (word == F.col("word")) & (F.col("bits").bitwiseAND(bit) != 0), how)
    return joined if how == "left_anti" else joined.drop("word", "bits")


def _first(keep: str) -> Column:
    """The (id, at) that stays of a digest's rows; null identifiers lose."""
    if keep == "max":
        return F.max(F.struct("id", "at"))
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))


class DigestLog:
    """A log-structured index from digests to identifiers in the shared folder. Runs may be added at any time; reads merge what is there."""

    def __init__(self, spark: SparkSession, keep: str = "min", path: str | None = None):
        self.spark, self.keep, self.path, self.flushes = spark, keep, path or scratch(spark, "lsm"), 0
        self.kind = "bigint"

    def flush(self, rows: DataFrame, runs: int = RUNS) -> DataFrame:
        """Write (digest, id) rows as sorted files of some runs and return all runs (digest, id, at, run); at is each row's place."""
        at, self.kind = f"{self.path}/level0/flush={self.flushes}", rows.schema["id"].dataType.simpleString()
        place = F.monotonically_increasing_id() + F.lit(self.flushes) * F.lit(1 << 56)
        memtable = rows.select("digest", "id", place.alias("at"), F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"))
        memtable.sortWithinPartitions("run", "digest", "id").write.partitionBy("run").parquet(at)
        self.flushes += 1
        return self.runs()

    def runs(self) -> DataFrame:
        files = self.spark.read.schema(f"digest binary, id {self.kind}, at bigint, flush int, run int").parquet(f"{self.path}/level0")
        return files.select("digest", "id", "at", (F.col("flush") * F.lit(1 << 16) + F.col("run")).alias("run"))

    def filters(self, bits: int) -> DataFrame:
        """Each run's filter: run, word, bits, twice."""
        cells = self.runs().groupBy("run", *_place(bits)).agg(F.count("*").alias("n"))
        return cells.groupBy("run", "word").agg(F.bit_or("bit").alias("bits"), F.bit_or(F.when(F.col("n") > 1, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias("twice"))

    def suspects(self, bits: int) -> DataFrame:
        """One filter (word, bits) of the bits that are set in two runs' filters or twice in one's."""
        step = lambda acc, r: F.struct(acc["bits"].bitwiseOR(r["bits"]).alias("bits"), acc["twice"].bitwiseOR(r["twice"]).bitwiseOR(acc["bits"].bitwiseAND(r["bits"])).alias("twice"))
        none = F.struct(F.lit(0).cast("bigint").alias("bits"), F.lit(0).cast("bigint").alias("twice"))
        both = self.filters(bits).groupBy("word").agg(F.aggregate(F.collect_list(F.struct("bits", "twice")), none, step, lambda acc: acc["twice"]).alias("bits"))
        return cut(both.filter("bits <> 0"))

    def compact(self) -> DataFrame:
        """Write the merged runs as the next level and return it: digest, id and at (of the row that stays), rows."""
        runs = self.runs()
        bits = filter_bits(runs.count())
        several = runs
        if bits:
            table = self.suspects(bits)
            several = _passes(runs, table, bits)
        merged = several.groupBy("digest").agg(_first(self.keep).alias("k"), F.count("*").alias("rows")).select("digest", "k.id", "k.at", "rows")
        if bits:
            merged = merged.unionByName(_passes(runs, table, bits, "left_anti").select("digest", "id", "at", F.lit(1).cast("bigint").alias("rows")))
        at = f"{self.path}/level1-{self.flushes}"
        merged.sortWithinPartitions("digest").write.parquet(at)
        return self.spark.read.parquet(at)


class Index:
    """docs, indexed: runs (digest, id, at), merged (digest, id, at, rows) and the collisions found by byte verification."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=sha256):
        self.spark = docs.sparkSession
        self.keep, self.docs, self.id_col = keep, docs, id_col
        self.rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
        log = DigestLog(self.spark, keep)
        self.runs = log.flush(self.rows)
        self.merged = log.compact()
        self.hits = self.merged.filter("rows > 1")
        self.bits = filter_bits(self.hits.count())
        self.table = None
        if self.bits:
            word, bit = _place(self.bits)
            self.table = cut(self.hits.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")))
        ends = self.several(self.rows).groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
        self.collisions = cut(ends.filter("low <> high").select("digest"))
        self.collided = not self.collisions.isEmpty()

    def several(self, rows: DataFrame) -> DataFrame:
        """Of rows with a digest those that may be hits, all hits among them."""
        return rows.join(self.hits.select("digest"), "digest", "left_semi") if self.table is None else _passes(rows, self.table, self.bits)

    def alone(self, rows: DataFrame) -> DataFrame:
        """The others."""
        return rows.join(self.hits.select("digest"), "digest", "left_anti") if self.table is None else _passes(rows, self.table, self.bits, "left_anti")

    def groups(self) -> DataFrame:
        """One row per document: id, digest, keep_id, group_size, kept."""
        single = self.merged.select("digest", F.col("id").alias("keep_id"), F.col("at").alias("keep_at"), F.col("rows").alias("group_size"))
        columns = ["id", "digest", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept")]
        if not self.collided:
            return self.runs.join(single, "digest").select(*columns)
        sound = self.runs.join(self.collisions, "digest", "left_anti").join(single, "digest").select(*columns)
        mixed = cut(self.rows.join(self.collisions, "digest", "left_semi").withColumn("at", F.monotonically_increasing_id()))
        by_text = mixed.groupBy("digest", "text").agg(_first(self.keep).alias("k"), F.count("*").alias("group_size")).select("digest", "text", F.col("k.id").alias("keep_id"), F.col("k.at").alias("keep_at"), "group_size")
        return sound.unionByName(mixed.join(by_text, ["digest", "text"]).select(*columns))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=sha256) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, digest. Of each group one row is kept, whatever is repeated in it."""
    return Index(docs, id_col=id_col, text_col=text_col, keep=keep, digest=digest).groups().select("id", "keep_id", "group_size", "kept", "digest")


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=sha256) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns. Only texts that may be hits are shuffled."""
    columns = docs.columns
    index = Index(docs, id_col=id_col, text_col=text_col, keep=keep, digest=digest)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    whole = whole.withColumn("digest", digest(F.col("text")))
    alone, maybe = index.alone(whole), index.several(whole)
    kept = index.merged.select("digest", F.col("id").alias("keep_id"))
    by = ["digest"]
    if index.collided:
        by = ["digest", "text"]
        pick = F.max if keep == "max" else F.min
        kept = maybe.groupBy("digest", "text").agg(pick("id").alias("keep_id"))
    firsts = maybe.join(kept, by).filter(F.col("id").eqNullSafe(F.col("keep_id")))
    one = firsts.groupBy(*by).agg(F.first("row").alias("row"))
    return alone.select("row").unionByName(one.select("row")).select([F.col("row").getField(c).alias(c) for c in columns])
