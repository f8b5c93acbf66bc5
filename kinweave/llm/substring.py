"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes: each step doubles it and adds a random number of the byte, so in 16 bits it depends on the last 16 bytes. A chunk ends behind a byte where the hash is small (one in `every`)
and was not in the 15 bytes before; stretches without such a place are cut at `longest`. Ends depend on the 16 bytes before them alone (but for the forced ones), so an insertion moves only
the chunks around it. Chunks are deduplicated by digest: of each digest that two documents have, the first and the last holder are found (by identifier).

Shared chunks that, with their neighbours, are too few for a span go first. A partner is the first holder of a chunk (for that document itself the last one), and so is that of a window: the chunks from one on
that lie inside any span which begins in the chunk before. A third document that has a part of a passage can be the first holder of its chunks, but hides a window only if it has nearly as much as a span.
A document's chunks and windows that stand in the same place relative to one partner and touch are a run (of a window that the partner has more than once the first and the last place are tried). Each run is extended byte
by byte against the partner's text, to the true ends of what both have, at ends of characters: surroundings are read again, wider, for the few ends that reach beyond them. What has least_words words (or, for
writing without spaces, least_bytes bytes) is a span: its bytes stand in the partner's text as well. Digests have 64 bits, and a chance hit is one chunk, which is too short for a span.

First and last holders are found with partial results before the shuffle, so a passage that is in a third of all documents sends one row from each task; the join back is split where it is uneven. Surroundings
of a place are read once, however many runs need them.

Defined results: null, empty and short texts have no span; rows that are equal in identifier and text are one document, other rows of one identifier, or without any, are documents of their own; these come last in the order of holders; repeats
within a document are no spans; texts of any length are read whole. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bounded, cut, map_batches, scratch
from kinweave.llm.exact import filter_bits

REACH = 16
EVERY = 24
LONGEST = 256
LEAST_WORDS, LEAST_BYTES = 50, 800
#: Bytes on either side of a run's end that are read at first; of ends that go on beyond them eight times as many, and so on.
REACHED = 192
#: So many identifiers or places are broadcast (some 40 MB); more are joined by a shuffle.
FEW = 1_000_000
_GEAR = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 16, 256, dtype=np.uint16)
_DIGEST = xxhash.xxh3_64_intdigest
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the 16-bit hash of the 16 bytes up to it."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint16(s)
    return h


def chunk_ends(texts: list[bytes], every: int = EVERY, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks in the texts joined together, and the text of each. A text's end is an end; empty texts have none."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(lens)
    if not len(texts) or not stop[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gear(np.frombuffer(b"".join(texts), np.uint8))
    hit = np.flatnonzero(h < (1 << 16) // every) + 1
    owner = np.searchsorted(stop, hit, "left")
    begin = stop - lens
    inside = hit - begin[owner] >= REACH
    quiet = np.concatenate(([True], np.diff(hit) >= REACH)) if len(hit) else np.zeros(0, bool)
    ends = np.unique(np.concatenate((hit[inside & quiet], stop[lens > 0])))
    owner = np.searchsorted(stop, ends, "left")
    start = np.maximum(np.concatenate(([0], ends[:-1])), begin[owner])
    more = (ends - start - 1) // longest
    if more.any():
        which = np.repeat(np.arange(len(ends)), more)
        k = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate((ends, start[which] + k * longest)))
        owner = np.searchsorted(stop, ends, "left")
    return ends, owner


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __kw_key: the identifier where it is a row's own; rows that share an identifier, or have none, get a number of identifier and text beyond all usual ones, and so come last."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("__kw_id")).filter("__kw_id IS NOT NULL")
    several = cut(ids.groupBy("__kw_id").agg(F.count("*").alias("n")).filter("n > 1").select("__kw_id", F.lit(True).alias("__kw_several")))
    n = several.count()
    found = docs.join(F.broadcast(several) if n <= FEW else several, F.col(id_col).cast("bigint") == F.col("__kw_id"), "left") if n else docs.withColumn("__kw_several", F.lit(None).cast("boolean"))
    other = F.xxhash64(F.col(id_col), F.col(text_col).cast("binary")).bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62))
    own = F.col(id_col).isNotNull() & F.col("__kw_several").isNull()
    return found.withColumn("__kw_key", F.when(own, F.col(id_col).cast("bigint")).otherwise(other)).drop("__kw_id", "__kw_several")


def _texts(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.select(F.col("__kw_key").alias("row"), F.col(text_col).cast("binary").alias("text")).filter("octet_length(text) > 0")


#: A chunk in one number: where it starts, and its size, the words that begin in it, in the one before and in the one after it (8 bits each; a chunk of LONGEST bytes has fewer than 256 words).
_PLACE = {"start": "shiftright(place, 32)", "size": "(shiftright(place, 24) & 255L) + 1L", "words": "shiftright(place, 16) & 255L", "before": "shiftright(place, 8) & 255L", "after": "place & 255L"}


#: An odd number and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Chunks of a window at most: it has 2**14 bytes at most then.
_WINDOW = 64


def windows(digest: np.ndarray, words: np.ndarray, begin: np.ndarray, start: np.ndarray, ends: np.ndarray, owner: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk the digest of its window, from the chunks' digests, and the window's bytes << 8 | words. A span that begins in the chunk before has least_words less that one's words from here on."""
    n = len(digest)
    upto = np.concatenate(([0], words.cumsum()))
    before = np.where(np.concatenate(([False], owner[1:] == owner[:-1])), np.concatenate(([0], words[:-1])), 0) if n else words
    last = np.searchsorted(upto, upto[:-1] + np.maximum(0, least_words - 1 - before), "right") - 1  # chunks up to this one have no more words
    last = np.minimum(np.minimum(last, np.arange(n) + _WINDOW), np.searchsorted(owner, owner, "right"))
    last = np.maximum(last, np.arange(n) + 1)
    with np.errstate(over="ignore"):
        power = np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))).cumprod(dtype=np.uint64)
        back = np.concatenate((np.ones(1, np.uint64), np.full(max(0, n - 1), _BACK))).cumprod(dtype=np.uint64)[:n]
        total = np.concatenate((np.zeros(1, np.uint64), (digest.view(np.uint64) * power[:n]).cumsum(dtype=np.uint64)))
        wide = (total[last] - total[:n]) * back + (last - np.arange(n)).astype(np.uint64)
    size = ends[last - 1] - start if n else ends
    return wide.view(np.int64), size << 8 | np.minimum(upto[last] - upto[:-1], 255)


def chunks(rows: DataFrame, *, text_col: str = "text", every: int = EVERY, longest: int = LONGEST, least_words: int = LEAST_WORDS, group: int = 1 << 22) -> DataFrame:
    """(row, place, digest, wide, reach) of every chunk of keyed() rows; wide and reach: see windows()."""

    def run(batch: pa.RecordBatch):
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        out, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= group):
                size += len(texts[stop])
                stop += 1
            some = texts[at:stop]
            ends, owner = chunk_ends(some, every, longest)
            lens = np.fromiter(map(len, some), np.int64, len(some))
            begin = np.cumsum(lens) - lens
            start = np.maximum(np.concatenate(([0], ends[:-1])), begin[owner]) if len(ends) else ends
            data = b"".join(some)
            space = _SPACE[np.frombuffer(data, np.uint8)]
            first = ~space
            first[1:] &= space[:-1]
            begun = np.concatenate(([0], np.cumsum(first, dtype=np.int32)))
            words = (begun[ends] - begun[start]).astype(np.int64)
            beside = np.where(owner[1:] == owner[:-1], 1, 0)
            before, after = np.concatenate(([0], words[:-1] * beside)), np.concatenate((words[1:] * beside, [0]))
            place = (start - begin[owner]) << 32 | (ends - start - 1) << 24 | words << 16 | before << 8 | after
            digest = np.fromiter([_DIGEST(data[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)], np.uint64, len(ends)).view(np.int64)
            wide, reach = windows(digest, words, begin, start, ends, owner, least_words)
            out.append(pa.RecordBatch.from_arrays([keys.take(pa.array(owner + at)), pa.array(place), pa.array(digest), pa.array(wide), pa.array(reach.astype(np.int32))], ["row", "place", "digest", "wide", "reach"]))
            at = stop
        return pa.Table.from_batches(out)

    if longest > LONGEST:
        raise ValueError(f"chunks have {LONGEST} bytes at most")
    return map_batches(_texts(rows, text_col), "row bigint, place bigint, digest bigint, wide bigint, reach int", run)


def _shared(rows: DataFrame) -> DataFrame:
    """The chunks (row, place, digest, ...) whose digest two rows have, with the first and the last of them. Where the shared digests are few enough, a filter of them (16 MB at most) keeps the others from
    being shuffled; the join that follows is exact in any case."""
    shared = rows.groupBy("digest").agg(F.min("row").alias("first"), F.max("row").alias("last")).filter("first <> last")
    shared = cut(shared)
    bits = filter_bits(shared.count())
    if bits:
        at = F.pmod("digest", F.lit(bits))
        word, bit = F.shiftright(at, 6), F.expr(f"shiftleft(1L, cast(pmod(pmod(digest, {bits}L), 64) as int))")
        table = shared.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
        rows = rows.join(F.broadcast(table), (word == F.col("word")) & (F.col("bits").bitwiseAND(bit) != 0)).drop("word", "bits")
    return rows.join(shared, "digest")


def _runs(rows: DataFrame, least_words: int, least_bytes: int) -> DataFrame:
    """Runs (run, row, start, end, words, chunks) that their partner has too: partner, moved (how much later it stands there), first and own (this row is the first). A chunk is looked at if it
    and its shared neighbours could, with the whole of the chunks around them, make a span."""
    found = _shared(rows).select("row", "digest", "wide", "reach", "first", "last", *[F.expr(e).alias(n) for n, e in _PLACE.items()]).distinct()
    order = Window.partitionBy("row").orderBy("start")
    new = F.coalesce(F.lag(F.col("start") + F.col("size")).over(order) < F.col("start"), F.lit(True))
    island = Window.partitionBy("row", "island")
    found = found.withColumn("island", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.withColumn("sum", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
    begin, end = F.min("start").over(island), F.max(F.col("start") + F.col("size")).over(island)
    reach_words = F.sum("words").over(island) + F.min_by("before", "start").over(island) + F.max_by("after", "start").over(island)
    found = found.withColumn("could", (reach_words >= least_words - 1) | (end - begin + 2 * LONGEST >= least_bytes)).filter("could")
    at = scratch(rows.sparkSession, "islands")  # packed, where a checkpoint isn't
    found.select("row", "digest", "wide", "reach", F.col("start").cast("int"), F.col("size").cast("int"), F.col("words").cast("int"), F.col("sum").cast("int"), "first", "last").write.option("compression", "zstd").parquet(at)
    found = rows.sparkSession.read.parquet(at)
    holders = found.groupBy("wide").agg(F.min("row").alias("wfirst"), F.max("row").alias("wlast")).filter("wfirst <> wlast")
    joined = found.join(holders, "wide", "left")
    # a window says all that its first chunk does, if both have the same holders
    window = F.struct(F.col("wide").alias("digest"), F.shiftright("reach", 8).alias("size"), F.col("reach").bitwiseAND(F.lit(255)).alias("words"), F.col("wfirst").alias("first"), F.col("wlast").alias("last"), F.lit(1).alias("kind"))
    chunk = F.struct("digest", "size", "words", "first", "last", F.lit(0).alias("kind"))
    same = (F.col("wfirst") == F.col("first")) & (F.col("wlast") == F.col("last"))
    held = F.when(F.col("wfirst").isNull(), F.array(chunk)).when(same, F.array(window)).otherwise(F.array(chunk, window))
    each = joined.select("row", "start", "sum", F.explode(held).alias("h")).select("row", "start", "sum", "h.*")
    each = each.withColumn("partner", F.when(F.col("row") == F.col("first"), F.col("last")).otherwise(F.col("first"))).drop("last")
    places = found.select("row", "start", F.explode(F.array(F.struct("digest", F.lit(0).alias("kind")), F.struct(F.col("wide").alias("digest"), F.lit(1).alias("kind")))).alias("k")).select("k.*", F.col("row").alias("partner"), "start")
    places = places.groupBy("digest", "partner", "kind").agg(F.array_distinct(F.array(F.min("start"), F.max("start"))).alias("there"))
    each = each.join(places, ["digest", "partner", "kind"]).withColumn("there", F.explode("there")).withColumn("moved", (F.col("there") - F.col("start")).cast("bigint"))
    # a chunk and a window that stand in the same place are one
    each = each.groupBy("row", "partner", "moved", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"), F.min("sum").alias("sum"), F.max(F.col("sum") + F.col("words")).alias("upto"), F.lit(1).alias("one"), F.min("first").alias("first"))
    order = Window.partitionBy("row", "partner", "moved").orderBy("start")
    new = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start"), F.lit(True))
    runs = each.withColumn("nth", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("row", "partner", "moved", "nth").agg(F.min("start").cast("bigint").alias("start"), F.max("end").cast("bigint").alias("end"), (F.max("upto") - F.min("sum")).cast("bigint").alias("words"), F.sum("one").alias("chunks"), F.min("first").alias("first"))
    return runs.drop("nth").withColumns({"run": F.monotonically_increasing_id(), "own": F.col("partner") > F.col("row")})


def _surroundings(rows: DataFrame, places: DataFrame, text_col: str, reached: int) -> DataFrame:
    """(row, at, left, around) of each place (row, at, left): the bytes from reached before it to 3 after it, or the other way round. Texts are shuffled only if there are many places."""
    wanted = cut(places.groupBy("row").agg(F.collect_set(F.struct("at", "left")).alias("wanted")))
    n = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        take, at, left, around = [], [], [], []
        for i, (text, wanted) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
            raw = text.as_py()
            for w in wanted:
                a = w["at"]
                take.append(i), at.append(a), left.append(w["left"])
                around.append(raw[max(0, a - reached) : a + 3] if w["left"] else raw[max(0, a - 3) : a + reached])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(at, pa.int64()), pa.array(left, pa.bool_()), pa.array(around, pa.binary())], ["row", "at", "left", "around"])

    return map_batches(_texts(rows, text_col).join(F.broadcast(wanted) if n <= FEW else wanted, "row"), "row bigint, at bigint, left boolean, around binary", run)


def extended(own: bytes, other: bytes, own_at: int, other_at: int, left: bool, reached: int) -> tuple[int, int, bool]:
    """By how many bytes (it may be a few less than none) a run grows at one end, how many words begin in them, and whether it goes on beyond what was read. own and other are the surroundings of the
    end, which stands at own_at and other_at."""
    if left:
        x, y = min(own_at, reached), min(other_at, reached)  # where the end is in each
        n, most = 0, min(x, y)
        while n < most and own[x - n - 1] == other[y - n - 1]:
            n += 1
        more = n == reached
        if more:
            n -= 4  # the byte before is known, then
        while not more and n > -3 and x - n < len(own) and own[x - n] & 0xC0 == 0x80:
            n -= 1
        part = own[x - n : x] if n > 0 else b""
        before = own[x - n - 1 : x - n] if x > n else b""
    else:
        x, y = min(own_at, 3), min(other_at, 3)
        n, most = 0, min(len(own) - x, len(other) - y)
        while n < most and own[x + n] == other[y + n]:
            n += 1
        more = n == reached
        while not more and n > -3 and x + n < len(own) and own[x + n] & 0xC0 == 0x80:
            n -= 1
        part = own[x : x + n] if n > 0 else b""
        before = own[x - 1 : x] if x else b""
    space = [_SPACE[c] for c in before + part]
    skip = len(before)
    words = sum(not space[i] and (i == 0 or space[i - 1]) for i in range(skip, len(space))) if part else 0
    return n, words, more


def _grow(reached: int):
    @F.arrow_udf("struct<n int, words int, more boolean>")
    def grow(own: pa.Array, other: pa.Array, own_at: pa.Array, other_at: pa.Array, left: pa.Array) -> pa.Array:
        found = [extended(*r, reached) for r in zip(*(c.to_pylist() for c in (own, other, own_at, other_at, left)), strict=True)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.bool_())], ["n", "words", "more"])

    return grow


def _grown(rows: DataFrame, runs: DataFrame, text_col: str, reached: int) -> DataFrame:
    """(run, before, after, more): bytes by which each run grows at its beginning and its end, and words that begin in them. Ends that reach beyond what was read go on with eight times as much."""
    ends = runs.select("run", "row", "partner", "moved", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("start").alias("at")), F.struct(F.lit(False).alias("left"), F.col("end").alias("at")))).alias("e")).select("run", "row", "partner", "moved", "e.left", "e.at")
    parts = []
    while True:
        here = ends.withColumn("there", F.col("at") + F.col("moved"))
        places = here.select("row", "at", "left").unionByName(here.select(F.col("partner").alias("row"), F.col("there").alias("at"), "left")).distinct()
        around = cut(_surroundings(rows, places, text_col, reached).dropDuplicates(["row", "at", "left"]))
        both = here.join(around, ["row", "at", "left"]).withColumnRenamed("around", "own")
        both = both.join(around.select(F.col("row").alias("partner"), F.col("at").alias("there"), "left", F.col("around").alias("other")), ["partner", "there", "left"])
        seen = cut(both.select("run", "row", "partner", "moved", "left", "at", _grow(reached)("own", "other", "at", "there", "left").alias("g")))
        parts.append(seen.select("run", "left", "g.n", "g.words"))
        ends = seen.filter("g.more").select("run", "row", "partner", "moved", "left", F.when(F.col("left"), F.col("at") - F.col("g.n")).otherwise(F.col("at") + F.col("g.n")).alias("at"))
        if ends.isEmpty():
            break
        reached *= 8
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("run").agg(F.sum(F.when(F.col("left"), F.col("n"))).alias("before"), F.sum(F.when(~F.col("left"), F.col("n"))).alias("after"), F.sum("words").alias("more"))


def spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_bytes: int = LEAST_BYTES, every: int = EVERY, longest: int = LONGEST, reached: int = REACHED
) -> DataFrame:
    """One row per repeated span: id, row, start and size (bytes), words (that begin in it), chunks, first_id (the first document that has its chunks) and repeated (false in that document itself). Spans of one
    document may overlap, if it shares one stretch with one partner and another stretch with another."""
    spark = docs.sparkSession
    bounded(spark)
    rows, at = keyed(docs, id_col, text_col), scratch(spark, "chunks")
    chunks(rows, text_col=text_col, every=every, longest=longest, least_words=least_words).write.parquet(at)
    runs = cut(_runs(spark.read.parquet(at), least_words, least_bytes))
    grew = _grown(rows, runs, text_col, reached)
    whole = runs.join(grew, "run").select("row", "partner", "moved", (F.col("start") - F.col("before")).alias("start"), (F.col("end") + F.col("after")).alias("end"), (F.col("words") + F.col("more")).alias("words"), "chunks", "first", "own")
    # runs that chunks of another partner had parted end at the same bytes now: they are one stretch
    order = Window.partitionBy("row", "partner", "moved").orderBy("start")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = whole.withColumn("upto", upto).withColumn("nth", F.sum(F.coalesce((F.col("upto") < F.col("start")).cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # words of an overlap count in part: as many as its share of the later run's bytes
    fresh = F.ceil(F.col("words") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("end") - F.greatest("start", F.coalesce("upto", "start"))) / F.greatest(F.col("end") - F.col("start"), F.lit(1)))))
    joined = parted.withColumn("fresh", F.when(F.col("upto") >= F.col("start"), fresh).otherwise(F.col("words")))
    joined = joined.groupBy("row", "partner", "moved", "nth").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("size"), F.sum("fresh").cast("bigint").alias("words"), F.sum("chunks").alias("chunks"), F.min("first").alias("first"), F.first("own").alias("own"))
    long = joined.filter((F.col("words") >= least_words - 1) | (F.col("size") >= least_bytes))
    names = _named(rows, id_col)
    named = long if names is None else long.join(names.withColumnsRenamed({"key": "row", "name": "id"}), "row").join(names.withColumnsRenamed({"key": "first", "name": "first_id"}), "first")
    if names is None:
        named = long.withColumns({"id": F.col("row"), "first_id": F.col("first")})
    return named.select("id", "row", "start", "size", "words", "chunks", "first_id", (~F.col("own")).alias("repeated"))


def _named(rows: DataFrame, id_col: str) -> DataFrame | None:
    """(key, name): the identifier of each key, or None if they are the same for all rows."""
    own = rows.select(F.col("__kw_key").alias("key"), F.col(id_col).cast("bigint").alias("name"))
    return None if own.filter(~F.col("key").eqNullSafe(F.col("name"))).isEmpty() else cut(own.distinct())


def remove(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated spans cut out of their texts; spans begin and end between characters. Only documents with such spans are joined."""
    own = found.filter("repeated").groupBy(F.col("row").alias("__kw_row")).agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("__kw_spans"))
    joined = keyed(docs, id_col, text_col).join(own, F.col("__kw_key") == F.col("__kw_row"), "left").drop("__kw_row", "__kw_key")
    raw = F.col(text_col).cast("binary")
    part = lambda a, n: F.substring(raw, a.cast("int"), n.cast("int"))
    kept = F.aggregate(
        F.col("__kw_spans"),
        F.struct(F.lit(1).cast("bigint").alias("at"), F.unhex(F.lit("")).alias("out")),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["start"] + s["size"] + 1).alias("at"), F.concat(acc["out"], part(acc["at"], F.greatest(F.lit(0), s["start"] + 1 - acc["at"]))).alias("out")),
        lambda acc: F.concat(acc["out"], part(acc["at"], F.lit(2147483647))),
    )
    text = F.when(F.col("__kw_spans").isNull(), F.col(text_col)).otherwise(kept.cast("string"))
    return joined.withColumn(text_col, text).select(*docs.columns)
