"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in the order of their identifiers, make blocks of block_chars characters; a document belongs to the block in which it begins. Source s with share a of the sum H of
all shares gets, for its block j (from 0), the release time floor(j * H / a) and the deadline ceil((j + 1) * H / a). Slots are given by earliest deadline first among the released blocks (ties:
the alphabetically first source). Every deadline is met, so after any number of slots a source has had less than one block more or less than its weight asks for. The schedule repeats after H
slots (shares are first divided by their greatest common divisor); one such cycle is computed and every block's slot follows from it.

When a source has run out its slots stay empty and the others go on in the same proportion; no document is dropped or repeated.

Defined results: a null source is a source of its own (alphabetically first, as ''); null and empty texts have 0 characters and stand in the block that is current; null identifiers
come first; ties and repeated rows are ordered by length. An empty table gives no rows. Only the named columns are read. Shares may have any sum: a cycle that is too long to be computed
by array functions and broadcast (MOST_SLOTS, MOST_STEPS) comes from a heap of the sources in one Arrow task, which holds a row per source, and is joined by a shuffle.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut
from kinweave.llm.running import running_total

#: Slots of a cycle that is broadcast, and slots times sources of one that is computed by array functions.
MOST_SLOTS, MOST_STEPS = 1 << 14, 1 << 20


def _simulated(batches):
    """Rows (source, share) to (source, share, total, nth, slot) of one cycle: earliest deadline first, with a heap of the sources whose next block is released and one of those to come."""
    sources = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    total = sum(a for _, a in sources)
    ready, later, done = [(-(-total // a), k) for k, (_, a) in enumerate(sources) if a], [], [0] * len(sources)
    heapq.heapify(ready)
    for first in range(0, total, 1 << 16):
        picks = []
        for t in range(first, min(total, first + (1 << 16))):
            while later and later[0][0] <= t:
                k = heapq.heappop(later)[1]
                heapq.heappush(ready, (-(-(done[k] + 1) * total // sources[k][1]), k))
            _, k = heapq.heappop(ready)
            picks.append((sources[k][0], sources[k][1], total, done[k], t))
            done[k] += 1
            if done[k] < sources[k][1]:
                heapq.heappush(later, (done[k] * total // sources[k][1], k))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*picks, strict=True))], ["source", "share", "total", "nth", "slot"])


def cycle(shares: DataFrame, most_slots: int = MOST_SLOTS, most_steps: int = MOST_STEPS) -> tuple[DataFrame, bool]:
    """(source, share, total, nth, slot) for one cycle, from (source, share), and whether it may be broadcast: share rows for each source."""
    shares = cut(shares.select("source", F.col("share").cast("bigint").alias("share")))
    gcd = "aggregate(collect_set(share), 0L, (a, b) -> aggregate(sequence(1, 100), named_struct('a', a, 'b', b), (s, _) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a))"
    one = shares.agg(F.count("*").alias("n"), F.coalesce(F.sum("share"), F.lit(0)).alias("h"), F.expr(gcd).alias("g")).first()
    n, g = one["n"], max(1, one["g"] or 1)
    h = one["h"] // g
    shares = shares.withColumn("share", F.expr(f"share div {g}L"))
    if h > most_slots or h * n > most_steps:
        return cut(shares.coalesce(1).mapInArrow(_simulated, "source string, share bigint, total bigint, nth bigint, slot bigint")), False
    return _arrays(shares), True


def _arrays(shares: DataFrame) -> DataFrame:
    """The same by array functions."""
    one = shares.agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("s"), F.sum("share").alias("h")).filter("h > 0")
    pick = """
        aggregate(sequence(0L, h - 1),
            named_struct('done', transform(s, x -> 0L), 'picks', cast(array() as array<int>)),
            (acc, t) -> element_at(transform(
                array(array_min(transform(
                    filter(sequence(0, size(s) - 1), k -> acc.done[k] < s[k].share and acc.done[k] * h div s[k].share <= t),
                    k -> named_struct('deadline', ((acc.done[k] + 1) * h + s[k].share - 1) div s[k].share, 'k', k))).k),
                p -> named_struct('done', transform(acc.done, (d, j) -> if(j = p, d + 1, d)), 'picks', concat(acc.picks, array(p)))), 1),
            acc -> acc.picks)
    """
    slots = one.select("s", "h", F.posexplode(F.expr(pick)).alias("slot", "k"))
    slots = slots.select(F.expr("s[k].source").alias("source"), F.expr("s[k].share").alias("share"), F.col("h").alias("total"), F.col("slot").cast("bigint").alias("slot"))
    return slots.selectExpr("source", "share", "total", "row_number() over (partition by source order by slot) - 1L as nth", "slot")


def mix(docs: DataFrame, shares: dict[str, int] | None = None, *, default: int = 1, block_chars: int = 1 << 16, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: id, source, chars, block, release, deadline, slot. Sources that shares doesn't name get the default share. Shares must be positive: a source without one would have no slot."""
    if min([default, *(shares or {}).values()]) < 1:
        raise ValueError("every share must be 1 or more")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("key"), F.col(source_col).alias("source"), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("chars"))
    share = F.lit(default)
    for name, a in (shares or {}).items():
        share = F.when(F.col("source") == name, F.lit(a)).otherwise(share)
    plan, small = cycle(rows.select(F.col("key").alias("source")).distinct().withColumn("share", share))
    plan, sent = plan.withColumnRenamed("source", "key"), F.broadcast if small else lambda t: t
    placed = running_total(rows, ["key"], "id", "chars", "before", ["chars"]).withColumn("block", F.expr(f"before div {block_chars}L"))
    first = plan.select("key", "share", "total").distinct()
    placed = placed.join(sent(first), "key").withColumn("nth", F.expr("block % share"))
    placed = placed.join(sent(plan.select("key", "nth", "slot")), ["key", "nth"])
    return placed.selectExpr("id", "source", "chars", "block", "block * total div share as release", "((block + 1) * total + share - 1) div share as deadline", "block div share * total + slot as slot")


def schedule_sql(shares: dict[str, int], default: int, block_chars: int) -> str:
    """The same for DuckDB, over the view documents: the cycle is simulated slot by slot."""
    case = " ".join(f"WHEN '{k}' THEN {a}" for k, a in shares.items())
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS k, coalesce(length(text), 0)::BIGINT AS chars FROM documents),
    s AS (SELECT k, (CASE k {case} ELSE {default} END)::BIGINT AS a FROM (SELECT DISTINCT k FROM d)),
    one AS (SELECT list(k ORDER BY k) AS ks, list(a ORDER BY k) AS shares, sum(a)::BIGINT AS h, count(*)::BIGINT AS n FROM s),
    run AS (
        SELECT 0::BIGINT AS t, list_transform(shares, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM one
        UNION ALL
        SELECT t + 1, list_transform(range(1, n + 1), lambda i: done[i] + (CASE WHEN i = p THEN 1 ELSE 0 END)::BIGINT), p FROM (
            SELECT t, done, n, list_min(list_transform(list_filter(range(1, n + 1), lambda i: done[i] < shares[i] AND done[i] * h // shares[i] <= t),
                lambda i: (((done[i] + 1) * h + shares[i] - 1) // shares[i]) * 1000000 + i)) % 1000000 AS p
            FROM run, one WHERE t < h)
    ),
    plan AS (SELECT ks[pick] AS k, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM run, one WHERE t > 0),
    b AS (SELECT doc_id, source, k, chars, (sum(chars) OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, chars ROWS UNBOUNDED PRECEDING) - chars)::BIGINT // {block_chars} AS block FROM d)
    SELECT b.doc_id, b.source, b.chars, b.block, b.block * h // a AS release, ((b.block + 1) * h + a - 1) // a AS deadline, b.block // a * h + slot AS slot
    FROM b JOIN s ON b.k = s.k JOIN plan ON plan.k = b.k AND plan.nth = b.block % a, one
    """
