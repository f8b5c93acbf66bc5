"""URL filter: host and path rules, and for all other URLs the ratio of two character language models.

Accepted and rejected URLs each train a variable-order Markov model: the chance of a character after its longest context blends the contexts of all shorter lengths by Witten-Bell weights, down
to a uniform one. A URL's score is the difference of its log-likelihoods under both, divided by its length. It is accepted from a threshold on, the one that errs least on held-back labelled URLs.

Every labelled URL takes part, whole: three quarters are counted, the others place the threshold. Counts, chances and threshold stay in Spark tables. A gram is a character with its context; its chance
follows level by level, by joins of grams with those of a context one shorter, of which one has 256 longer ones at most. URLs are scored in blocks: a block asks for each of its grams once, so a gram
that all URLs have is one row a block.

A URL's host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; its path then goes up to `?`, `#` or the end. A rule fits its host and every subdomain of it if the path
begins with the rule's; of fitting rules the longest (host and path) decides, and of equally long ones the alphabetically first. Labels for training are the rules' own verdicts.

Defined results: a null URL and one without `://` have empty host and path, fit no rule and are judged by the models as an empty or plain string; without labelled URLs of both
kinds, what no rule blocks is allowed. Repeated rows get equal verdicts; only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import ascii_lower, cut, map_batches
from kinweave.llm.running import running_total

#: Places of a piece of a URL. The first SHARED pieces are in blocks with those of 2**BLOCK rows, at one place of the URL; 2**BLOCK further ones of one URL are a block of its own: 2**21 places at most.
PIECE, BLOCK, SHARED = 512, 12, 8
#: Different characters: the bytes and the end of a URL. A gram is a long: a one, the bytes of the context, and the character in the last bits.
END, SYMBOLS, BITS = 256, 257, 9


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


class Markov:
    """Counts of characters after contexts of 0 to order characters, of a few URLs in memory: the definition that the tables of train() and judge() follow."""

    def __init__(self, order: int = 5, symbols: int = SYMBOLS):
        self.order, self.symbols = order, symbols
        self.counts: dict[bytes, dict[int, int]] = {}
        self.known: dict[bytes, float] = {}

    def train(self, urls: list[bytes]) -> Markov:
        counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for url in urls:
            for i in range(len(url) + 1):
                c = url[i] if i < len(url) else 256
                for k in range(min(self.order, i) + 1):
                    counts[url[i - k : i]][c] += 1
        self.counts = {k: dict(v) | {-1: sum(v.values())} for k, v in counts.items()}
        return self

    def chance(self, context: bytes, c: int) -> float:
        p = 1 / self.symbols
        for k in range(len(context) + 1):
            seen = self.counts.get(context[len(context) - k :])
            if seen is None:
                break
            total, kinds = seen[-1], len(seen) - 1
            p = (seen.get(c, 0) + kinds * p) / (total + kinds)
        return p

    def log_likelihood(self, url: bytes) -> float:
        return sum(log(self.chance(url[max(0, i - self.order) : i], url[i] if i < len(url) else 256)) for i in range(len(url) + 1))


@dataclass(frozen=True)
class Filter:
    """counts: how often each gram of the longest context (gram, a, b) is in accepted and in rejected URLs."""

    counts: DataFrame | None
    threshold: float = 0.0
    order: int = 5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path columns, never null."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__kw_url, instr(__kw_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule (null if none fits), allowed (null if none fits)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("__kw_url"))
    host, path = host_path(F.col("__kw_url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, allowed = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):  # the last that fits wins
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, allowed = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.allow)).otherwise(allowed)
    return rows.select("id", F.col("__kw_url").alias("url"), "host", "path", rule.alias("rule"), allowed.alias("allowed"))


def pieces(rows: DataFrame, order: int) -> DataFrame:
    """The rows' urls (binary) in pieces of PIECE places, the end of a URL being one: number in the URL (j), bytes, led by those of the first place's context (lead), and whether the end is in it (last)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("url").to_pylist()
        number = np.array([len(x) // PIECE + 1 for x in raw], np.int64)
        of = np.repeat(np.arange(len(raw)), number)
        j = np.arange(len(of)) - (np.cumsum(number) - number)[of]
        piece = [x[max(i * PIECE - order, 0) : (i + 1) * PIECE] for x, n in zip(raw, number.tolist()) for i in range(n)]
        arrays = [batch.column(c).take(pa.array(of)) for c in others]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(j), pa.array(piece, pa.binary()), pa.array(np.where(j > 0, order, 0)), pa.array(j == number[of] - 1)], [*others, "j", "piece", "lead", "last"])

    others = [c for c in rows.columns if c != "url"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("url").schema)
    return map_batches(rows, f"{schema}, j long, piece binary, lead long, last boolean", run)


def grams(batch: pa.RecordBatch | pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every place of a batch of pieces its row there and its gram, in the order of rows and places."""
    raw = batch.column("piece").to_pylist()
    lead, last = (batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in ("lead", "last"))
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    stops = np.cumsum(sizes)
    symbols = np.full(sizes.sum(), END, np.int64)
    inner = np.ones(len(symbols), bool)
    inner[stops - 1] = False
    symbols[inner] = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(len(symbols)) - (stops - sizes)[owner]
    found = np.ones(len(symbols), np.int64)
    for k in range(min(order, len(symbols) - 1), 0, -1):
        has = np.flatnonzero(at >= k)
        found[has] = found[has] << 8 | symbols[has - k]
    counted = (at >= lead[owner]) & (inner | last[owner])
    return owner[counted], (found << BITS | symbols)[counted]


def count(labelled: DataFrame, order: int) -> DataFrame:
    """gram, a, b: how often it is in accepted and in rejected URLs, from rows (url, allowed)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, gram = grams(batch, order)
        allowed = batch.column("allowed").to_numpy(zero_copy_only=False)[owner]
        found, place = np.unique(gram, return_inverse=True)
        a, b = (np.bincount(place[of], minlength=len(found)).astype(np.int64) for of in (allowed, ~allowed))
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(a), pa.array(b)], ["gram", "a", "b"])

    return map_batches(pieces(labelled, order), "gram long, a long, b long", run).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def shortened(gram: Column, k: int) -> Column:
    """The gram with the last k bytes of its context; the gram itself if it has no more."""
    low = (1 << 8 * k + BITS) - 1
    return F.when(gram > 2 * low + 1, gram.bitwiseAND(F.lit(low)).bitwiseOR(F.lit(low + 1))).otherwise(gram)


def chances(counts: DataFrame, order: int) -> DataFrame:
    """gram, p_a, p_b: the chance of every gram of counts (gram, a, b) in accepted and in rejected URLs.

    Level k has the grams shortened to k bytes of context; those that are shorter anyway keep the chance of their own level. A context is followed by at most SYMBOLS characters, so no key has many rows."""
    found = None
    for k in range(order + 1):
        after = Window.partitionBy(F.shiftright("gram", BITS))
        level = counts.groupBy(shortened(F.col("gram"), k).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = level.withColumns({f"all_{x}": F.sum(x).over(after) for x in "ab"} | {f"kinds_{x}": F.count_if(F.col(x) > 0).over(after) for x in "ab"})
        if found is None:
            level = level.withColumns({f"p_{x}": F.lit(1 / SYMBOLS) for x in "ab"})
        else:
            level = level.withColumn("shorter", shortened(F.col("gram"), k - 1)).join(found.withColumnRenamed("gram", "shorter"), "shorter")
        own = F.col("gram") >= 1 << 8 * k + BITS
        blend = lambda x: (F.col(x) + F.col(f"kinds_{x}") * F.col(f"p_{x}")) / (F.col(f"all_{x}") + F.col(f"kinds_{x}"))
        found = level.select("gram", *(F.when(own & (F.col(f"all_{x}") > 0), blend(x)).otherwise(F.col(f"p_{x}")).alias(f"p_{x}") for x in "ab"))
    return found


def ratios(rows: DataFrame, model: Filter) -> DataFrame:
    """row, ratio: the difference of the log-likelihoods, from rows (row, url), held in the shared folder, whose row is from monotonically_increasing_id()."""
    order = model.order
    shared = F.col("j") < SHARED
    block, part = F.when(shared, F.shiftright("row", BLOCK)).otherwise(F.col("row")), F.when(shared, F.col("j")).otherwise(F.shiftright(F.col("j") - SHARED, BLOCK) + SHARED)
    parts = pieces(rows.select("row", "url"), order).withColumn("block", block).withColumn("part", part)

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, gram = grams(batch, order)
        keys, of = np.unique(np.stack([batch.column(c).to_numpy() for c in ("block", "part")]), axis=1, return_inverse=True)
        of = of.reshape(-1)[owner]
        by = np.argsort(of, kind="stable")
        asked = [np.unique(x) for x in np.split(gram[by], np.searchsorted(of[by], np.arange(1, keys.shape[1])))]
        block, part = (np.repeat(x, [len(y) for y in asked]) for x in keys)
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(part), pa.array(np.concatenate(asked))], ["block", "part", "gram"])

    def total(own: pa.Table, known: pa.Table) -> pa.Table:
        owner, gram = grams(own, order)
        keys, values = known.column("gram").to_numpy(), known.column("ratio").to_numpy()
        by = np.argsort(keys)
        sums = np.bincount(owner, values[by][np.searchsorted(keys[by], gram)], own.num_rows)
        return pa.table({"row": own.column("row"), "j": own.column("j"), "ratio": pa.array(sums)})

    asked = cut(map_batches(parts, "block long, part long, gram long", ask).distinct())
    none = F.lit(0).cast("long")
    counts = model.counts.unionByName(asked.select("gram").distinct().select("gram", none.alias("a"), none.alias("b"))).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    known = asked.join(chances(counts, order).select("gram", (F.ln("p_a") - F.ln("p_b")).alias("ratio")), "gram")
    sums = parts.groupBy("block", "part").cogroup(known.groupBy("block", "part")).applyInArrow(total, "row long, j long, ratio double")
    in_order = F.array_sort(F.collect_list(F.struct("j", "ratio")))  # equal URLs add up alike
    return sums.groupBy("row").agg(F.aggregate(in_order, F.lit(0.0), lambda s, x: s + x["ratio"]).alias("ratio"))


def scores(rows: DataFrame, model: Filter) -> DataFrame:
    """The rows (row, url and more; see ratios) with score, positive: likelier accepted."""
    return rows.join(ratios(rows, model), "row").withColumn("score", F.col("ratio") / (F.octet_length("url") + 1) - model.threshold).drop("ratio")


def best_cut(scored: DataFrame, allowed: int, blocked: int) -> float:
    """The threshold, between two scores, that errs least on rows (score, allowed), both classes weighing alike, of which there are so many; of equally good ones that nearest to 0."""
    large = lambda n: F.lit(n).cast("decimal(19,0)")
    # what the sum of both classes' rates of errors gains where the threshold rises over a score, times both numbers
    rise = F.count_if("allowed").cast("decimal(19,0)") * large(blocked) - F.count_if(~F.col("allowed")).cast("decimal(19,0)") * large(allowed)
    errors = running_total(scored.groupBy("score").agg(rise.alias("rise")), [], "score", "rise", "errors")
    upper = errors.orderBy("errors", F.abs("score"), "score").first()["score"]
    lower = scored.filter(F.col("score") < upper).agg(F.max("score")).first()[0]
    middle = upper - 1 if lower is None else (lower + upper) / 2
    return upper if lower is not None and middle <= lower else middle


def train(labelled: DataFrame, *, order: int = 5) -> Filter:
    """A filter from rows (id, url, allowed): every row with both counts, three quarters in the models and the others, by a hash, for the threshold."""
    url = F.col("url").cast("binary")
    key = F.xxhash64("id", url, F.lit(77))
    known = labelled.filter("allowed IS NOT NULL AND url IS NOT NULL").select(url.alias("url"), "allowed", (F.pmod(F.xxhash64(key, F.lit(9)), F.lit(4)) == 0).alias("held"))
    known = cut(known.withColumn("row", F.monotonically_increasing_id()))
    number = {(r["allowed"], r["held"]): r["count"] for r in known.groupBy("allowed", "held").count().collect()}
    if len({allowed for allowed, _ in number}) < 2:
        return Filter(None)
    found = Filter(cut(count(known.filter("NOT held").select("url", "allowed"), order)), order=order)
    if (True, True) not in number or (False, True) not in number:
        return found
    scored = cut(scores(known.filter("held").select("row", "url", "allowed"), found).select("score", "allowed"))
    return Filter(found.counts, best_cut(scored, number[True, True], number[False, True]), order)


def judge(rows: DataFrame, model: Filter) -> DataFrame:
    """The rows of ruled() with score and verdict. Only the URL goes to Python."""
    if model.counts is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        held = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        found = scores(held.select("row", F.coalesce(F.col("url").cast("binary"), F.lit(b"")).alias("url")), model)
        scored = held.join(found.select("row", "score"), "row")
    return scored.select("id", "url", "host", "path", "rule", "score", F.when(F.coalesce("allowed", F.col("score") >= 0), "allow").otherwise("block").alias("verdict"))
