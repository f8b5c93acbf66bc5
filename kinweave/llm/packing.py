"""Packing documents into training sequences by non-negative least squares over the length histogram.

Each document is tokenized and gets an end token. What fills whole windows is cut off as sequences of their own; of the rest (under a window) a histogram over bins of `unit` tokens
(lengths rounded up) goes to the driver: window / unit numbers at any input size. There all shallow combinations (up to three bins) that fill a window exactly are listed, the numbers of
repeats are solved as a non-negative least-squares fit to the histogram and rounded, and what is left is packed greedily (longest first, each sequence filled with the longest that fit, and
as often as the histogram allows). Documents get their places by rank within their bin, so no task sees a whole bin. Ranks and uses of patterns are dealt stratum by stratum, so the
sequences follow the order of the documents: if that is a mix of sources, any run of sequences is about such a mix.

Defined results: null and empty texts are the end token alone; repeated rows and ties are packed each on its own; a null identifier is packed like any other and comes first; an
empty table gives no rows. Texts of any length are tokenized whole. Only the named columns are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import KEPT, cut, map_batches
from kinweave.llm.running import running_total

WINDOW = 4096
UNIT = 16
#: Strata of the order that sequences follow.
STRATA = 64

#: Characters below U+0180 that are letters and whose lower-case form is one such letter (all but U+0130).
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
#: Runs made of such letters, digits and signs only; without apostrophes (contractions) and `<` (special tokens).
_SIMPLE = "^[!-&(-;=-~¡-įı-ſ]+$"
#: Bytes of a kept entry besides its key and ids.
_ENTRY = 150


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[starts[w] : starts[w] + lens[w]] of all w in which, one after another, and the length of each."""
    n = lens[which]
    before = np.cumsum(n) - n
    at = np.repeat((starts[which] - before).astype(np.int32), n)  # places in a group of some MB
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], n


class ChunkTokenizer:
    """Ids of whole texts from a tokenizers file whose pre-tokenizer breaks at white space and between letters and anything else, and whose words end in a token with a suffix.

    White space always ends a pre-token, so the ids of a text are those of its runs between ASCII white space, one after another. The different runs of a group of texts are found first; simple ones
    are lower-cased, as the normaliser does it, and cut into words and what is between, any other run is left as it is. Each different piece is tokenized by the library, words many at a time (their
    ids part at the tokens with the suffix), and the texts' ids are gathered from the pieces' by position. Ids of pieces are kept up to `room` bytes; then all are forgotten."""

    def __init__(self, path: str, room: int = 34 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        found = re.search(r'"end_of_word_suffix"\s*:\s*(null|"(?:[^"\\]|\\.)*")', self.tokenizer.to_str())  # not the whole file as objects
        suffix = json.loads(found[1]) if found else None
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("ÀB") == "àb"
        self.room, self.held, self.known = room, 0, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(pieces, ids, strict=True))
        self.held += sum(map(len, pieces)) + sum(map(len, ids)) + _ENTRY * len(pieces)

    def _words(self, words: list[str]) -> None:
        """Keep the ids of words, a few hundred at a time as one text."""
        groups = [words[a : a + 256] for a in range(0, len(words), 256)]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                raw, ends = ids.tobytes(), (ends * 4).tolist()
                self._keep(group, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
            else:
                self._keep(group, self._whole(group))

    def _ids(self, pieces: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces one after another, and where each piece's begin and how many there are. words: which pieces are words."""
        strings, known = pieces.to_pylist(), self.known
        new = [(p, w) for p, w in zip(strings, words.tolist(), strict=True) if p not in known]
        self._words([p for p, w in new if w])
        rest = [p for p, w in new if not w]
        for a in range(0, len(rest), 4096):
            self._keep(rest[a : a + 4096], self._whole(rest[a : a + 4096]))
        raw = [known[p] for p in strings]
        lens = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        return np.frombuffer(b"".join(raw), "<u4"), np.cumsum(lens) - lens, lens

    def _group(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after another, and the number of each text's."""
        if self.held > self.room:
            self.known.clear()
            self.held = 0
        try:
            column = pa.array(texts, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:  # malformed bytes become U+FFFD
            column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        runs = pc.ascii_split_whitespace(column)
        per_text = np.diff(runs.offsets.to_numpy())
        coded = runs.flatten().dictionary_encode()
        which, different = coded.indices.to_numpy(), coded.dictionary
        simple = np.zeros(len(different), bool)
        if self.lowers:
            simple = pc.match_substring_regex(different, _SIMPLE).to_numpy(zero_copy_only=False)
        spread = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(different.filter(pa.array(simple))), f"([{_LETTERS}]+)", r" \1 "))
        pieces = pa.concat_arrays([spread.flatten(), different.filter(pa.array(~simple))]).dictionary_encode()
        place, strings = pieces.indices.to_numpy(), pieces.dictionary
        words = pc.match_substring_regex(strings, f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False) if self.lowers else np.zeros(len(strings), bool)
        flat, starts, lens = self._ids(strings, words)
        # the ids of each different run: those of its pieces
        in_run = np.ones(len(different), np.int64)
        in_run[simple] = np.diff(spread.offsets.to_numpy())
        first = np.empty(len(different), np.int64)  # simple runs' pieces come first, then the others
        first[simple] = spread.offsets.to_numpy()[:-1]
        first[~simple] = len(spread.flatten()) + np.arange((~simple).sum())
        order, _ = ragged(place.astype(np.int64), first, in_run, np.arange(len(different)))
        flat, per_piece = ragged(flat, starts, lens, order)
        ends = np.concatenate(([0], np.cumsum(per_piece)))
        last = np.cumsum(in_run)
        lens = ends[last] - ends[last - in_run]
        ids, per_run = ragged(flat, ends[last - in_run], lens, which)
        total = np.concatenate(([0], np.cumsum(per_run)))
        stop = np.cumsum(per_text)
        return ids, total[stop] - total[stop - per_text]

    def encode_batch(self, texts: list[bytes | None], group: int = 1 << 22) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Texts are worked off in groups of about `group` bytes, longer ones in slices that end at white space."""
        slices: list[bytes] = []
        of: list[int] = []
        for i, t in enumerate(texts):
            t, at = t or b"", 0
            while len(t) - at > group and (space := max(t.rfind(c, at, at + group) for c in (b" ", b"\n", b"\t"))) > at:
                slices.append(t[at:space]), of.append(i)
                at = space
            slices.append(t[at:] if at else t), of.append(i)
        out: list[list[bytes]] = [[] for _ in texts]
        at = 0
        while at < len(slices):
            stop, size = at, 0
            while stop < len(slices) and (stop == at or size + len(slices[stop]) <= group):
                size += len(slices[stop])
                stop += 1
            ids, counts = self._group(slices[at:stop])
            raw, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
            for i, a, b in zip(of[at:stop], [0, *ends[:-1]], ends, strict=True):
                out[i].append(raw[a:b])
            at = stop
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


_tokenizers: dict[str, ChunkTokenizer] = {}
KEPT["packing"] = _tokenizers


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, *, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ord, id, start, length, ids_crc32, doc_tokens, and ids (binary, little-endian 32-bit) if asked for. Whole windows come first, then the rest of the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tail = np.array([end_id], "<u4").tobytes()
        take, start, length, crc, total, ids = [], [], [], [], [], []
        for i, coded in enumerate(chunk_tokenizer(path).encode_batch(batch.column(2).to_pylist())):
            coded += tail
            n, view = len(coded) // 4, memoryview(coded)
            for a in range(0, n, window):
                b = min(a + window, n)
                take.append(i), start.append(a), length.append(b - a), total.append(n), crc.append(zlib.crc32(view[4 * a : 4 * b]))
                if with_ids:
                    ids.append(bytes(view[4 * a : 4 * b]))
        at = pa.array(take, pa.int64())
        columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, ["ord", "id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    rows = docs.select(F.col(order_col or id_col).cast("bigint").alias("ord"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, "ord bigint, id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids, run, keeps="packing")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson. Every step lowers the residual, so no set of columns comes twice and the search ends by itself."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slope, ridge = a.T @ b, 1e-12 * float((a * a).sum(0).max(initial=1.0))  # so that columns that are sums of others don't stop the solver
    eps, least = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0))), np.inf
    while True:
        free, now = ~passive & (slope > eps), float(np.linalg.norm(a @ x - b))
        if not free.any() or now >= least:  # the second: rounding errors are all that is left
            return x
        least = now
        passive[np.argmax(np.where(free, slope, -np.inf))] = True
        while True:
            p = np.flatnonzero(passive)
            own = a[:, p]
            z = np.linalg.lstsq(own.T @ own, own.T @ b, rcond=None)[0] if len(p) > len(b) else np.linalg.solve(own.T @ own + ridge * np.eye(len(p)), own.T @ b)
            if (z > eps * 1e-3).all() or not len(p):
                x[:] = 0
                x[p] = z
                break
            low = z <= eps * 1e-3
            step = np.min(x[p][low] / np.maximum(x[p][low] - z[low], 1e-300))
            x[p] += np.clip(step, 0, 1) * (z - x[p])
            passive[p[(x[p] <= eps * 1e-3)]] = False
            x[~passive] = 0
        slope = a.T @ (b - a @ x)


@dataclass(frozen=True)
class Plan:
    """patterns[i] is a list of (bin, copies) that fits a window, used repeats[i] times."""

    patterns: list[list[tuple[int, int]]]
    repeats: list[int]

    @property
    def sequences(self) -> int:
        return sum(self.repeats)

    def places(self, strata: int = STRATA) -> list[tuple[int, int, int, int, int, int, int, int, int]]:
        """(bin, documents of the bin, stratum, first rank, end of ranks, number within the pattern of the first, copies, pattern, order within the sequence). A bin's ranks are cut into strata, and
        every pattern takes its share of each: so the documents of a sequence have like places in the order of their bins. Rank r is in stratum r * strata div (documents of the bin)."""
        by_bin: dict[int, list[tuple[int, int, int, int]]] = {}
        for i, (pattern, m) in enumerate(zip(self.patterns, self.repeats, strict=True)):
            for k, (size, copies) in enumerate(pattern):
                by_bin.setdefault(size, []).append((i, copies, m * copies, k))
        out = []
        for size, users in by_bin.items():
            want = np.array([n for _, _, n, _ in users])
            total, given = int(want.sum()), np.zeros(len(users), np.int64)
            for q in range(strata):
                low, high = -(-q * total // strata), -(-(q + 1) * total // strata)
                if low == high:
                    continue
                due = want * (q + 1) / strata - given
                take = np.maximum(np.floor(due), 0).astype(np.int64)
                for j in np.argsort(take - due, kind="stable"):
                    if take.sum() >= high - low:
                        break
                    take[j] += given[j] + take[j] < want[j]
                while (over := take.sum() - (high - low)) > 0:
                    j = int(np.argmax(np.where(take > 0, take - due, -np.inf)))
                    take[j] -= min(over, 1)
                while (under := high - low - take.sum()) > 0:
                    j = int(np.argmax(want - given - take))
                    take[j] += min(under, want[j] - given[j] - take[j])
                for j in np.flatnonzero(take):
                    i, copies, _, k = users[j]
                    out.append((size, total, q, low, low + int(take[j]), int(given[j]), copies, i, k))
                    low += int(take[j])
                given += take
        return out

    def numbers(self, whole: int, strata: int = STRATA) -> list[tuple[int, int, int, int]]:
        """(pattern, first, end, sequence_id of the first) of the patterns' uses, stratum by stratum; pattern -1 are the sequences of one full window."""
        out, base = [], 0
        upto = lambda q, m: -((strata - 2 * q * m) // (2 * strata))  # noqa: E731  uses whose middle lies before stratum q
        for q in range(strata):
            for i, m in [*enumerate(self.repeats), (-1, whole)]:
                low, high = upto(q, m), upto(q + 1, m)
                if high > low:
                    out.append((i, low, high, base))
                    base += high - low
        return out


def combinations(sizes: list[int], full: int) -> list[tuple[int, ...]]:
    """Up to three of sizes, repeats allowed, that sum to full."""
    have, out = set(sizes), []
    for i, x in enumerate(sizes):
        if x == full:
            out.append((x,))
        if 2 * x <= full and full - x in have:
            out.append((x, full - x))
        for y in sizes[i:]:
            z = full - x - y
            if z < y:
                break
            if z in have:
                out.append((x, y, z))
    return out


def plan(histogram: dict[int, int], full: int) -> Plan:
    """histogram: documents of each bin from 1 to full."""
    left = {s: n for s, n in histogram.items() if n}
    sizes = sorted(left)
    patterns, repeats = [], []

    def use(pattern: dict[int, int], most: int) -> None:
        m = min(most, *(left[s] // c for s, c in pattern.items()))
        if m > 0:
            patterns.append(sorted(pattern.items(), reverse=True))
            repeats.append(m)
            for s, c in pattern.items():
                left[s] -= m * c

    found = combinations(sizes, full)
    if found:
        at = {s: i for i, s in enumerate(sizes)}
        a = np.zeros((len(sizes), len(found)))
        for j, c in enumerate(found):
            for s in c:
                a[at[s], j] += 1
        x = nnls(a, np.array([histogram[s] for s in sizes], float))
        for j in np.argsort(-x, kind="stable"):
            if round(x[j]) < 1:
                break
            use({s: found[j].count(s) for s in found[j]}, round(x[j]))
    while any(left.values()):
        room, pattern = full, {}
        for s in reversed(sizes):
            while left[s] > pattern.get(s, 0) and s <= room:
                pattern[s] = pattern.get(s, 0) + 1
                room -= s
        use(pattern, max(left.values()))
    return Plan(patterns, repeats)


def pack(docs: DataFrame, path: str, *, end_id: int = 2, window: int = WINDOW, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, with_ids: bool = False) -> DataFrame:
    """The rows of pieces() with sequence_id and offset. Sequences are full windows or hold several texts' rests. They are numbered along the order of order_col (the identifier by default): of each
    bin, of the full windows and of each pattern, what is earlier comes in earlier sequences, to 1 / STRATA of all."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, path, end_id=end_id, window=window, id_col=id_col, text_col=text_col, order_col=order_col, with_ids=with_ids))
    rest = cuts.filter(F.col("length") < window).withColumn("bin", F.expr(f"(length + {unit - 1}) div {unit}"))
    histogram = {r["bin"]: r["n"] for r in rest.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    made = plan(histogram, window // unit)
    columns = ["ord", "id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    places = spark.createDataFrame(made.places() or [(0, 1, 0, 0, 0, 0, 1, 0, 0)], "bin bigint, total bigint, stratum bigint, low bigint, high bigint, first bigint, copies bigint, pattern bigint, slot bigint")
    full = cuts.filter(F.col("length") == window)
    numbers = spark.createDataFrame(made.numbers(full.count()) or [(0, 0, 0, 0)], "pattern bigint, from bigint, to bigint, base bigint")
    one = F.lit(1).cast("bigint")
    ranked = running_total(rest.withColumn("one", one), ["bin"], "ord", "one", "rank", ["length", "ids_crc32"])
    ranked = ranked.join(F.broadcast(places.select("bin", "total").distinct()), "bin").withColumn("stratum", F.expr(f"rank * {STRATA}L div total")).drop("total")
    placed = ranked.join(F.broadcast(places), ["bin", "stratum"]).filter("rank >= low AND rank < high").withColumn("nth", F.expr("first + rank - low"))
    placed = placed.select(*columns, "pattern", F.expr("nth div copies").alias("use"), "slot", F.expr("nth % copies").alias("copy"))
    whole = running_total(full.withColumns({"one": one, "all": F.lit(0)}), ["all"], "ord", "one", "use", ["id", "start", "ids_crc32"])
    whole = whole.select(*columns, F.lit(-1).cast("bigint").alias("pattern"), "use", F.lit(0).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("copy"))
    numbered = placed.unionByName(whole).join(F.broadcast(numbers), "pattern").filter("use >= from AND use < to").withColumn("sequence_id", F.expr("base + use - from"))
    before = Window.partitionBy("sequence_id").orderBy("slot", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.select(*columns, "sequence_id", (F.sum("length").over(before) - F.col("length")).alias("offset"))
