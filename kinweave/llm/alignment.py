"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) cover the same bytes.

A encodes a space and the text, B the text (it adds that space itself); special tokens' strings are plain text. Tokens are laid out by their bytes. Per batch and keyed by document, `pandas.merge_asof`
finds the token of the other side that covers each token's start, in both directions; the union is all overlaps. Overlaps whose tokens end at one byte are links, and the ends of links cut a text's
tokens into groups. How many links hold an identifier pair linked is counted over the whole corpus; of the pairs of one B identifier those with the highest count are its best.

One pass tokenizes and aligns; each document's different pairs and how often it has them are written to the shared folder. Their counts are summed over all of it, and a second pass over that table (not
over texts) adds them up by document: from a broadcast table of counts up to MOST_PAIRS, by a join beyond.

Defined results: null and empty texts, and those whose tokens' bytes differ from the space and the text (the model drops U+2581 of a text, say), have no tokens: zeros and ''. Malformed UTF-8 is read with
U+FFFD in its place. Repeated rows count as often as they occur; an empty table gives no rows; a null identifier is carried like any other. Long texts are tokenized in slices that end where no
token of either side can cross. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import KEPT, cut, decoded, map_batches, scratch

SPACE = "▁"
#: What the byte-level tokenizers' file format takes apart into pre-tokens before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Different pairs whose counts are sent to the tasks (20 MB).
MOST_PAIRS = 1_000_000
#: Characters of a slice of a long text, and of the texts that are aligned at a time.
SLICE, GROUP = 1 << 19, 1 << 18


def byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes in order for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """text in slices that begin with a space between two characters that aren't white space (the first one as the text does)."""
    at = 0
    while len(text) - at > size:
        k = text.find(" ", at + size)
        while k > 0 and (k + 1 >= len(text) or text[k - 1].isspace() or text[k + 1].isspace()):
            k = text.find(" ", k + 1)
        if k < 0:
            break
        yield text[at:k]
        at = k
    yield text[at:]


class ByteTokens:
    """Side A, from a tokenizers file. Where the merges are in the order of the identifiers they make, the same merging is done by tiktoken, which is four times faster; else by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, byte = spec["model"]["vocab"], byte_of()
        added = {t["content"] for t in spec.get("added_tokens", [])}
        self.raw = [b""] * (max([*vocabulary.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for entry, i in vocabulary.items():
            if entry not in added:
                self.raw[i] = bytes(byte[c] for c in entry)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        split = json.dumps(spec.get("pre_tokenizer"))
        if made == sorted(set(made)) and spec.get("normalizer") is None and '"Regex"' not in split and '"ByteLevel"' in split and '"use_regex": false' not in split:
            import tiktoken

            fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={r: i for i, r in enumerate(self.raw) if r}, special_tokens={})
            self.encode = fast.encode_ordinary
        else:
            slow = Tokenizer.from_file(path)
            slow.encode_special_tokens = True
            self.encode = lambda text: slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(slices(text)):
            out += self.encode(part if k else " " + part)
        return out


class PieceTokens:
    """Side B, from a sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.whole = any(SPACE in p.lstrip(SPACE) for p in pieces)  # a piece may cross words: no slices

    def ids(self, text: str) -> list[int]:
        if self.whole:
            return self.model.encode(text, num_threads=1)
        out: list[int] = []
        for k, part in enumerate(slices(text)):
            out += self.model.encode(part[1:] if k else part, num_threads=1)
        return out


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.a_size, self.b_size = (np.array([len(r) for r in side.raw]) for side in (self.a, self.b))
        #: An identifier and what follows it: at 2 * id inside a group, at 2 * id + 1 at the end of a group's side; B's come after A's.
        self.written = [f"{i}{s}".encode() for i in range(len(self.a.raw)) for s in ",|"] + [f"{i}{s}".encode() for i in range(len(self.b.raw)) for s in ",;"]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Identifiers of both sides, or none if either doesn't give back the space and the text."""
        if not text:
            return [], []
        a, b, want = self.a.ids(text), self.b.ids(text), b" " + text.encode("utf-8", "replace")
        for ids, raw in ((a, self.a.raw), (b, self.b.raw)):
            if b"".join([raw[i] for i in ids]) != want:
                return [], []
        return a, b

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(A's tokens, B's tokens, links, digest of the groups, different linked pairs as a << 32 | b, how often each) of each text."""
        coded = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in coded], np.int64) for k in (0, 1))
        a, b = (np.array([i for x in coded for i in x[k]], np.int64) for k in (0, 1))
        del coded
        docs = np.arange(len(texts))
        end_a, end_b = self.a_size[a].cumsum(), self.b_size[b].cumsum()  # over all texts: both sides of a text have the same bytes
        left = pd.DataFrame({"start": end_a - self.a_size[a], "doc": docs.repeat(n_a), "a": np.arange(len(a))})
        right = pd.DataFrame({"start": end_b - self.b_size[b], "doc": docs.repeat(n_b), "b": np.arange(len(b))})
        over = pd.merge_asof(left, right, on="start", by="doc")
        back = pd.merge_asof(right, left, on="start", by="doc")
        back = back[left["start"].to_numpy()[back["a"].to_numpy(np.int64)] != back["start"].to_numpy()]  # equal starts are in over already
        x, y = (np.concatenate((over[c].to_numpy(np.int64), back[c].to_numpy(np.int64))) for c in "ab")
        linked = end_a[x] == end_b[y]
        x, y = x[linked], y[linked]
        x, y = np.sort(x), np.sort(y)  # one link ends at a byte, so both are in the order of the bytes
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[x] = last_b[y] = 1
        group_a, group_b = last_a.cumsum() - last_a, last_b.cumsum() - last_b
        line = np.empty(len(a) + len(b), np.int64)  # both sides' tokens, group after group
        line[np.arange(len(a)) + np.concatenate(([0], y + 1))[group_a]] = 2 * a + last_a
        line[np.arange(len(b)) + (x + 1)[group_b]] = 2 * (len(self.a.raw) + b) + last_b
        pair, links = a[x] << 32 | b[y], np.bincount(left["doc"].to_numpy()[x], minlength=len(texts))
        out, at, link, written = [], 0, 0, self.written
        for na, nb, nl in zip(n_a.tolist(), n_b.tolist(), links.tolist(), strict=True):
            text = b"".join([written[i] for i in line[at : at + na + nb].tolist()])[:-1]
            pairs, times = np.unique(pair[link : link + nl], return_counts=True)
            out.append((na, nb, nl, hashlib.sha256(text).hexdigest() if na else "", pairs, times))
            at, link = at + na + nb, link + nl
        return out


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def aligned(docs: DataFrame, a_path: str, b_path: str, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """keep, n_a, n_b, n_groups, n_links, groups_sha256, and pairs (a << 32 | b) with times of each row; one narrow pass over whole texts."""
    kept = docs.select(*keep, F.col(text_col).cast("binary").alias("__kw_text"))

    def run(batch: pa.RecordBatch) -> pa.Table:
        mine = KEPT.setdefault("alignment", {})
        if (a_path, b_path) not in mine:
            mine[a_path, b_path] = Aligner(a_path, b_path)
        texts, out, at = batch.column(len(keep)), [], 0
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        while at < len(texts):
            n = max(1, int(np.searchsorted(sizes[at:].cumsum(), GROUP, "right")))
            found = mine[a_path, b_path].align(decoded(texts.slice(at, n)))
            counts = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1, 2, 2)]
            lists = [_lists([f[4] for f in found], pa.int64()), _lists([f[5] for f in found], pa.int64())]
            out.append(pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in batch.columns[:-1]), *counts, pa.array([f[3] for f in found], pa.string()), *lists], [*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]))
            at += n
        return pa.Table.from_batches(out)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"])
    return map_batches(kept, schema, run, keeps="alignment")


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = keys.argsort(kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): the corpus-wide count of each linked pair, and whether its B identifier has no pair of a higher one. rows: (pairs, times)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, n = _summed(_flat(batch.column(0)), _flat(batch.column(1)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    counts = cut(map_batches(rows.select("pairs", "times"), "pair bigint, n bigint", count).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """rows (with a column __kw_row that no two share) without pairs and times, with n_best and count_sum."""
    counts = cut(counts)
    if counts.count() <= most_pairs:
        table = counts.orderBy("pair").toArrow()
        held = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
        names = [c for c in rows.columns if c not in ("pairs", "times", "__kw_row")]

        def look(batch: pa.RecordBatch) -> pa.RecordBatch:
            pair, n, best = held.value
            k = len(names)
            keys, times, ends = _flat(batch.column(k)), _flat(batch.column(k + 1)), np.diff(batch.column(k).offsets.to_numpy()).cumsum()
            at = np.searchsorted(pair, keys)
            upto = lambda v: np.diff(np.concatenate(([0], np.concatenate(([0], v.cumsum()))[ends])))
            return pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(upto(times * best[at]), pa.int64()), pa.array(upto(times * n[at]), pa.int64())], [*names, "n_best", "count_sum"])

        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields] + ["n_best bigint, count_sum bigint"])
        return map_batches(rows.select(*names, "pairs", "times"), schema, look)
    each = rows.select("__kw_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("__kw_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("t"))
    sums = each.join(counts, "pair").groupBy("__kw_row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "__kw_row", "left").drop("__kw_row").fillna(0, ["n_best", "count_sum"])


def alignment(docs: DataFrame, a_path: str, b_path: str, *, text_col: str = "text", keep: list[str], most_pairs: int = MOST_PAIRS) -> DataFrame:
    """keep, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair is a best one of its B identifier) and count_sum (of the links' counts) of each row."""
    spark = docs.sparkSession
    at = scratch(spark, "alignment")
    aligned(docs, a_path, b_path, text_col=text_col, keep=keep).withColumn("__kw_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(at)
    rows = spark.read.parquet(at)
    return scored(rows, pair_counts(rows), most_pairs)
