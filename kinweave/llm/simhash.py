"""Near duplicates by SimHash and a Gray-order hierarchical index.

A text (A-Z lower-cased) is a sequence of words `[^\\x20\\x09-\\x0D]+`; its shingles are runs of some words joined by a space (the whole sequence if there are fewer). A bit of the
fingerprint is 1 if it is 1 in over half of the shingles' XXH64 (seed 42), repeats included. Fingerprints of several 64-bit words take the further words from a mix of the same hash.

Fingerprints that differ in few bits are linked. Distinct fingerprints are dealt out by masked bits (see `block_masks` and `sampled_masks`), and in each task an index finds the links:

* the fingerprints of a key are sorted by Gray rank, so neighbours share long patterns;
* runs of them make a leaf, runs of leaves an upper node, and so on; a node holds the mask and pattern of the bits that all below it share, an upper node those shared by all its children;
* a query goes down from the root and adds up, node by node, the differences in the bits first fixed there. A whole group is pruned when the sum passes the limit.

Only a spanning set of the links found (each fingerprint to the smallest one of its connected set) leaves a task, so output is linear in its input. A key with very many different
fingerprints is split by Gray order into blocks, every pair of blocks being a task of its own.

Defined results: null and empty texts have fingerprint zero, linked like any other; equal fingerprints are one node; rows without an identifier are linked like any other and
have the smallest identifier that a chain from them reaches (null if it reaches none). Only the named id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import cut, map_batches
from kinweave.llm.components import components

SEED = 42
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HASH = xxhash.xxh64_intdigest
_SLICE = 1 << 17
#: Documents of near groups that are broadcast (identifier, group, block: some 40 bytes each); more are joined by a shuffle.
MOST_MEMBERS = 300_000


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(_HASH, shingles, repeat(SEED)), np.uint64, max(1, len(words) - size + 1))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of a hash: itself, or SplitMix64 of it."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + _GOLDEN * np.uint64(k)
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


#: The bits of each byte, most significant first, as eight bytes of one word: sums of up to 255 of them don't overflow into each other.
_LANES = np.zeros(256, np.uint64)
for _k in range(8):
    _LANES += ((np.arange(256, dtype=np.uint64) >> np.uint64(7 - _k)) & np.uint64(1)) << np.uint64(8 * _k)


def _ones(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits (most significant first) is set in each run of h that begins at starts."""
    lanes = _LANES[h.astype(">u8").view(np.uint8).reshape(-1, 8)]
    parts = (np.diff(np.append(starts, len(h))) + 254) // 255
    first = np.cumsum(parts) - parts
    begin = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * 255
    sums = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).reshape(-1, 64)
    return np.add.reduceat(sums, first, axis=0, dtype=np.int32)


def fingerprints(texts: list[bytes | None], size: int = 3, words: int = 1) -> np.ndarray:
    """(texts, words) array of unsigned 64-bit words; memory is bounded by the longest text's hashes."""
    return _summed((shingle_hashes(text, size) for text in texts), len(texts), words)


def _summed(hashes: Iterable[np.ndarray], n_texts: int, words: int) -> np.ndarray:
    """The fingerprints of texts whose shingles have these hashes."""
    out, held, rows, n = np.zeros((n_texts, words), np.uint64), [], [], 0

    def settle() -> None:
        nonlocal held, rows, n
        if rows:
            h = np.concatenate(held)
            lens = np.array([len(x) for x in held], np.int64)
            starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
            for k in range(words):
                out[rows, k] = np.packbits(_ones(_mixed(h, k), starts) * 2 > lens[:, None], axis=1).view(">u8").ravel()
            held, rows, n = [], [], 0

    for i, h in enumerate(hashes):
        if len(h) > _SLICE:  # a very long text: sum over slices
            for k in range(words):
                total = sum(_ones(_mixed(h[a : a + _SLICE], k), np.array([0])).astype(np.int64) for a in range(0, len(h), _SLICE))
                out[i, k] = np.packbits(total * 2 > len(h), axis=1).view(">u8")[0, 0]
        elif len(h):
            held.append(h), rows.append(i)
            n += len(h)
            if n >= _SLICE:
                settle()
    settle()
    return out


def fingerprint_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, words: int = 1) -> DataFrame:
    """(id, f0, f1, ...) of each row; one narrow pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = fingerprints(batch.column(1).to_pylist(), size, words).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f[:, k]) for k in range(words)]], ["id", *[f"f{k}" for k in range(words)]])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, "id bigint, " + ", ".join(f"f{k} bigint" for k in range(words)), run)


def block_masks(limit: int, blocks: int = 0) -> list[list[int]]:
    """Masks of one 64-bit word, such that two fingerprints within limit bits agree under one at least: blocks (limit + 1 by default) blocks, every choice of blocks - limit of them.
    More blocks make more masks of more bits, for more fingerprints."""
    blocks = blocks or limit + 1
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    return [[sum(c)] for c in combinations(parts, blocks - limit)]


def blocks_for(nodes: int, limit: int, each: int = 64) -> int:
    """The fewest blocks whose masks have so many bits that about `each` of the nodes share a key."""
    blocks = limit + 1
    while blocks < 16 and 64 * (blocks - limit) // blocks < math.log2(max(1, nodes / each)):
        blocks += 1
    return blocks


def differing(similarity: float) -> float:
    """The share of bits in which fingerprints of two equally large sets of this Jaccard similarity differ on the average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def masks_for(nodes: int, words: int, similarity: float, recall: float = 0.998, each: int = 64) -> list[list[int]]:
    """Sampled masks with so many bits that about `each` of the nodes share a key by chance, and as many of them as are needed to meet pairs of that similarity with that chance."""
    bits = max(8, math.ceil(math.log2(max(1, nodes / each))))
    return sampled_masks(words, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** bits)), bits)


def sampled_masks(words: int, tables: int, bits: int, seed: int = 11) -> list[list[int]]:
    """Masks of bits random bits each: fingerprints at a share p of differing bits agree under one of them with chance 1 - (1 - (1 - p)**bits)**tables."""
    rng, masks = np.random.Generator(np.random.PCG64(seed)), []
    for _ in range(tables):
        chosen = rng.choice(64 * words, bits, replace=False)
        masks.append([sum(1 << int(c % 64) for c in chosen if c // 64 == w) for w in range(words)])
    return masks


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Where each fingerprint (rows of words) stands in Gray order, as words to sort by."""
    rank, flip = np.empty_like(f), np.zeros(len(f), bool)
    for w in range(f.shape[1]):
        y = f[:, w].copy()
        for s in (1, 2, 4, 8, 16, 32):
            y ^= y >> np.uint64(s)
        rank[:, w] = np.where(flip, ~y, y)
        flip ^= (np.bitwise_count(f[:, w]) & 1).astype(bool)
    return rank


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged ranges: which range, and the member."""
    which = np.repeat(np.arange(len(starts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]


def _pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int16)


class GrayIndex:
    """Index of fingerprints that stand sorted by (group, Gray rank); a query looks only below its own group's root."""

    def __init__(self, f: np.ndarray, group: np.ndarray, fan: int = 8):
        self.f = f
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # mask, pattern, first child, end of children
        low = high = f
        owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(f))))
        self.group_of = owner
        last = np.arange(1, len(f) + 1)
        self.last: list[np.ndarray] = []
        while True:
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            start = np.flatnonzero(place % fan == 0)
            low, high, owner = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start), owner[start]
            end = np.append(start[1:], len(place))
            last = last[end - 1]
            mask = ~(low ^ high)
            self.levels.append((mask, low & mask, start, end))
            self.last.append(last)
            if len(owner) == len(begin):
                break

    def links(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later member of its group) that differ in at most limit bits."""
        f, q, node = self.f, queries, self.group_of[queries]
        mask, pattern, start, end = self.levels[-1]
        fixed = mask[node]
        total = _pop((f[q] ^ pattern[node]) & fixed)
        for depth in range(len(self.levels) - 2, -1, -1):
            which, child = _spread(start[node], (end - start)[node])
            keep = self.last[depth][child] > q[which] + 1
            which, child = which[keep], child[keep]
            mask, pattern, start, end = self.levels[depth]
            total = total[which] + _pop((f[q[which]] ^ pattern[child]) & mask[child] & ~fixed[which])
            keep = total <= limit
            q, node, fixed, total = q[which][keep], child[keep], mask[child][keep], total[keep]
        which, member = _spread(start[node], (end - start)[node])
        keep = member > q[which]
        which, member = which[keep], member[keep]
        total = total[which] + _pop((f[q[which]] ^ f[member]) & ~fixed[which])
        keep = total <= limit
        return q[which][keep], member[keep]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, with the sets of a[i] and b[i] made one; every label is the smallest position of its set."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (label[label] != label).any():
            label = label[label]


def spanning(key: np.ndarray, f: np.ndarray, limit: int, room: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows in the index, and links (positions there) that connect what any chain of links within a key connects."""
    order = np.lexsort([*gray_rank(f).T[::-1], key])
    key, f = key[order], f[order]
    index, label = GrayIndex(f, key), np.arange(len(key))
    sizes = np.bincount(index.group_of)[index.group_of]
    cost = np.cumsum(sizes)
    at = 0
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + room, "right")))
        a, b = index.links(np.arange(at, stop), limit)
        label = _join(label, a, b)
        at = stop
    linked = np.flatnonzero(label != np.arange(len(label)))
    return order, linked, label[linked]


def _key(table: int, mask: list[int]) -> Column:
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in mask]
    return F.xxhash64(F.lit(table), *[F.col(f"f{w}").bitwiseAND(F.lit(m)) for w, m in enumerate(signed) if m])


def _linker(limit: int, words: int, chunk: int = 1 << 17):
    """Rows (key, id, f0, ...) that come sorted by key, to links (a, b) between ids: a spanning set. Holds chunk rows and one key's."""

    def settle(table: pa.Table) -> pa.RecordBatch | None:
        key = table.column("key").to_numpy()
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        rows = np.repeat(n > 1, n).nonzero()[0]
        if not len(rows):
            return None
        ids = table.column("id").to_numpy()[rows]
        f = np.stack([table.column(f"f{w}").to_numpy()[rows] for w in range(words)], 1).view(np.uint64)
        order, a, b = spanning(key[rows], f, limit)
        ids = ids[order]
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"]) if len(a) else None

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if whole:
                    if (out := settle(table.slice(0, whole))) is not None:
                        yield out
                held = table.slice(whole).to_batches()
                n = sum(x.num_rows for x in held)
        if n and (out := settle(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return run


def links(nodes: DataFrame, limit: int, masks: list[list[int]], *, most: int = 1 << 16, share: int = 64) -> DataFrame:
    """Links (a, b) between the ids of nodes (id, f0, ...), which have different fingerprints: together they connect all that is connected by pairs that differ in at most limit bits and agree
    under a mask. Keys that a sample of 1 / share of the nodes shows to have more than most nodes are split by Gray order into blocks; the sample only decides how work is dealt out."""
    words = len(masks[0])
    names = [f"f{w}" for w in range(words)]
    cols = ["id", *names]

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array(*[_key(i, m) for i, m in enumerate(masks)])).alias("key"), *cols)

    def run(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions("key").mapInArrow(_linker(limit, words), "a bigint, b bigint")

    hot = keyed(nodes.filter(F.pmod(F.xxhash64(*names), F.lit(share)) == 0)).groupBy("key").agg((F.count("*") * share).alias("n")).filter(F.col("n") > most)
    hot = cut(hot.select("key", F.ceil(F.col("n") / (most / 2)).cast("int").alias("parts")))
    rows, found = keyed(nodes), hot.count()
    if not found:
        return run(rows.repartition("key"))
    few = F.broadcast(hot) if found <= 100_000 else hot
    cold = run(rows.join(few, "key", "left_anti").repartition("key"))
    part = F.pmod(F.xxhash64(F.lit(1), *names), F.col("parts")).cast("int")
    split = rows.join(few, "key").select("key", part.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"), *cols)
    pairs = split.select(F.xxhash64("key", F.least("p", "o"), F.greatest("p", "o")).alias("key"), *cols)
    return cold.unionByName(run(pairs.repartition("key")))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, limit: int = 3, masks: list[list[int]] | None = None) -> DataFrame:
    """One row per row of docs: id, f0 (and f1, ...), component (smallest id that a chain of links reaches). Without masks the blocks follow the number of different fingerprints."""
    words = len(masks[0]) if masks else 1
    names = [f"f{w}" for w in range(words)]
    table = cut(fingerprint_table(docs, id_col=id_col, text_col=text_col, size=size, words=words))
    nodes = cut(table.groupBy(*names).agg(F.min("id").alias("low")).withColumn("id", F.monotonically_increasing_id()))
    parts = components(links(nodes, limit, masks or block_masks(limit, blocks_for(nodes.count(), limit))))
    whole = nodes.join(parts, nodes["id"] == parts["node"], "left").select(*names, "low", F.coalesce("component", "id").alias("part"))
    lowest = whole.groupBy("part").agg(F.min("low").alias("component"))
    return table.join(whole.join(lowest, "part").select(*names, "component"), names, "left").select("id", *names, "component")


def _set_table(docs: DataFrame, id_col: str, text_col: str, size: int, words: int) -> DataFrame:
    """(id, f0, ..., digest, n) of each row with an identifier: of the set of its shingles, repeats left out, fingerprint and digest, and how many there are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, n = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)

        def sets():
            for i, text in enumerate(batch.column(1)):
                h = np.unique(shingle_hashes(text.as_py(), size))
                digests[i], n[i] = _HASH(h.tobytes()), len(h)
                yield h

        f = _summed(sets(), batch.num_rows, words).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f[:, k]) for k in range(words)], pa.array(digests.view(np.int64)), pa.array(n)], ["id", *[f"f{k}" for k in range(words)], "digest", "n"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text")).filter("id IS NOT NULL")
    return map_batches(rows, "id bigint, " + ", ".join(f"f{k} bigint" for k in range(words)) + ", digest bigint, n bigint", run)


def similar(sets: list[np.ndarray], key: np.ndarray, left: np.ndarray, right: np.ndarray, least: tuple[int, int], room: int = 1 << 20) -> np.ndarray:
    """Labels of sets (sorted hashes without repeats): equal for those that a chain of pairs connects, each pair of one key, one of left and one of right (masks), and of a Jaccard similarity of
    least[0] / least[1] or more, counted exactly. Sets come sorted by key. Common members are counted through lists of the sets that have a hash, about room entries at a time."""
    label = np.arange(len(sets))
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    if not lens.sum():
        return label
    with np.errstate(over="ignore"):
        salt = np.repeat(key.view(np.uint64) * _GOLDEN, lens)  # equal hashes of different keys are different
    h, own = np.concatenate(sets) ^ salt, np.repeat(np.arange(len(sets)), lens)
    listed = right[own]
    order = np.argsort(h[listed], kind="stable")
    holder = own[listed][order]
    values, first, times = np.unique(h[listed][order], return_index=True, return_counts=True)
    if not len(values):
        return label
    place = np.minimum(np.searchsorted(values, h), len(values) - 1)
    n = np.where((values[place] == h) & left[own], times[place], 0)
    cost = np.cumsum(np.bincount(own, n, len(sets)).astype(np.int64))
    ends = np.cumsum(lens)
    at = 0
    while at < len(sets):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + room, "right")))
        some = slice(int(ends[at] - lens[at]), int(ends[stop - 1]))
        which, entry = _spread(first[place[some]], n[some])
        a, b = own[some][which], holder[entry]
        if len(a):
            low, span = int(b.min()), int(b.max() - b.min()) + 1
            code = (a - at) * span + (b - low)
            if (stop - at) * span <= max(room, 4 * len(code)):
                both = np.bincount(code, minlength=1)
                pair = np.flatnonzero(both)
                both = both[pair]
            else:
                pair, both = np.unique(code, return_counts=True)
            a, b = at + pair // span, low + pair % span
            near = (a != b) & (both * least[1] >= (lens[a] + lens[b] - both) * least[0])
            label = _join(label, a[near], b[near])
        at = stop
    return label


def _verifier(size: int, least: tuple[int, int], chunk: int = 1 << 18):
    """Rows (key, cross, side, id, text) that come sorted by key, to links (a, b) between ids: a spanning set of each key's verified pairs (of different sides, if cross). Holds about chunk shingles and one key's."""

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        key, cross, side, ids = (np.array(c) for c in list(zip(*rows, strict=True))[:4])
        label = similar([r[4] for r in rows], key.astype(np.int64), ~cross | ~side, ~cross | side, least)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(ids[label[linked]], pa.int64()), pa.array(ids[linked], pa.int64())], ["a", "b"]) if len(linked) else None

    def run(batches):
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for key, cross, side, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                if n >= chunk and key != held[-1][0]:
                    if (out := settle(held)) is not None:
                        yield out
                    held, n = [], 0
                held.append((key, cross, side, i, np.unique(shingle_hashes(text.as_py(), size))))
                n += len(held[-1][4])
        if held and (out := settle(held)) is not None:
            yield out

    return run


def verified_groups(docs: DataFrame, *, least: tuple[int, int], words: int, limit: int, masks: list[list[int]] | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = 3, weight: int = 1 << 18) -> DataFrame:
    """(id, component) of each identifier: the smallest one that a chain of pairs reaches, each pair of a Jaccard similarity of least[0] / least[1] or more, counted exactly.

    Fingerprints (words of 64 bits) within limit bits that agree under a mask make wide groups, by a spanning set of their links: no pair leaves a task; without masks they follow the number of
    different sets. Only documents of such groups are then read again and
    sent to where they are compared. A group of more than weight shingles is dealt in blocks that meet two by two, so no task holds more than two blocks; a task returns a spanning set of its
    verified links, so what a group returns grows with its documents and blocks. Rows without an identifier are not compared."""
    names = [f"f{w}" for w in range(words)]
    table = cut(_set_table(docs, id_col, text_col, size, words))
    nodes = cut(table.groupBy(*names, "digest").agg(F.min("id").alias("id"), F.max("n").alias("n")))
    wide = components(links(nodes.select("id", *names), limit, masks or masks_for(nodes.count(), words, least[0] / least[1])))
    members = nodes.select("id", "n").join(wide, nodes["id"] == wide["node"]).groupBy("id", "component").agg(F.max("n").alias("n"))
    blocks = members.groupBy("component").agg(F.ceil(F.sum(F.col("n") + 64) / weight).cast("int").alias("blocks"))
    members = cut(members.join(blocks, "component").select(F.col("id").alias("__id"), "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("p")))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.join(F.broadcast(members) if members.count() <= MOST_MEMBERS else members, texts["id"] == F.col("__id"))
    low, high = F.least("p", "o"), F.greatest("p", "o")
    dealt = texts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("component", low, high).alias("key"), (low != high).alias("cross"), (F.col("p") == high).alias("side"), "id", "text")
    sure = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_verifier(size, least), "a bigint, b bigint")
    # equal sets are one node, and rows of one identifier are one document
    same = nodes.withColumnRenamed("id", "b").join(table, [*names, "digest"]).filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    parts = components(same.unionByName(sure))
    ids = table.select("id").distinct()
    return ids.join(parts, ids["id"] == parts["node"], "left").select("id", F.coalesce("component", "id").alias("component"))
