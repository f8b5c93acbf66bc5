"""Quality by the votes of nearest labelled neighbours in a latent-semantic space.

A text is a bag of hashed terms: its words (lower-cased), what surrounds their letters and how these are written (shapes, such as a capital and small letters and a comma), and pairs of neighbouring shapes,
in which a word that repeats the one before it is marked. Terms weigh log(1 + count) times the inverse document frequency, which is counted over all documents. A truncated singular value decomposition
of labelled texts gives the latent space; the labelled vectors are broadcast (bounded: at most 2 * per_class of them), every document's cosine with every one of them is computed exactly, in blocks, and
the nearest vote with their similarity. Classes vote with the weight that they have among all labelled rows over that in the sample. The votes of each labelled text's neighbours, without itself and
texts that are equal to it, give the threshold that serves best, which is put at PREDICT_AT.

Fitted on at most per_class labelled texts of each class, those of the smallest hashes. Defined results: null, empty and wordless texts get a vector of zeros, which has no neighbours, and the share of
label 1 among the labelled rows as their vote; without labels of both classes every score is that share (0.5 without any). Repeated rows get equal scores. A document labelled more than once has quality
1 if one label says so. Rows of labels with a null in doc_id or label are not used. Texts of any length are read whole, in slices. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import cut, map_batches

PREDICT_AT = 0.3
#: Bins of terms; the first half is for words, the rest for shapes and pairs of them.
WORDS, SHAPES = 2048, 1024
TERMS = WORDS + 2 * SHAPES
DIMENSIONS, NEIGHBOURS = 64, 15
#: Words that a worker remembers the terms of, and bytes of a text that are cut into words at a time.
_KNOWN, _SLICE = 150_000, 1 << 20
#: Documents whose cosines with all labelled vectors are held at once.
_BLOCK = 256
_CAPITALS, _SMALL, _DIGITS, _RUNS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\dA-ZÀ-ÖØ-Þ_]"), re.compile(r"\d"), re.compile(rb"(.)\1+")
_KIND = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else b for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_OTHERS = bytes(b for b in range(128) if not chr(b).isalpha())


def shape(word: bytes) -> bytes:
    """The word with every run of capitals, of other letters, of digits and of an equal sign as one character."""
    if not word.isascii():
        word = _DIGITS.sub("0", _SMALL.sub("a", _CAPITALS.sub("A", word.decode("utf-8", "replace")))).encode()
    return _RUNS.sub(rb"\1", word.translate(_KIND))[:24]


class _Terms(dict):
    """Of each word: the number of its letters' term, and a hash of its shape, as term << 32 | hash."""

    def __missing__(self, word: bytes) -> int:
        letters = word.translate(_LOWER, _OTHERS) if word.isascii() else re.sub(r"[\W\d_]+", "", word.decode("utf-8", "replace")).lower().encode()
        found = self[word] = (zlib.crc32(letters or word) % WORDS) << 32 | zlib.crc32(shape(word))
        return found


_terms = _Terms()


def _slices(text: bytes):
    at = 0
    while len(text) - at > _SLICE:
        k = text.find(b" ", at + _SLICE)
        if k < 0:
            break
        yield text[at:k]
        at = k
    yield text[at:] if at else text


def counted(text: bytes | None) -> np.ndarray:
    """How often each of TERMS is in the text. A pair of shapes is marked if the second word has the first one's terms."""
    out, before = np.zeros(TERMS, np.int64), np.array([-1])
    for part in _slices(text or b""):
        words = part.split()
        if not words:
            continue
        if len(_terms) > _KNOWN:
            _terms.clear()
        found = np.concatenate((before, np.fromiter(map(_terms.__getitem__, words), np.int64, len(words))))
        own = found & 0xFFFFFFFF
        pair = np.where(found[1:] == found[:-1], own[1:] % 8, (own[:-1] * 31 + own[1:] * 17) % (SHAPES - 8) + 8)
        out += np.bincount(np.concatenate((found[1:] >> 32, WORDS + own[1:] % SHAPES, WORDS + SHAPES + pair)), minlength=TERMS)
        before = found[-1:]
    return out


@dataclass(frozen=True)
class Model:
    #: Share of label 1 among all labelled rows; what a text without neighbours gets.
    share: float
    weights: np.ndarray = field(default_factory=lambda: np.ones(TERMS, np.float32))
    axes: np.ndarray | None = None
    vectors: np.ndarray | None = None
    labels: np.ndarray | None = None
    votes: tuple[float, float] = (1.0, 1.0)
    threshold: float = 0.5


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log(1 + count) * idf; rows of zeros stay. Words, shapes and pairs are scaled to one length each before."""
    x = np.log1p(counts).astype(np.float32) * idf
    for a, b in ((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, TERMS)):
        n = np.linalg.norm(x[:, a:b], axis=1, keepdims=True)
        x[:, a:b] /= np.where(n > 0, n, 1)
    return x


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 1e-9, n, np.inf)


def embed(counts: np.ndarray, model: Model) -> np.ndarray:
    return _unit(weighted(counts, model.weights) @ model.axes)


def axes_of(x: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """The k leading right singular vectors of x, by subspace iteration."""
    k = min(k, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(seed).standard_normal((len(x), k + min(10, max(0, min(x.shape) - k)))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v[:k].T).astype(np.float32)


def _vote(cosines: np.ndarray, model: Model) -> np.ndarray:
    """Of each row of cosines (to five digits, so that equal texts have equal ones) the share of label 1 in the votes of the nearest neighbours with a positive cosine."""
    c, k = np.rint(cosines * 1e5), min(NEIGHBOURS, cosines.shape[1])
    near = np.argpartition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k :]
    label = model.labels[near]
    w = np.take_along_axis(c, near, 1).clip(0) * np.where(label == 1, model.votes[1], model.votes[0])
    total = w.sum(1)
    return np.where(total > 0, (w * label).sum(1) / np.where(total > 0, total, 1), model.share)


def raw_scores(vectors: np.ndarray, model: Model) -> np.ndarray:
    return np.concatenate([_vote(vectors[a : a + _BLOCK] @ model.vectors.T, model) for a in range(0, len(vectors), _BLOCK)] or [np.zeros(0)])


def scores(counts: np.ndarray, model: Model) -> np.ndarray:
    """0 to 1; the calibrated threshold is at PREDICT_AT."""
    if model.axes is None:
        return np.full(len(counts), model.share)
    s, t = raw_scores(embed(counts, model), model), model.threshold
    return np.where(s < t, PREDICT_AT * s / t, PREDICT_AT + (1 - PREDICT_AT) * (s - t) / max(1e-9, 1 - t)).clip(0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, sizes: tuple[int, int], idf: np.ndarray, keys: np.ndarray | None = None) -> Model:
    """From the term counts and labels of the sample, the numbers of all labelled rows by class, and the inverse document frequencies."""
    total = sum(sizes)
    share = sizes[1] / total if total else 0.5
    seen = [(labels == c).sum() for c in (0, 1)]
    if not all(seen):
        return Model(share)
    x = weighted(counts, idf)
    axes = axes_of(x, DIMENSIONS)
    model = Model(share, idf, axes, _unit(x @ axes), labels.astype(np.int64), tuple(float(sizes[c] / total / seen[c]) * sum(seen) for c in (0, 1)))
    own = []
    for a in range(0, len(labels), _BLOCK):
        c = model.vectors[a : a + _BLOCK] @ model.vectors.T
        c[c > 1 - 1e-6] = -1  # itself and its copies
        own.append(_vote(c, model))
    s = np.concatenate(own)
    levels = np.unique(s)
    levels = np.concatenate(((levels[:-1] + levels[1:]) / 2, [0.5]))
    levels = levels[(levels > 0.01) & (levels < 0.99)]
    truth, of = labels == 1, np.where(labels == 1, model.votes[1], model.votes[0])
    right = np.array([(of * ((s >= v) == truth)).sum() for v in levels])
    best = np.flatnonzero(right >= right.max() - 1e-9)
    return Model(**{**model.__dict__, "threshold": float(levels[best[len(best) // 2]])})


def frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """Inverse document frequency of each term over all rows: log((1 + n) / (1 + rows with it)) + 1."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros(TERMS + 1, np.int64)
        for t in batch.column(0).to_pylist():
            n[:-1] += counted(t) > 0
            n[-1] += 1
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["term", "n"])

    found = map_batches(docs.select(F.col(text_col).cast("binary").alias("t")), "term int, n bigint", count).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(TERMS + 1)
    n[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return (np.log((1 + n[-1]) / (1 + n[:-1])) + 1).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500) -> Model:
    """Fit on at most per_class different labelled texts of each class (those of the smallest hashes) for which learn, a condition on the labels' id, holds. Texts are read in the tasks; what comes to
    the driver are the term counts of the sample and one number for each term of all documents."""
    marked = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).filter("y IN (0, 1)")
    text = F.col(text_col).cast("binary")
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text, F.lit(77)).alias("key"), text.alias("text"))
    keys = cut(rows.select("id", "key").join(marked, "id").groupBy("key").agg(F.max("y").alias("y"), F.count("*").alias("n")))
    sizes = {r["y"]: r["n"] for r in keys.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    chosen = cut(keys.filter("y = 0").orderBy("key").limit(per_class).unionByName(keys.filter("y = 1").orderBy("key").limit(per_class)).select("key", "y"))
    share_of = (sizes.get(0, 0), sizes.get(1, 0))
    if not all(share_of):
        return fit(np.zeros((0, TERMS)), np.zeros(0), share_of, np.ones(TERMS, np.float32))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [counted(t) for t in batch.column(2).to_pylist()]
        at = [np.flatnonzero(c) for c in found]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(a) for a in at]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v), pa.int32())) for v in (at, [c[a] for c, a in zip(found, at, strict=True)])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["key", "y", "terms", "counts"])

    sample = map_batches(rows.join(F.broadcast(chosen), "key").select("key", "y", "text"), "key bigint, y int, terms array<int>, counts array<int>", measure)
    found = sample.groupBy("key").agg(F.first("y").alias("y"), F.first("terms").alias("terms"), F.first("counts").alias("counts")).orderBy("key").toArrow()
    counts = np.zeros((found.num_rows, TERMS), np.float32)
    terms, times = (found.column(c).combine_chunks() for c in ("terms", "counts"))
    row = np.repeat(np.arange(found.num_rows), np.diff(terms.offsets.to_numpy()))
    counts[row, terms.flatten().to_numpy()] = times.flatten().to_numpy()
    return fit(counts, found.column("y").to_numpy(), share_of, frequencies(docs, text_col))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The columns keep, score and predicted (1 from PREDICT_AT on) of each row; one narrow pass over whole texts, with the model broadcast (2 MB and 256 bytes for each labelled vector)."""
    kept = docs.select(*keep, F.col(text_col).cast("binary").alias("__kw_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = batch.column(len(keep)).to_pylist(), []
        for a in range(0, len(texts), _BLOCK):
            out.append(scores(np.stack([counted(t) for t in texts[a : a + _BLOCK]]), held.value))
        s = np.concatenate(out).astype(np.float64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= PREDICT_AT).astype(np.int32))], [*keep, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["score double", "predicted int"])
    return map_batches(kept, schema, run)
