"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled texts: one of ordinary text, one of toxic text. A text (lower-cased, ASCII punctuation as white space) is cut into windows of one word; a window is
compressed with either dictionary, and its gain is the number of bytes that the toxic dictionary saves over the ordinary one. A text's features are its largest gains; a logistic
fit on labelled texts that neither dictionary has seen turns them into a probability, and the threshold that serves best there is put at score 0.7.

* ordinary dictionary: the words that ordinary texts use most, most frequent last (zstandard finds the nearest first).
* toxic dictionary: words that are much likelier in toxic than in ordinary texts. What is counted is the different pairs of neighbours that a word occurs between, so a passage that many texts copy counts
  once and doesn't look like a habit of toxic writing.
* both end with the same carrier, and windows begin and end with it: a block with one match in any case shows the cost of a word to the byte.

Raw-content dictionaries are used: entropy tables trained by COVER hide the difference on windows this short.

Windows recur, so lengths are remembered by worker, up to a bound. Defined results: null, empty and wordless texts have no window and get the score of gain 0; repeated rows get equal
scores; without texts of both labels every score is 0. Rows of labels with null doc_id or label are not used; a document labelled more than once is toxic if one label says so. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import cut, map_batches

CARRIER = bytes([1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21]) * 2
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_CACHE = 500_000
PREDICT_AT = 0.7


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = ()
    threshold: float = 0.5
    cache: dict[bytes, int] = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Greedy search over the whole dictionary; frames without magic number, checksum or sizes."""
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, chain_log=14, hash_log=14, window_log=15, target_length=16,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + b" " + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)


_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


def gains(windows: list[bytes], model: Model) -> list[int]:
    """Bytes saved by the toxic dictionary, for each window (words joined by spaces)."""
    framed = [CARRIER + b" " + w + b" " + CARRIER for w in windows]
    sizes = []
    for content in (model.ordinary, model.toxic):
        if content not in _compressors:
            _compressors[content] = _compressor(content)
        out = _compressors[content].multi_compress_to_buffer(framed, threads=1)
        sizes.append([len(out[i]) for i in range(len(out))])
    return [a - b for a, b in zip(*sizes, strict=True)]


def features(texts: list[bytes | None], model: Model) -> np.ndarray:
    """Largest gain, sum of the three largest, and log of one more than the number of windows, of each text."""
    out, cache = np.zeros((len(texts), 3)), model.cache
    for i, text in enumerate(texts):
        own = words(text)
        if not own:
            continue
        try:
            got = [cache[w] for w in own]
        except KeyError:
            if len(cache) > _CACHE:
                cache.clear()
            new = list(dict.fromkeys(w for w in own if w not in cache))
            cache.update(zip(new, gains(new, model), strict=True))
            got = [cache[w] for w in own]
        a = np.array(got)
        top = np.sort(np.partition(a, -3)[-3:] if len(a) > 3 else a).clip(0)
        out[i] = top[-1], top.sum(), np.log1p(len(a))
    return out


def _fill(ranked: list[bytes], size: int) -> bytes:
    """The first of ranked that fit, the first one last."""
    out = b""
    for w in ranked:
        if len(out) + len(w) + 1 > size:
            break
        out = b" " + w + out
    return out


def _triples(text: bytes) -> Counter:
    """How often each word occurs between each pair of neighbours."""
    w = words(text)
    return Counter(zip([b"", *w[:-1]], w, [*w[1:], b""], strict=True))


def _counted(texts: list[bytes]) -> tuple[Counter, Counter]:
    """Of each word the number of different pairs of neighbours, and of its occurrences."""
    seen: Counter = Counter()
    for t in texts:
        seen.update(_triples(t))
    near, often = Counter(w for _, w, _ in seen), Counter()
    for (_, w, _), n in seen.items():
        often[w] += n
    return near, often


def _starts(counts: Counter, shortest: int = 5, longest: int = 12) -> Counter:
    """Counts of the words' beginnings of shortest to longest bytes."""
    out: Counter = Counter()
    for w, c in counts.items():
        if len(w) >= shortest:
            text = w.decode("utf-8", "ignore")
            for k in range(2, len(text) + 1):
                b = text[:k].encode()
                if shortest <= len(b) <= longest:
                    out[b] += c
    return out


def dictionaries(o: Counter, t: Counter, common: Counter, *, ordinary_size: int = 16384, toxic_size: int = 4096, ratio: float = 50.0, least: int = 5) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries, from the pairs of neighbours of each word in ordinary (o) and toxic texts (t) and the words' occurrences in ordinary ones: toxic words, and beginnings that
    several of them share, occur between at least `least` pairs of neighbours and are `ratio` times likelier in toxic texts."""
    n_o, n_t = max(1, o.total()), max(1, t.total())
    starts_o, starts_t = _starts(o), _starts(t)
    extended: dict[bytes, int] = {}  # of each beginning, the most that one character more has
    for w, c in starts_t.items():
        shorter = w[:-1].decode("utf-8", "ignore").encode()
        extended[shorter] = max(extended.get(shorter, 0), c)
    stems = {w: c for w, c in starts_t.items() if c > 1.3 * extended.get(w, 0)}
    seen = {w: (c, o[w]) for w, c in t.items()} | {w: (c, starts_o[w]) for w, c in stems.items()}
    chosen = [w for w, (c, d) in seen.items() if c >= least and (c / n_t) / ((d + 0.5) / n_o) >= ratio]
    chosen.sort(key=lambda w: (-seen[w][0], w))
    return _fill(sorted(common, key=lambda w: (-common[w], w)), ordinary_size), _fill(chosen, toxic_size)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, classes weighted alike."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta).clip(-30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * 0.5
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def calibrated(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """model with the weights and the threshold that serve best on texts of features x and labels y, which its dictionaries have not seen."""
    if not model.toxic or not (y == 1).any() or not (y == 0).any():
        return model
    beta = _logistic(x, y)
    own = _probability(x, beta)
    p = np.sort(own)
    levels = np.unique(np.concatenate((p[:-1] + np.diff(p) / 2, [0.5])))
    truth = y == 1
    f1 = np.array([2 * ((own >= v) & truth).sum() / max(1, (own >= v).sum() + truth.sum()) for v in levels])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return Model(model.ordinary, model.toxic, tuple(beta.tolist()), float(levels[best[len(best) // 2]]))


def fit(texts: list[bytes], toxic: list[int], calibrate: list[bool], **sizes) -> Model:
    """Dictionaries from the rows that aren't for calibration, weights and threshold from those that are."""
    y, held = np.array(toxic), np.array(calibrate, bool)
    (o, common), (t, _) = (_counted([x for x, l, h in zip(texts, y, held, strict=True) if l == k and not h]) for k in (0, 1))
    model = Model(*dictionaries(o, t, common, **sizes))
    return calibrated(model, features([x for x, h in zip(texts, held, strict=True) if h], model), y[held])


def _probability(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(beta[0] + x @ beta[1:]).clip(-30, 30)))


def scores(texts: list[bytes | None], model: Model) -> np.ndarray:
    """0 to 1; the calibrated threshold is at PREDICT_AT."""
    if not model.weights:
        return np.zeros(len(texts))
    p, t = _probability(features(texts, model), np.array(model.weights)), model.threshold
    return np.where(p < t, PREDICT_AT * p / t, PREDICT_AT + (1 - PREDICT_AT) * (p - t) / max(1e-12, 1 - t))


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2500, **sizes) -> Model:
    """Fit on at most per_class different labelled texts of each class (those of the smallest hashes) for which learn, a condition on the labels' id, holds; a third of them are for calibration. Texts are
    read whole, in the tasks: what comes to the driver are counts of the sample's words and the features of its calibration texts."""
    marked = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).filter("y IN (0, 1)")
    text = F.col(text_col).cast("binary")
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col, text, F.lit(77)).alias("key"), text.alias("text"))
    keys = rows.join(marked, "id").groupBy("key").agg(F.max("y").alias("y"))
    chosen = cut(keys.filter("y = 0").orderBy("key").limit(per_class).unionByName(keys.filter("y = 1").orderBy("key").limit(per_class)))
    held = (F.pmod(F.xxhash64("key", F.lit(5)), F.lit(3)) == 0).alias("held")
    sample = cut(rows.join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.first("text").alias("text")).select("y", held, "text"))

    def count(batch: pa.RecordBatch) -> pa.Table:
        seen: list[Counter] = [Counter(), Counter()]
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[y].update(_triples(t))
        flat = [(y, w, b" ".join(k), n) for y in (0, 1) for k, n in seen[y].items() for w in (k[1],)]
        return pa.table({"y": pa.array([r[0] for r in flat], pa.int32()), "word": pa.array([r[1] for r in flat], pa.binary()), "triple": pa.array([r[2] for r in flat], pa.binary()), "n": pa.array([r[3] for r in flat], pa.int64())})

    triples = map_batches(sample.filter("NOT held").select("y", "text"), "y int, word binary, triple binary, n bigint", count)
    counts = triples.groupBy("y", "word", "triple").agg(F.sum("n").alias("n")).groupBy("y", "word").agg(F.count("*").alias("near"), F.sum("n").alias("n")).toArrow()
    y, found, near, often = (counts.column(c).to_pylist() for c in ("y", "word", "near", "n"))
    pick = lambda k, v: Counter({w: n for w, n, l in zip(found, v, y, strict=True) if l == k})
    model = Model(*dictionaries(pick(0, near), pick(1, near), pick(0, often), **sizes))
    if not model.toxic:
        return model

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(1).to_pylist(), model)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(3))], ["y", "a", "b", "c"])

    seen = map_batches(sample.filter("held").select("y", "text"), "y int, a double, b double, c double", measure).orderBy("y", "a", "b", "c").toArrow()
    return calibrated(model, np.stack([seen.column(c).to_numpy() for c in "abc"], 1), seen.column("y").to_numpy())


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The columns keep, score and predicted (1 from PREDICT_AT on) of each row; one narrow pass over whole texts."""
    kept = docs.select(*keep, F.col(text_col).cast("binary").alias("__kw_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scores(batch.column(len(keep)).to_pylist(), model)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= PREDICT_AT).astype(np.int32))], [*keep, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["score double", "predicted int"])
    return map_batches(kept, schema, run)
