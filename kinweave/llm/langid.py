"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (a function of its code point and a seed). An n-gram's vector binds its letters: the letter k places
from the end is rotated k places and all are multiplied element by element. A text's profile bundles (sums) the vectors of all its n-grams, each as often
as it occurs; a language's prototype bundles the unit profiles of its labelled texts. A text gets the language whose prototype has the largest
cosine with its profile.

Texts are lower-cased; any run of characters that are not letters is one boundary symbol with a vector of its own, and each text begins and ends with one.

A text of more than 2**19 characters is bundled in pieces, which bounds memory whatever a text's length; pieces overlap by a few symbols that are counted once, so its profile is that of the whole text.

Defined results: null, empty or letterless texts give `und` with score 0; equal cosines go to the alphabetically first language; without any labelled text
every text is `und`. Malformed UTF-8 is read with U+FFFD in its place, which is no letter. Repeated rows are treated alike. Only the named id, text and language columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded, decoded, forget, map_batches, unit_hash

UNKNOWN = "und"
_POINTS = 0x110000
_letter: np.ndarray | None = None
_vectors: dict[tuple[int, int, int], np.ndarray] = {}


@dataclass(frozen=True)
class Profiles:
    """languages[i] has prototype[i], of length one."""

    languages: list[str]
    prototype: np.ndarray
    dim: int = 1024
    gram: int = 3
    seed: int = 7
    min_score: float = field(default=0.0)


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS)
    return _letter


def letter_vector(point: int, dim: int, seed: int) -> np.ndarray:
    key = (point, dim, seed)
    if key not in _vectors:
        bits = np.random.Generator(np.random.Philox(key=[seed, point])).integers(0, 2, dim, dtype=np.int8)
        _vectors[key] = (bits * 2 - 1).astype(np.int8)
    return _vectors[key]


def _bundle(texts: list[str], dim: int, gram: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Profiles of a few texts, and whether each has a letter."""
    out, has = np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), bool)
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    symbols = np.where(_letters()[points], points, 0).astype(np.int32)
    keep = symbols != 0
    has[:] = np.bincount(owner[keep], minlength=len(texts)) > 0
    keep[1:] |= symbols[:-1] != 0
    symbols, owner = np.concatenate(([0], symbols[keep])), np.concatenate((owner[:1], owner[keep]))
    if len(symbols) < gram:
        return out, has
    seen = np.zeros(_POINTS, bool)
    seen[symbols] = True
    alphabet = np.flatnonzero(seen)
    lookup = np.zeros(_POINTS, np.int32)
    lookup[alphabet] = np.arange(len(alphabet))
    place, n, size = lookup[symbols].astype(np.int64), len(symbols) - gram + 1, len(alphabet)
    code = place[:n].copy()
    for k in range(1, gram):
        code = code * size + place[k : k + n]
    first, last = owner[:n], owner[gram - 1 : gram - 1 + n]
    # a boundary belongs to the text that it ends, and is also the first symbol of the next one
    inside = first == last
    inside |= (symbols[:n] == 0) & (owner[1 : 1 + n] == last) & (gram > 1)
    code, mine = code[inside], last[inside]
    if size**gram <= 1 << 24:
        flags = np.zeros(size**gram, bool)
        flags[code] = True
        grams = np.flatnonzero(flags)
        index = np.zeros(size**gram, np.int32)
        index[grams] = np.arange(len(grams))
        which = index[code]
    else:
        grams, which = np.unique(code, return_inverse=True)
    if not len(grams):
        return out, has
    letters = np.stack([letter_vector(int(p), dim, seed) for p in alphabet])
    step = max(1, (1 << 22) // dim)
    flat = mine.astype(np.int64) * len(grams) + which
    if len(texts) * len(grams) <= 1 << 22:
        counts = np.bincount(flat, minlength=len(texts) * len(grams)).reshape(len(texts), len(grams)).astype(np.float32)
        parts = ((counts[:, a : a + step], grams[a : a + step]) for a in range(0, len(grams), step))
    else:  # very many different n-grams: one text after another
        half = len(texts) // 2
        if half:
            a, b = _bundle(texts[:half], dim, gram, seed), _bundle(texts[half:], dim, gram, seed)
            return np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        counts = np.bincount(which, minlength=len(grams)).reshape(1, -1).astype(np.float32)
        parts = ((counts[:, a : a + step], grams[a : a + step]) for a in range(0, len(grams), step))
    for part, some in parts:
        bound, rest = None, some
        for k in range(gram):
            turned = np.roll(letters, k, axis=1)[rest % size]
            bound, rest = turned if bound is None else bound * turned, rest // size
        out += part @ bound.astype(np.float32)
    return out, has


def _lead(text: str, at: int, gram: int) -> str:
    """What a piece that begins at `at` has to begin with, so that n-grams over its beginning are the whole text's: the end of the piece before, with at least gram - 1 symbols (letters, and what
    parts them); a few more, for letters whose small form depends on the ones before."""
    back, symbols, letter, gram = at, 0, None, gram + 8
    while back > 0 and symbols < gram:
        back -= 1
        now = text[back].isalpha()
        symbols += now or letter is not False
        letter = now
    return text[back + 1 if symbols == gram else back : at]


def _pieces(text: str, chars: int) -> Iterator[str]:
    """text in pieces of at most chars characters, ending behind a space where there are any."""
    at = 0
    while len(text) - at > chars:
        space = text.rfind(" ", at + chars // 2, at + chars)
        stop = space + 1 if space > 0 else at + chars
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def bundle(texts: list[str | None], dim: int = 1024, gram: int = 3, seed: int = 7, chars: int = 1 << 19, docs: int = 192) -> tuple[np.ndarray, np.ndarray]:
    """Profiles of all texts, worked off in groups of bounded size, and whether each has a letter. Of a text of more than chars characters the profiles of its pieces are added up: each piece but the first
    begins with the last symbols of the one before, whose own n-grams, counted in both, are taken off again. So pieces change nothing."""
    out, letters = np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), bool)
    group, owner, sign, size = [], [], [], 0

    def settle() -> None:
        nonlocal group, owner, sign, size
        if group:
            profiles, has = _bundle(group, dim, gram, seed)
            np.add.at(out, owner, profiles * np.array(sign, np.float32)[:, None])
            np.logical_or.at(letters, owner, has)
            group, owner, sign, size = [], [], [], 0

    for i, t in enumerate(texts):
        at, text = 0, t or ""
        for piece in _pieces(text, chars):
            if size + len(piece) > chars or len(group) >= docs:
                settle()
            lead = _lead(text, at, gram) if at else ""
            group.append(lead + piece), owner.append(i), sign.append(1)
            if at:
                group.append(lead), owner.append(i), sign.append(-1)
            at += len(piece)
            size += len(piece)
    settle()
    return out, letters


def train(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, dim: int = 1024, gram: int = 3, seed: int = 7) -> Profiles:
    """Prototypes from the rows where learn holds and the language is known: of each language about per_language rows, those of the smallest hashes of the id
    (all if there are fewer). The bound is per language and does not depend on the number of rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn")).filter("learn AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles([], np.zeros((0, dim), np.float32), dim, gram, seed)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    chosen = rows.filter(unit_hash(F.col("id")) < share[F.col("lang")]).select("lang", F.col("text").cast("binary"))

    def add(batch: pa.RecordBatch) -> pa.Table:
        profiles, has = bundle(decoded(batch.column(1)), dim, gram, seed)
        norms = np.linalg.norm(profiles, axis=1)
        units = profiles / np.where(norms > 0, norms, 1)[:, None]
        langs = np.array(batch.column(0).to_pylist(), object)
        names = sorted(set(langs[has]))
        return pa.table({"lang": pa.array(names, pa.string()), "profile": pa.array([units[(langs == x) & has].sum(0).tolist() for x in names], pa.list_(pa.float32()))})

    def total(group: pa.Table) -> pa.Table:
        profile = np.stack(group.column("profile").to_pylist()).sum(0, dtype=np.float64)
        return pa.table({"lang": group.column("lang").slice(0, 1), "profile": pa.array([profile.astype(np.float32).tolist()], pa.list_(pa.float32()))})

    found = map_batches(chosen, "lang string, profile array<float>", add).groupBy("lang").applyInArrow(total, "lang string, profile array<float>").collect()
    found.sort(key=lambda r: r["lang"])
    prototype = np.array([r["profile"] for r in found], np.float32).reshape(len(found), dim)
    norms = np.linalg.norm(prototype, axis=1)
    return Profiles([r["lang"] for r in found], prototype / np.where(norms > 0, norms, 1)[:, None], dim, gram, seed)


def decide(texts: list[str | None], model: Profiles) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine (0 to 1) and lead over the second language of each text."""
    profiles, has = bundle(texts, model.dim, model.gram, model.seed)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    norms = np.linalg.norm(profiles, axis=1)
    cosine = (profiles @ model.prototype.T).astype(np.float64) / np.where(norms > 0, norms, 1)[:, None]
    best = cosine.argmax(1)
    top = cosine[np.arange(len(texts)), best]
    second = np.partition(cosine, -2, axis=1)[:, -2] if len(model.languages) > 1 else np.zeros(len(texts))
    known = has & (norms > 0)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, top.clip(0, 1), 0.0), np.where(known, top - second, 0.0)


def predict(docs: DataFrame, model: Profiles, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) of each row with lang_pred, score and lead after them; columns of those names are replaced. One narrow pass without a shuffle: only the text goes to Python,
    once, and all other columns stay in the JVM."""
    bounded(docs.sparkSession)
    added = ("lang_pred", "score", "lead")

    @F.arrow_udf("struct<lang_pred string, score double, lead double>")
    def judge(texts: pa.Array) -> pa.Array:
        forget()
        lang, score, lead = decide(decoded(texts), model)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.float64())], list(added))

    judge = judge.asNondeterministic()  # so it is not run again for a filter
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns) if c not in added]
    return docs.select(*kept, judge(F.col(text_col).cast("binary")).alias("__kw_judged")).select(*kept, *[F.col("__kw_judged")[c].alias(c) for c in added])
