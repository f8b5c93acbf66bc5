"""Token counts by Viterbi search over a unigram vocabulary, without making the tokens.

The text's spaces become U+2581, one is put in front, and the text is split before each. An Aho-Corasick automaton lists, for every end in such a part, the vocabulary pieces that end there, longest first; dynamic programming
keeps for each end the best score and its number of pieces. Tie rules are those of the tokenizers library's Unigram model: of equal scores the earliest start wins, a character that is no piece itself costs
the lowest score less 10 and becomes one token for each of its bytes (byte fallback).

Parts recur, so their results are remembered by worker, up to a bound in bytes. Malformed UTF-8 is read with U+FFFD in its place. Defined results: null and empty texts have no token and score 0; repeated rows have equal counts; texts are read whole,
however long. Only the named columns are read.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import KEPT, decoded, map_batches

SPACE = "▁"
_PENALTY = 10.0
_CACHE_BYTES = 64 << 20


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0):
        self.automaton = ahocorasick.Automaton()
        self.pieces, self.unknown = {}, pieces[unknown][0]
        for piece, score in pieces:
            if piece and piece not in self.pieces:
                self.pieces[piece] = float(score)
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, s in pieces) - _PENALTY
        self.held = 0
        self.counts: dict[str, int] = {}
        self.scores: dict[str, float] = {}

    def part(self, part: str) -> tuple[int, float]:
        """Tokens and score of one part."""
        if self.unknown in part:
            return self._with_unknown(part)
        n, low, done = len(part), self.unknown_score, 0
        best, count, single = [0.0] + [-float("inf")] * n, [0] * (n + 1), bytearray(n + 1)
        for last, (size, score) in self.automaton.iter(part):
            end = last + 1
            while done < last:
                done += 1
                if not single[done] and best[done - 1] + low > best[done]:
                    best[done], count[done] = best[done - 1] + low, count[done - 1] + len(part[done - 1].encode())
            if size == 1:
                single[end] = 1
            candidate = best[end - size] + score
            if candidate > best[end]:
                best[end], count[end] = candidate, count[end - size] + 1
        while done < n:
            done += 1
            if not single[done] and best[done - 1] + low > best[done]:
                best[done], count[done] = best[done - 1] + low, count[done - 1] + len(part[done - 1].encode())
        return count[n], best[n]

    def _with_unknown(self, part: str) -> tuple[int, float]:
        """As part(), where the unknown piece's own name occurs: neighbouring unknown pieces are one, and it is a token or the bytes of all."""
        n, low = len(part), self.unknown_score
        best, start, ends = [0.0] + [-float("inf")] * n, [0] * (n + 1), [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(part):
            ends[last + 1].append(found)
        lone = [True] * (n + 1)
        for e in range(1, n + 1):
            for size, score in ends[e]:
                if best[e - size] + score > best[e]:
                    best[e], start[e], lone[e] = best[e - size] + score, e - size, part[e - size : e] == self.unknown
            if all(size != 1 for size, _ in ends[e]) and best[e - 1] + low > best[e]:
                best[e], start[e], lone[e] = best[e - 1] + low, e - 1, True
        total, e = 0, n
        while e:
            if not lone[e]:
                total, e = total + 1, start[e]
                continue
            s = e
            while s and lone[s]:
                s = start[s]
            total += 1 if part[s:e] in self.pieces else len(part[s:e].encode())
            e = s
        return total, best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = text.replace(SPACE, " ").split(" ")
        if not parts[0] and len(parts) > 1:
            del parts[0]
        counts, scores = self.counts, self.scores
        try:
            return sum([counts[p] for p in parts]), sum([scores[p] for p in parts])
        except KeyError:
            if self.held > _CACHE_BYTES:
                counts.clear()
                scores.clear()
                self.held = 0
            for p in parts:
                if p not in counts:
                    counts[p], scores[p] = self.part(SPACE + p)
                    self.held += 2 * len(p) + 250
            return sum([counts[p] for p in parts]), sum([scores[p] for p in parts])


_counters: dict[str, Counter] = {}
KEPT["tokencount"] = _counters


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The columns keep, n_tokens and score of each row, by the vocabulary in the sentencepiece file at path; one narrow pass."""
    kept = docs.select(*keep, F.col(text_col).cast("binary").alias("__kw_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _counters:
            _counters[path] = Counter(vocabulary(path))
        found = [_counters[path].text(t) for t in decoded(batch.column(len(keep)))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], [*keep, "n_tokens", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["n_tokens bigint", "score double"])
    return map_batches(kept, schema, run, keeps="tokencount")
