import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from kinweave.llm import alignment, hardneg, neighbours, queries
from tests.llm.helpers import LONG, ROWS, awkward, empty, table

A, B = (public_tokenizers.path(n) for n in (queries.BYTE_TOKENIZER, queries.COUNT_TOKENIZER))
ODD = ["a  b\t\n\n c", "  lead", "trail  ", "é́x", "🙂🙂 hi 🙂", "a\x00b", "▁x ▁", "x\xa0y z", "'s 't\r\n I'll", "日本語テキスト", "<|endoftext|> <s> </s>", "x" * 3000, " ", "\n"]


# --- alignment

def _brute(aligner, text):
    """Tokens by the libraries themselves, groups and links one by one."""
    from tokenizers import Tokenizer

    if not text:
        return 0, 0, 0, "", []
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    a, b = slow.encode(" " + text, add_special_tokens=False).ids, aligner.b.model.encode(text)
    byte = alignment.byte_of()
    ra = [bytes(byte[c] for c in slow.id_to_token(i)) for i in a]
    rb = [bytes([int(p[3:5], 16)]) if aligner.b.model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [aligner.b.model.id_to_piece(i)]]
    if b"".join(ra) != (" " + text).encode() or b"".join(rb) != (" " + text).encode():
        return 0, 0, 0, "", []
    spans = lambda raw: [(e - len(r), e) for r, e in zip(raw, np.cumsum([len(r) for r in raw]).tolist(), strict=True)]
    sa, sb = spans(ra), spans(rb)
    links = [(i, j) for i, (_, e) in zip(a, sa, strict=True) for j, (_, f) in zip(b, sb, strict=True) if e == f] if len(a) < 1500 else None
    ends = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, before = [], 0
    for e in ends:
        groups.append(",".join(str(i) for i, s in zip(a, sa, strict=True) if before < s[1] <= e) + "|" + ",".join(str(i) for i, s in zip(b, sb, strict=True) if before < s[1] <= e))
        before = e
    return len(a), len(b), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def test_alignment_against_brute_force(spark):
    aligner = alignment.Aligner(A, B)
    odd = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    docs = awkward(spark).unionByName(odd, allowMissingColumns=True)
    texts = [r["text"] for r in docs.select("text").collect()]
    want = {t: _brute(aligner, t) for t in texts if t is None or len(t) < 5000}
    counts = Counter(link for t in texts for link in (want[t][4] if t in want else _links(aligner, t)))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for most_pairs in (alignment.MOST_PAIRS, 0):
        rows = alignment.alignment(docs.withColumns({"pairs": F.lit(7), "n_a": F.lit(8)}), A, B, keep=["doc_id", "text"], most_pairs=most_pairs).collect()
        assert len(rows) == len(texts)
        for r in rows:
            links = want[r["text"]][4] if r["text"] in want else _links(aligner, r["text"])
            if r["text"] in want:
                assert (r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) == want[r["text"]][:4], r["text"]
            assert r["n_links"] == len(links) and r["count_sum"] == sum(counts[x] for x in links)
            assert r["n_best"] == sum(counts[x] == most[x[1]] for x in links)
    assert want["▁x ▁"][0] == 0 and want["<|endoftext|> <s> </s>"][0] > 3
    assert alignment.alignment(empty(spark), A, B, keep=["doc_id"]).count() == 0


def _links(aligner, text):
    (_, _, _, _, pairs, times), = aligner.align([text])
    return [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p, n in zip(pairs, times, strict=True) for _ in range(n)]


def test_alignment_slices_and_batches_change_nothing(monkeypatch):
    aligner = alignment.Aligner(A, B)
    texts = [LONG[:6000], "ab  cd ef\n gh " * 300, None, "x y", "ÄÖ 日本 " * 200, "a" * 4000, "it's  I'll 12 ab!! " * 99]
    whole = aligner.align(texts)
    one = [aligner.align([t])[0] for t in texts]
    real = alignment.slices
    monkeypatch.setattr(alignment, "slices", lambda t: real(t, 50))
    small = aligner.align(texts)
    for x, y, z in zip(whole, one, small, strict=True):
        assert x[:4] == y[:4] == z[:4]
        assert all((x[k] == y[k]).all() and (x[k] == z[k]).all() for k in (4, 5))
    assert "".join(real(texts[1], 50)) == texts[1] and len(list(real(texts[1], 50))) > 20


# --- quality

def test_quality_held_out(spark):
    found = queries.op11_quality(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").quality
    both = found.join(labels, how="inner")
    held = both[both.held_out]
    assert len(found) == 1000 and ((held.predicted == held.quality).mean() > 0.95)
    assert (held[held.quality == 0].predicted == 0).mean() > 0.8
    assert ((found.score >= 0.3) == (found.predicted == 1)).all() and found.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in found.held_out.items())


def test_quality_counts_and_votes_by_hand():
    text = "The THE!! the, the, 42 Ærø " * 50
    c = neighbours.counted(text.encode())
    assert c.sum() == 3 * 300 and (neighbours.counted(None) == 0).all() and (neighbours.counted(b" \n") == 0).all()
    whole = neighbours.counted((text * 9).encode())
    old, neighbours._SLICE = neighbours._SLICE, 100
    try:
        assert (neighbours.counted((text * 9).encode()) == whole).all()
    finally:
        neighbours._SLICE = old
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.05, (90, neighbours.TERMS)).astype(np.float32)
    labels = (np.arange(90) % 3 > 0).astype(int)
    counts[labels == 0, :40] += 3
    model = neighbours.fit(counts, labels, (300, 900), np.ones(neighbours.TERMS, np.float32))
    v = neighbours.embed(counts, model)
    exact = np.linalg.svd(neighbours.weighted(counts, model.weights).astype(float), full_matrices=False)[2][:8]
    assert np.allclose(np.abs(np.sum(exact * model.axes[:, :8].T, 1)), 1, atol=0.05) or np.linalg.norm(exact @ model.axes) > 0.95 * np.sqrt(8)
    want = []
    for row in v:
        cosines = np.rint(model.vectors @ row * 1e5)
        near = sorted(range(90), key=lambda i: -cosines[i])[: neighbours.NEIGHBOURS]
        w = [max(0, cosines[i]) * model.votes[labels[i]] for i in near]
        want.append(sum(x for x, i in zip(w, near, strict=True) if labels[i] == 1) / sum(w))
    assert np.mean(np.abs(neighbours.raw_scores(v, model) - want) < 1e-3) > 0.97  # ties at the last place
    assert ((neighbours.scores(counts, model) >= 0.3) == (labels == 1)).mean() > 0.95


def test_quality_awkward(spark, tmp_path):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 0), (6, 0), (7, 0), (9, 1), (9, 0), (None, 1), (8, None)], "doc_id bigint, quality int")
    model = neighbours.train(docs, labels, F.lit(True))
    rows = neighbours.score(docs, model, keep=[c for c in docs.columns if c not in ("score",)]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[3] == by[4] == by[10] and len({r["score"] for r in rows if r["doc_id"] == 9}) == 1
    none = neighbours.train(empty(spark), labels.limit(0), F.lit(True))
    assert none.share == 0.5 and {r["score"] for r in neighbours.score(docs, none, keep=["doc_id"]).collect()} == {0.5}
    at = table(tmp_path, spark, documents=empty(spark), labels=labels)
    assert queries.op11_quality(spark, at).count() == 0


# --- hard negatives

def _mined(rows, anchor, positives=5, negatives=10, scale=256):
    """By definition, over all pairs."""
    own = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, label, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    out = []
    last = lambda i: (i is None, i or 0)
    for i, label, v in own:
        if i is None or not anchor(i):
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, m, w in own]
        best = sorted((x for x in score if x[2] == label and x[1] != i), key=lambda x: (-x[0], last(x[1])))[:positives]
        for p, j, _ in best:
            fit = sorted((x for x in score if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p), key=lambda x: (-x[0], last(x[1])))[:negatives]
            out += [(i, j, r, x[1], p, x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out, key=str)


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in np.float32(rng.integers(-2, 3, 4) / 4)]) for i in range(300)]  # many equal scores
    rows += rows[20:23] + [(301, None, [1.0] * 4), (302, 1, None), (303, 1, [1.0, None, 0.0, 0.0]), (304, 1, [float("nan"), 0.0, 0.0, 0.0]), (305, 2, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, [0.5, 0.5, 0.5, 0.5]), (306, 1, [0.5, 0.25]), (310, 0, [])]
    df = spark.createDataFrame(rows, "vec int, label int, emb array<float>").withColumns({c: F.lit("clash") for c in ("id", "q", "w", "v", "score", "rank", "low")})
    want = _mined(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    for numbers, part in ((hardneg.MOST_NUMBERS, 8192), (900, 100)):
        found = hardneg.mine(df, F.col("id") % 10 == 0, id_col="vec", most_numbers=numbers, part=part)
        assert sorted((tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str) == want
    assert hardneg.mine(df.limit(0), F.col("id") % 10 == 0, id_col="vec").count() == 0
    assert hardneg.mine(df, F.lit(False), id_col="vec").count() == 0
    huge = spark.createDataFrame([(0, 1, [1e6, 1.0]), (1, 1, [1e6, 2.0]), (2, 2, [6e5, 0.0]), (3, 2, [1e30, 0.0])], "vec int, label int, emb array<double>")
    (got,) = hardneg.mine(huge, F.col("id") == 0, id_col="vec").collect()
    assert got["positive_score"] == 256_000_000**2 + 256 * 512 and got["negative_score"] == 256_000_000 * 153_600_000 and got["negative_id"] == 2


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 400
    v = np.rint(centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 8)) * 8).astype(np.int64)
    v[2000:2400] = v[0]
    points, seen = hardneg.augmented(v.astype(float)), []

    def below(node):
        rows = list(node.rows[: node.singles])
        for centre, radius, kid in zip(node.rows[node.singles :], node.radii, node.kids, strict=True):
            own = below(kid)
            assert np.sqrt(((points[own] - points[centre]) ** 2).sum(1)).max() <= radius * (1 + 1e-6) + 1e-3
            rows += own
        return rows

    root = hardneg.cover_tree(v)
    seen = below(root)
    assert sorted(seen) == list(range(3000))
    labels, ids = rng.integers(0, 4, 3000), rng.permutation(3000)
    q = v[::100]
    low, high = np.full(len(q), -(1 << 60)), np.full(len(q), 1 << 60)
    s = hardneg.Searched(ids[::100], labels[::100], q, np.arange(len(q)), low, high, 5, True)
    for a in range(0, 3000, 1000):
        s.chunk(ids[a : a + 1000], labels[a : a + 1000], v[a : a + 1000])
    for i in range(len(q)):
        fit = np.flatnonzero((labels == labels[i * 100]) & (ids != ids[i * 100]))
        score = v[fit] @ q[i]
        best = fit[np.lexsort((ids[fit], -score))[:5]]
        order = np.lexsort((s.found[i][1], -s.found[i][0]))
        assert s.found[i][1][order].tolist() == ids[best].tolist()
    assert s.looked < 0.5 * len(q) * 3000 and s.skipped > 0
    assert hardneg.cover_tree(v[:0]) is None and pa.table({}).num_rows == 0


# --- substring dedup

def test_spans_with_a_third_document_and_repeated_beginnings(spark):
    """Passages of documents 5 and 9, whose middle document 1 has too; passages of 2 and 7, whose beginning stands earlier in 2 as well. Every one is found whole, at any length of words, and only there."""
    import random

    from kinweave.llm import substring

    rng = random.Random(4)
    some = lambda n, k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, k))) for _ in range(n))
    rows, want = [], {}
    for t in range(36):
        k, b = (5, 9, 14)[t % 3], 10 * t
        p, q = some(86, k), some(60, k)
        middle, beginning = " ".join(p.split()[20:66]), " ".join(q.split()[:42])
        rows += [(b + 1, f"{some(40, k)} {middle} {some(40, k)}"), (b + 5, f"{some(30, k)} {p} {some(50, k)}"), (b + 9, f"{some(70, k)} {p} {some(20, k)}")]
        rows += [(b + 2, f"{some(30, k)} {beginning} {some(40, k)} {q} {some(9, k)}"), (b + 7, f"{some(33, k)} {q} {some(31, k)}")]
        want |= {(b + 5, False): p, (b + 9, True): p, (b + 2, False): q, (b + 7, True): q}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found, texts = substring.spans(docs).collect(), dict(rows)
    for (i, repeated), passage in want.items():
        mine = [texts[i].encode()[r["start"] : r["start"] + r["size"]] for r in found if r["id"] == i and r["repeated"] == repeated]
        assert any(passage.encode() in m for m in mine), (i, repeated)
    assert {r["id"] for r in found if r["repeated"]} == {i for i, repeated in want if repeated}
    for r in found:  # what is reported stands in another document, and has the words it says
        span = texts[r["id"]].encode()[r["start"] : r["start"] + r["size"]]
        assert any(span in t.encode() for i, t in rows if i != r["id"])
        assert abs(len(span.split()) - r["words"]) <= 1
    left = {r["doc_id"]: r["text"] for r in substring.remove(docs, substring.spans(docs)).collect()}
    assert not any(" ".join(p.split()[1:-1]) in left[i] for (i, repeated), p in want.items() if repeated)


def test_long_shared_stretches_are_extended_to_their_ends(spark):
    from kinweave.llm import substring

    rng = np.random.default_rng(8)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    p = some(4000)
    parts = [p[a : a + 1400] for a in range(0, len(p), 2600)]  # first holders of parts of it, all over
    rows = [(i, f"{some(20)} {x} {some(20)}") for i, x in enumerate(parts)] + [(100, f"{some(60)} {p} {some(9)}"), (200, f"{some(7)} {p}")]
    found = [r for r in substring.spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r["id"] == 200]
    assert max(r["size"] for r in found) >= len(p) - 2 and any(abs(r["words"] - 4000) <= 2 for r in found if r["size"] >= len(p) - 2)


# --- language

def test_language_profiles_in_pieces_are_the_whole_texts():
    from kinweave.llm import langid

    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdeéßΣσıİ  .,\n1日本")) for _ in range(5000))
    texts = [text, "ab " * 900, "x" * 3000, "  12 " * 700, "ÄΣ ΑΣ. " * 400, None, "word"]
    whole, has = langid.bundle(texts, 128, chars=1 << 19)
    for chars in (40, 333, 1024):
        pieces, also = langid.bundle(texts, 128, chars=chars)
        assert np.array_equal(whole, pieces) and np.array_equal(has, also), chars
    long = (text * 211)[: 1 << 20]
    assert np.array_equal(langid.bundle([long], 64)[0], langid._bundle([long], 64, 3, 7)[0])
