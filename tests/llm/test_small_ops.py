import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinweave.llm import langid, media, queries, substring, tokencount, toxicity, urlfilter
from tests.llm.helpers import LONG, ROWS, awkward, empty, table

SF = "/root/testdata/sf0.001"


# --- language

def test_language_bundle_is_the_sum_of_bound_letters():
    texts = ["ab cé", "", "Z", "a1b", "ab", "日本"]
    got, has = langid.bundle(texts, 64)
    for text, row, known in zip(texts, got, has, strict=True):
        symbols = [0]
        for c in text.lower():
            p = ord(c) if c.isalpha() else 0
            if p or symbols[-1]:
                symbols.append(p)
        if symbols[-1]:
            symbols.append(0)
        want = np.zeros(64)
        for i in range(len(symbols) - 2):
            a, b, c = (langid.letter_vector(s, 64, 7).astype(float) for s in symbols[i : i + 3])
            want += np.roll(a, 2) * np.roll(b, 1) * c
        assert known == any(symbols)
        assert np.array_equal(row, want), text
    one = np.concatenate([langid.bundle([t], 64)[0] for t in texts])
    assert np.array_equal(one, got)


def test_language_held_out_accuracy(spark):
    found = queries.op1_language_id(spark, SF).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").lang
    held = found[found.held_out]
    assert len(found) == len(truth) and (held.lang_pred == truth[held.index]).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_language_awkward(spark, tmp_path):
    docs = awkward(spark)
    model = langid.train(docs, F.col("doc_id").isNotNull())
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert [by[i]["lang_pred"] for i in (3, 4, 7, 10)] == ["und"] * 4 and by[3]["score"] == 0
    assert by[1]["lang_pred"] == "en" and by[6]["lang_pred"] == "la" and by[5]["lang_pred"] == "de"
    assert by[1]["word"] == "clash"
    none = langid.train(empty(spark), F.lit(True))
    assert none.languages == [] and langid.predict(empty(spark), none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert queries.op1_language_id(spark, table(tmp_path, spark, documents=empty(spark))).count() == 0


# --- toxicity

def test_toxicity_held_out(spark):
    found = queries.op3_toxicity(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    toxic = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").toxic
    both = found.join(toxic, how="inner")
    held = both[both.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit >= 0.6 * held.toxic.sum() and hit >= 0.8 * held.predicted.sum()
    assert ((found.score >= 0.7) == (found.predicted == 1)).all() and found.score.between(0, 1).all()


def test_toxicity_gain_separates_words():
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("aeiourstlnm"), rng.integers(3, 9))) for _ in range(300)]
    text = lambda: " ".join(rng.choice(vocabulary, 80))
    ordinary = [text().encode() for _ in range(60)]
    toxic = []
    for _ in range(60):
        w = text().split()
        for _ in range(4):
            w.insert(int(rng.integers(len(w))), str(rng.choice(["quzzbrap", "VEXWOMP!"])))
        toxic.append(" ".join(w).encode())
    model = toxicity.fit(ordinary + toxic, [0] * 60 + [1] * 60, [i % 3 == 0 for i in range(120)])
    assert b"quzzbrap" in model.toxic and b"quzzbrap" not in model.ordinary
    s = toxicity.scores([*ordinary, *toxic, None, b"", b"..."], model)
    assert (s[:60] < 0.7).mean() > 0.95 and (s[60:120] >= 0.7).mean() > 0.95 and (s[120:] < 0.7).all()
    assert toxicity.scores([b"x"], toxicity.fit([], [], []))[0] == 0


def test_toxicity_training_in_tasks_equals_training_at_once(spark):
    """The distributed fit against the plain one over the same rows, and the query's scores against compressing every window by itself."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = queries.residue(F.col("doc_id"), 3) != 1
    sizes = {"least": 2, "ratio": 5.0}
    model = toxicity.train(docs, labels, learn, **sizes)
    rows = docs.join(labels.filter(learn), "doc_id").select("text", "toxic", (F.pmod(F.xxhash64(F.xxhash64("doc_id", F.col("text").cast("binary"), F.lit(77)), F.lit(5)), F.lit(3)) == 0).alias("held")).filter("text IS NOT NULL").collect()
    texts = [r["text"].encode() for r in rows]
    want = toxicity.fit(texts, [r["toxic"] for r in rows], [r["held"] for r in rows], **sizes)
    assert model.toxic and sorted(model.toxic.split()) == sorted(want.toxic.split()) and sorted(model.ordinary.split()) == sorted(want.ordinary.split())
    assert np.allclose(model.weights, want.weights, atol=0.05) and abs(model.threshold - want.threshold) < 0.05
    some = texts[:25]
    for text, got in zip(some, toxicity.features(some, model), strict=True):
        gains = []
        for w in toxicity.words(text):
            size = [len(toxicity._compressor(content).compress(toxicity.CARRIER + b" " + w + b" " + toxicity.CARRIER)) for content in (model.ordinary, model.toxic)]
            gains.append(size[0] - size[1])
        top = [max(0, g) for g in sorted(gains)[-3:]]
        assert got.tolist() == [top[-1], sum(top), np.log1p(len(gains))] if gains else got.tolist() == [0, 0, 0]


def test_toxicity_sample_is_bounded_and_whole(spark):
    filler = "plain words of an ordinary text go on and on here " * 900  # over 32768 characters before the words that count
    rows = [(i, filler + (f"quzzbrap a{i} quzzbrap b{i} quzzbrap" if i % 2 else f"nothing a{i} b{i}")) for i in range(40)] + [(7, "one row " * 3)] * 500
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, labels, F.lit(True), per_class=15, ratio=5.0)
    assert b"quzzbrap" in model.toxic  # late in long texts
    found = toxicity.score(docs.dropDuplicates(), model, keep=["doc_id"]).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in found if r["doc_id"] != 7)


def test_toxicity_awkward(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (None, 1, 1), (6, 1, None), (2, 0, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    sf = table(tmp_path, spark, documents=awkward(spark), labels=labels)
    rows = queries.op3_toxicity(spark, sf).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.train(empty(spark), labels.limit(0), F.lit(True)).toxic == b""


# --- substring

def _naive_ends(data, every, longest):
    hits = []
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - 15) : i + 1]:
            h = (h * 2 + int(substring._GEAR[b])) & 0xFFFF
        hits.append(i >= 15 and h < (1 << 16) // every)
    # hits before a text's 16th byte depend on what precedes it in the batch, and are not ends
    ends, last = [], 0
    for i, hit in enumerate(hits):
        if hit and not any(hits[max(0, i - 15) : i]):
            ends.append(i + 1)
    out = []
    for e in [*ends, len(data)]:
        while e - last > longest:
            last += longest
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return out


def test_substring_chunks_against_brute_force():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 122, int(n), dtype=np.uint8)) for n in (0, 1, 15, 16, 17, 700, 3000, 5)] + [b"a" * 900]
    one = [substring.chunk_ends([t])[0].tolist() for t in texts]
    for t, got in zip(texts, one, strict=True):
        assert got == (_naive_ends(t, substring.EVERY, substring.LONGEST) if t else [])
    ends, owner = substring.chunk_ends(texts)
    begin = np.cumsum([0] + [len(t) for t in texts[:-1]])
    for k, t in enumerate(texts):
        mine = ends[owner == k] - begin[k]
        assert mine[-1:].tolist() == ([len(t)] if t else []) and (np.diff(np.concatenate(([0], mine))) <= substring.LONGEST).all()
    long = bytes(rng.integers(97, 122, 20000, dtype=np.uint8))
    moved = substring.chunk_ends([b"inserted" + long])[0] - 8
    assert len(set(moved.tolist()) & set(substring.chunk_ends([long])[0].tolist())) > 0.95 * len(moved) - 3


def test_substring_passages(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(words, n))
    passages = [text(60) for _ in range(20)]
    rows, planted = [], {}
    for i in range(200):
        t = text(int(rng.integers(50, 300)))
        if i % 4 == 0:
            p = passages[(i // 4) % 20]
            t = text(int(rng.integers(1, 40))) + " " + p + " " + t
            planted.setdefault((i // 4) % 20, []).append(i)
        rows.append((i, t))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substring.spans(docs).collect()
    texts = dict(rows)
    bad = {r["id"] for r in found} - {i for ids in planted.values() for i in ids}
    assert not bad
    for ids in planted.values():
        assert {r["id"] for r in found} >= set(ids) and {r["id"] for r in found if r["repeated"]} >= set(ids[1:])
    for r in found:
        part = texts[r["id"]].encode()[r["start"] : r["start"] + r["size"]]
        assert len(part) == r["size"] and part in texts[r["first_id"]].encode()
    cut = {r["doc_id"]: r["text"] for r in substring.remove(docs, substring.spans(docs)).collect()}
    for r in found:
        if r["repeated"]:
            assert len(cut[r["id"]].encode()) <= len(texts[r["id"]].encode()) - r["size"]
    assert sum(cut[i] == t for i, t in rows) == len(rows) - len({r["id"] for r in found if r["repeated"]})


def _longest_shared(a, b):
    """Maximal common stretches of two byte strings, by brute force: (start in a, size) of those no longer one contains."""
    row, found = [0] * (len(b) + 1), []
    for i in range(1, len(a) + 1):
        last, row = row, [0] * (len(b) + 1)
        for j in range(1, len(b) + 1):
            if a[i - 1] == b[j - 1]:
                row[j] = last[j - 1] + 1
                if i == len(a) or j == len(b) or a[i] != b[j]:
                    found.append((i - row[j], row[j]))
    return found


@pytest.mark.parametrize("accents", [False, True])
def test_substring_spans_are_the_whole_passages(spark, accents):
    rng = np.random.default_rng(11)
    letters = list("aéüñ€𝄞bcdefgh" if accents else "abcdefghijklmnop")
    words = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(0, text(200))]
    for i in range(1, 13):  # passages of 51 words are spans, of 44 none
        passage = text(51 if i % 2 else 44)
        rows += [(2 * i, f"{text(9)} {passage} {text(12)}"), (2 * i + 1, f"{text(15)} {passage} {text(7)}")]
    found = substring.spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = {i: t.encode() for i, t in rows}
    assert {r["id"] for r in found} == {k for i in range(1, 13, 2) for k in (2 * i, 2 * i + 1)}
    for r in found:
        a, b = texts[r["id"]], texts[r["id"] ^ 1]
        start, size = max(_longest_shared(a, b), key=lambda s: s[1])
        while accents and a[start] & 0xC0 == 0x80:
            start, size = start + 1, size - 1
        while accents and start + size < len(a) and a[start + size] & 0xC0 == 0x80:
            size -= 1
        assert (r["start"], r["size"], r["first_id"], r["repeated"]) == (start, size, r["id"] & ~1, r["id"] & 1 == 1)


def test_substring_remove_keeps_characters(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("aéü�€bcdef"), rng.integers(2, 9))) for _ in range(900)]
    passage = " ".join(rng.choice(words, 70))
    rows = [(1, "über " + passage + " ende �"), (2, "für " + passage + "ä �x"), (None, "nur " + passage), (2, "dort " + passage + "."), (3, "andere Wörter �"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted(((str(r["doc_id"]), r["text"]) for r in substring.remove(docs, substring.spans(docs)).collect()), key=str)
    # the r and the space before the passage are shared with the first document too
    assert left == sorted([("1", rows[0][1]), ("2", "füä �x"), ("None", "nu"), ("2", "dort."), ("3", "andere Wörter �"), ("4", None)], key=str)


def test_substring_repeated_identifiers(spark):
    text = lambda k: " ".join(f"{k}w{i * i}" for i in range(400))
    rows = substring.spans(spark.createDataFrame([(1, "one"), (2, text("a")), (2, text("b")), (3, text("b")), (3, text("a"))], "doc_id bigint, text string")).collect()
    assert sorted((r["id"], r["size"]) for r in rows) == sorted([(2, len(text("a"))), (2, len(text("b"))), (3, len(text("a"))), (3, len(text("b")))])


def test_substring_awkward(spark, tmp_path):
    found = substring.spans(awkward(spark)).collect()
    assert not found
    long = " ".join(f"{i * i} words" for i in range(9000))
    rows = substring.spans(spark.createDataFrame([(1, long), (2, "é" + long), (2, long), (None, long)], "doc_id bigint, text string")).collect()
    assert {r["id"] for r in rows} == {1, 2, None} and all(r["first_id"] == 1 for r in rows) and all(r["size"] >= len(long) - 1 for r in rows)
    assert queries.op4_substring_dedup(spark, table(tmp_path, spark, documents=empty(spark))).count() == 0
    assert substring.remove(awkward(spark), substring.spans(awkward(spark))).count() == len(ROWS)


# --- token counts

def test_token_counts_against_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokencount.vocabulary(public_tokenizers.path(queries.COUNT_TOKENIZER))
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [r[1] for r in ROWS if r[1]]
    texts += ["", "a", " a", "a ", "  ", "<unk>é", "é<unk>\n\n", "▁▁", "日本語テスト", "x\ny", "<s>", "a▁b", "<0x0A>", "\n\n\n", " \n ", "<unk>", "<unk><unk> 😀<unk>"]
    counter = tokencount.Counter(pieces)
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [counter.text(t)[0] for t in texts] == want


@pytest.mark.parametrize("seed", range(5))
def test_token_counts_ties_with_small_vocabularies(seed):
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = np.random.default_rng(seed)
    pieces = [("<unk>", 0.0)] + [(p, float(-rng.integers(1, 4))) for p in sorted({"".join(rng.choice(list("▁abc"), rng.integers(1, 4))) for _ in range(12)})]
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    tokenizer = Tokenizer(models.Unigram(pieces + [(f"<0x{i:02X}>", -50.0) for i in range(256)], unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = tokencount.Counter(pieces + [(f"<0x{i:02X}>", -50.0) for i in range(256)])
    texts = ["".join(rng.choice(list("abcd é"), rng.integers(0, 30))) for _ in range(300)]
    assert [counter.text(t)[0] for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_awkward(spark, tmp_path):
    sf = table(tmp_path, spark, documents=awkward(spark))
    rows = queries.op5_token_counts(spark, sf).collect()
    assert len(rows) == len(ROWS) and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (3, 4))
    assert tokencount.count_tokens(empty(spark), public_tokenizers.path(queries.COUNT_TOKENIZER), keep=["doc_id"]).count() == 0


# --- media

def test_media_round_trip_and_general_decoder():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7):
        frames = rng.integers(0, 256, (n, media.SIDE, media.SIDE), dtype=np.uint8)
        frames[0, 0, :4] = (0, 255, 0, 255)
        file = media.write_avi(frames)
        jpegs, fps = media.read_avi(file)
        assert fps == media.FPS and np.array_equal(media.decode_frames(jpegs), frames)
        assert np.array_equal(media.decode_frame(jpegs[-1]), frames[-1])
        without_index = file[: file.rindex(b"idx1")]
        assert media.read_avi(without_index)[0] == jpegs
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF\0\0\0\0WAVE")
    with pytest.raises(ValueError):
        media.decode_frame(b"\xff\xd8\xff\xd9")


def _encoded(spark, rgb, gray):
    """A baseline JPEG by another encoder, and its luminance as that library decodes it."""
    jvm = spark._jvm
    h, w, _ = rgb.shape
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if gray else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, rgb[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    raw = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(raw)))
    if gray:
        return raw, np.array([[back.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])
    p = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
    return raw, 0.299 * (p >> 16) + 0.587 * (p >> 8 & 255) + 0.114 * (p & 255)


@pytest.mark.parametrize("gray", [True, False])
def test_media_decodes_baseline_frames(spark, gray):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:27, 0:37]
    rgb = np.stack([x * 5 + rng.integers(0, 20, x.shape), y * 8 + rng.integers(0, 20, x.shape), 40 + (x + y) * 2], 2).clip(0, 255).astype(np.uint8)
    jpeg, want = _encoded(spark, rgb, gray)
    got = media.decode_frame(jpeg).astype(float)
    assert got.shape == want.shape and np.abs(got - want).max() <= (1 if gray else 4)
    # without its Huffman tables, as motion JPEG often is: they are the standard's
    at = jpeg.index(b"\xff\xc4")
    bare = jpeg[:at] + jpeg[jpeg.index(b"\xff\xda") if jpeg.index(b"\xff\xc0") < at else jpeg.index(b"\xff\xc0") :]
    if len(bare) < len(jpeg):
        assert np.array_equal(media.decode_frame(bare).astype(float), got)
    for broken in (jpeg[:-30], jpeg[: at + 9], b"\xff\xd8"):
        with pytest.raises(ValueError):
            media.decode_frame(broken)


def test_media_of_other_makers(spark):
    dark, _ = _encoded(spark, np.full((16, 24, 3), 20, np.uint8), True)
    light, _ = _encoded(spark, np.full((16, 24, 3), 220, np.uint8), True)
    chunk = media._chunk
    strh = lambda kind, scale, rate: chunk(b"LIST", b"strl" + chunk(b"strh", kind + b"MJPG" + struct.pack("<IHHIII", 0, 0, 0, 0, scale, rate) + b"\0" * 28))
    sound, frames = chunk(b"00wb", b"strh not a header"), [dark] * 5 + [light] * 4
    # a sound stream first, frames in lists, no index
    movie = b"movi" + sound + chunk(b"LIST", b"rec " + b"".join(chunk(b"01dc", f) for f in frames[:5])) + chunk(b"LIST", b"rec " + b"".join(chunk(b"01dc", f) for f in frames[5:]))
    file = chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + strh(b"auds", 1, 8000) + strh(b"vids", 1001, 30000)) + chunk(b"LIST", movie))
    rows = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(file[:300])), (4, bytearray(b"nothing")), (5, bytearray(file))], "i int, media binary")
    found = {r["i"]: r for r in media.read(rows, keep=["i"]).collect()}
    assert [(c["first_frame"], c["end_frame"]) for c in found[1]["clips"]] == [(0, 5), (5, 9)] and abs(found[1]["clips"][1]["start_s"] - 5 * 1001 / 30000) < 1e-9
    assert found[1]["error"] is None and found[5]["payload_sha256"] == found[1]["payload_sha256"] and found[1]["payload_bytes"] == 9 * 16 * 24
    assert all(found[i]["error"] and found[i]["payload_bytes"] is None for i in (2, 3, 4))
    assert media.clips(rows, keep=["i"]).count() == 4


def test_media_shots():
    dark, light = np.full((6, 24, 24), 10, np.uint8), np.full((5, 24, 24), 200, np.uint8)
    found = media.clips_of(media.write_avi(np.concatenate([dark, light, dark])))
    assert [(a, b) for _, a, b, *_ in found] == [(0, 6), (6, 11), (11, 17)] and found[1][3] == 6 / media.FPS
    assert media.cuts(np.zeros(5)).tolist() == [0] and media.cuts(np.zeros(0)).tolist() == []


def test_media_query(spark, tmp_path):
    sf = table(tmp_path, spark, documents=awkward(spark))
    rows = queries.op7_media_columns(spark, sf).collect()
    texts = [r[1] for r in ROWS]
    assert len(rows) == len(texts)
    want = {}
    for t in texts:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        want.setdefault(hashlib.sha256(padded).hexdigest(), (len(raw), len(padded), zlib.crc32(padded[-32:])))
    seen = {}
    for r in rows:
        n, size, crc = want[r["payload_sha256"]]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (n, size, crc)
        assert seen.setdefault(r["payload_sha256"], (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"])
    clips = media.clips(media.store(awkward(spark), keep=["doc_id"]), keep=["doc_id"]).collect()
    assert {r["doc_id"] for r in clips} == {r[0] for r in ROWS}
    assert media.store(empty(spark), keep=["doc_id"]).count() == 0


# --- URLs

def test_url_rules(spark):
    urls = [
        (1, "https://WWW.Example.com/en/7198#top", "www.example.com", "/en/7198", "example.com/en/7", "allow"), (2, "http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        (3, "http://a.example.net/de/8?x", "a.example.net", "/de/8", "example.net/de/8", "block"), (4, "http://xexample.net/de/8", "xexample.net", "/de/8", "net/de/", "allow"),
        (5, "http://b.org/es/?q=/en/", "b.org", "/es/", "org/es/", "block"), (6, "http://b.org?/es/", "b.org", "", None, None), (7, "no scheme/en/", "", "", None, None), (8, None, "", "", None, None),
        (9, "x://com/en/#y", "com", "/en/", "com/en/", "block"), (10, "a://b://c/d", "b:", "//c/d", None, None), (None, "http://É.com/en/é", "É.com", "/en/é", "com/en/", "block"), (11, "", "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u, *_ in urls], "page_id bigint, url string, host string")
    found = {r["id"]: r for r in urlfilter.ruled(pages, queries.URL_RULES).collect()}
    for i, _, host, path, rule, verdict in urls:
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), i
        assert r["allowed"] == {"allow": True, "block": False, None: None}[verdict]


def _likelihood(urls, url, order=5):
    """By the definition: a context's distribution over what followed it, blended with that of the context one shorter."""
    def chance(context, c):
        shorter = chance(context[1:], c) if context else 1 / 257
        after = [u[i] if i < len(u) else 256 for u in urls for i in range(len(context), len(u) + 1) if u[i - len(context) : i] == context]
        return (after.count(c) + len(set(after)) * shorter) / (len(after) + len(set(after))) if after else shorter

    return sum(np.log(chance(url[max(0, i - order) : i], url[i] if i < len(url) else 256)) for i in range(len(url) + 1))


def test_url_verdicts_against_brute_force(spark):
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefé"), rng.integers(2, 6)))
    rows = [(i, f"http://{word()}.{('net/de', 'org/es')[i % 2]}/{word()}") for i in range(60)] + [(100 + i, f"http://{word()}.{('xyz/de', 'xyz/es')[i % 2]}/{word()}") for i in range(14)] + [(200, None), (201, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    ruled = urlfilter.ruled(pages, queries.URL_RULES)
    model = urlfilter.train(ruled)
    key = F.xxhash64("id", F.col("url").cast("binary"), F.lit(77))
    held = {r["id"]: r["h"] for r in ruled.select("id", (F.pmod(F.xxhash64(key, F.lit(9)), F.lit(4)) == 0).alias("h")).collect()}
    own = [[u.encode() for i, u in rows[:60] if i % 2 == k and not held[i]] for k in (0, 1)]
    raw = {i: (_likelihood(own[0], (u or "").encode()) - _likelihood(own[1], (u or "").encode())) / (len((u or "").encode()) + 1) for i, u in rows}
    allowed, blocked = ([raw[i] for i, _ in rows[:60] if i % 2 == k and held[i]] for k in (0, 1))
    wrong = lambda t: sum(x < t for x in allowed) / len(allowed) + sum(x >= t for x in blocked) / len(blocked)
    assert wrong(model.threshold) <= min(wrong(t) for t in np.linspace(min(raw.values()) - 1, max(raw.values()) + 1, 400)) + 1e-9
    for r in urlfilter.judge(ruled, model).collect():
        assert abs(r["score"] - (raw[r["id"]] - model.threshold)) < 1e-9
        assert r["verdict"] == (("allow", "block")[r["id"] % 2] if r["id"] < 60 else "allow" if r["score"] >= 0 else "block")


def test_malformed_text_is_read_with_replacements(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("the quick brown fox "), F.unhex(F.lit("C3")).cast("string"), F.lit(" jumps over")).alias("text"), F.lit("en").alias("lang"))
    model = langid.train(docs, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"en"}
    counted = tokencount.count_tokens(docs, public_tokenizers.path(queries.COUNT_TOKENIZER), keep=["doc_id"])
    fixed = tokencount.count_tokens(docs.withColumn("text", F.lit("the quick brown fox \ufffd jumps over")), public_tokenizers.path(queries.COUNT_TOKENIZER), keep=["doc_id"])
    assert [tuple(r) for r in counted.collect()] == [tuple(r) for r in fixed.collect()]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/"), F.col("text")).alias("url"))
    ruled = urlfilter.ruled(pages, queries.URL_RULES)
    assert urlfilter.judge(ruled, urlfilter.train(ruled)).select("verdict").count() == 3


def test_url_model_and_awkward(spark, tmp_path):
    rows = [(i, f"http://good.net/de/{i}" if i % 2 else f"http://bad.org/es/{i}?spam=win") for i in range(400)] + [(1000, "http://other.xyz/free?spam=win"), (1001, "http://good.xyz/de/5"), (None, None), (1002, ""), (1002, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    sf = table(tmp_path, spark, pages=pages)
    found = queries.op10_url_filter(spark, sf).collect()
    by = {r["page_id"]: r for r in found}
    assert len(found) == len(rows) and by[1000]["verdict"] == "block" and by[1001]["verdict"] == "allow"
    assert all(r["verdict"] == ("allow" if r["page_id"] % 2 else "block") for r in found if r["page_id"] is not None and r["page_id"] < 400)
    none = urlfilter.ruled(pages.limit(0), queries.URL_RULES)
    assert urlfilter.judge(none, urlfilter.train(none)).count() == 0
    model = urlfilter.Markov(3).train([b"abab"])
    assert abs(sum(model.chance(b"ab", c) for c in range(257)) - 1) < 1e-9 and model.chance(b"a", ord("b")) > model.chance(b"a", ord("z"))
