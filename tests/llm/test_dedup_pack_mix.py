import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import common, components, exact, mixing, packing, queries, simhash
from kinweave.llm.running import running_total
from tests.llm.helpers import ROWS, awkward, empty, table

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# --- exact

def _groups(rows):
    out = {}
    for i, t, *_ in rows:
        out.setdefault((t or "").translate(A_Z), []).append(i)
    return out


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 1))], ids=["sha256", "colliding"])
def test_exact_against_brute_force(spark, keep, digest):
    docs = awkward(spark)
    want = []
    for ids in _groups(ROWS).values():
        known = [i for i in ids if i is not None]
        best = {"min": min, "max": max}[keep](known) if known else None
        want += [(i, best, len(ids)) for i in ids]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r["id"], r["keep_id"], r["group_size"]) for r in exact.judge(docs, keep=keep, digest=digest).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    left = exact.survivors(docs, keep=keep, digest=digest)
    assert left.columns == docs.columns
    stay = sorted(((r["doc_id"], r["row"]) for r in left.collect()), key=key)
    assert stay == sorted(((b, "clash") for b in ({"min": min, "max": max}[keep]([i for i in ids if i is not None]) if any(i is not None for i in ids) else None for ids in _groups(ROWS).values())), key=key)


def test_exact_empty_and_log(spark, monkeypatch):
    assert exact.judge(empty(spark)).count() == 0 and exact.survivors(empty(spark)).count() == 0
    for bits in (exact.MOST_BITS, 0):  # with filters and, as with very many entries, without
        monkeypatch.setattr(exact, "MOST_BITS", bits)
        log = exact.DigestLog(spark, "min")
        rows = lambda *x: spark.createDataFrame([(bytearray(d), i) for d, i in x], "digest binary, id bigint")
        log.flush(rows((b"a", 5), (b"b", 3), (b"a", 5)))
        log.flush(rows((b"a", 2), (b"c", 9), (b"d", None), (b"d", 7), (b"e", 1), (b"e", 1)))
        assert sorted((bytes(r["digest"]), r["id"], r["rows"]) for r in log.compact().collect()) == [(b"a", 2, 3), (b"b", 3, 1), (b"c", 9, 1), (b"d", 7, 2), (b"e", 1, 2)]
    few = log.suspects(1 << 16)
    assert few.count() == 3  # a in two runs, d and e twice in one or in two


def test_exact_keeps_one_row_of_each_group(spark, monkeypatch):
    for bits in (exact.MOST_BITS, 0):
        monkeypatch.setattr(exact, "MOST_BITS", bits)
        for keep in ("min", "max"):
            kept = exact.judge(awkward(spark), keep=keep).filter("kept").collect()
            assert len(kept) == len(_groups(ROWS)) == exact.survivors(awkward(spark), keep=keep).count()


# --- simhash

def _fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if count[b] * 2 > len(shingles))


def _components(ids, prints, limit):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, f), (j, g) in itertools.combinations(zip(ids, prints, strict=True), 2):
        if bin(f ^ g).count("1") <= limit and find(i) != find(j):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op6_simhash_near_dedup(spark, SF).collect()}
    prints = {r["doc_id"]: _fingerprint(r["text"]) for r in docs}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    ids = sorted(prints)
    assert {i: r["component_id"] for i, r in got.items()} == _components(ids, [prints[i] for i in ids], 3)


def _near(rng, n, spread):
    base = rng.integers(0, 1 << 63, max(1, n // spread), dtype=np.uint64)
    f = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        f = f ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(f)


@pytest.mark.parametrize("spread", [2, 40, 400])
def test_gray_index_finds_every_link(spread):
    f = _near(np.random.default_rng(spread), 1200, spread)
    order, a, b = simhash.spanning(np.zeros(len(f), np.int64), f[:, None], 3)
    label = simhash._join(np.arange(len(f)), order[a], order[b])
    want = _components(list(range(len(f))), [int(x) for x in f], 3)
    assert label.tolist() == [want[i] for i in range(len(f))]
    wide = np.stack([f, f[::-1]], 1)
    index = simhash.GrayIndex(wide[np.lexsort(simhash.gray_rank(wide).T[::-1])], np.zeros(len(f), np.int64))
    x, y = index.links(np.arange(len(f)), 9)
    g = index.f
    brute = {(i, j) for i in range(len(g)) for j in (np.flatnonzero(np.bitwise_count(g[i + 1 :] ^ g[i]).sum(1) <= 9) + i + 1).tolist()}
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == brute


def test_gray_rank_orders_as_gray_code():
    codes = np.array([i ^ (i >> 1) for i in range(256)], np.uint64)[:, None] << np.uint64(56)
    assert np.array_equal(np.argsort(simhash.gray_rank(codes)[:, 0], kind="stable"), np.arange(256))


@pytest.mark.parametrize(("most", "blocks"), [(1 << 16, 0), (8, 0), (8, 6)])
def test_simhash_links_with_hot_keys_split(spark, most, blocks):
    f = _near(np.random.default_rng(9), 600, 200)
    ids = np.arange(len(f)) * 3 + 5
    nodes = spark.createDataFrame([(int(i), int(x)) for i, x in zip(ids, f.view(np.int64), strict=True)], "id bigint, f0 bigint")
    links = simhash.links(nodes, 3, simhash.block_masks(3, blocks), most=most, share=1)
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    want = _components([int(i) for i in ids], [int(x) for x in f], 3)
    assert {i: found.get(i, i) for i in want} == want


def test_simhash_awkward(spark, tmp_path):
    rows = simhash.groups(awkward(spark)).collect()
    assert len(rows) == len(ROWS)
    by = {r["id"]: r for r in rows if r["id"] is not None}
    assert by[3]["f0"] == by[4]["f0"] == by[10]["f0"] == 0 and by[10]["component"] == 3 and by[11]["component"] == 1
    assert queries.op6_simhash_near_dedup(spark, table(tmp_path, spark, documents=empty(spark))).count() == 0


def test_simhash_links_rows_without_identifier(spark):
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in rng.integers(0, 1 << 30, 400)]
    rows = [(5, " ".join(words))] + [(None, " ".join(words[:-k] + [f"x{k}"] * k)) for k in (1, 2)] + [(None, "alone"), (None, "alone")]
    rows += [(i, " ".join(f"w{k}" for k in rng.integers(0, 1 << 30, 30))) for i in range(20, 60)]
    # chains through rows without identifier: the only bridge between two documents has none
    a, b = words[:200], [*words[:197], "p", "q", "r"]
    bits = lambda t: int(_fingerprint(" ".join(t)), 16) if isinstance(_fingerprint(" ".join(t)), str) else int(_fingerprint(" ".join(t)))
    rows += [(9, " ".join(a)), (None, " ".join(b))]
    prints = [bits((t or "").split()) for _, t in rows]
    left, want = list(range(len(rows))), list(range(len(rows)))
    for i in left:
        for j in left:
            if (prints[i] ^ prints[j]).bit_count() <= 3 and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    lowest = {w: min((rows[i][0] for i in left if want[i] == w and rows[i][0] is not None), default=None) for w in set(want)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["id"], r["component"]) for r in simhash.groups(docs).collect()), key=str)
    assert got == sorted(((rows[i][0], lowest[want[i]]) for i in left), key=str)
    assert lowest[want[1]] == 5 and lowest[want[-3 - 40]] is None


def test_masks_follow_the_number_of_nodes():
    assert simhash.blocks_for(10**6, 3) == 4 and simhash.blocks_for(10**8, 3) == 5 and simhash.blocks_for(10**11, 3) == 6
    for n in (10, 10**5, 10**7):
        masks = simhash.masks_for(n, 4, 0.8)
        bits = sum(m.bit_count() for m in masks[0])
        assert n / 2**bits <= 64 and 1 - (1 - (1 - simhash.differing(0.8)) ** bits) ** len(masks) >= 0.998


@pytest.mark.parametrize("room", [50, 1 << 21])
def test_similar_against_brute_force(room):
    rng = np.random.default_rng(22)
    sets, key = [], np.sort(rng.integers(0, 6, 150))
    pools = [rng.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(4)]
    for _ in key:
        pool = pools[int(rng.integers(4))]
        sets.append(np.unique(np.concatenate((rng.choice(pool, int(rng.integers(0, 38)), replace=False), pool[:3] if rng.random() < 0.1 else pool[:0]))))
    sets[5] = sets[6] = np.zeros(0, np.uint64)
    for side in (np.ones(150, bool), rng.random(150) < 0.5):
        other = np.ones(150, bool) if side.all() else ~side
        label = list(range(150))
        for i in range(150):
            for j in range(150):
                if i != j and key[i] == key[j] and side[i] and other[j] and len(sets[i]) + len(sets[j]):
                    both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                    if both * 5 >= (len(sets[i]) + len(sets[j]) - both) * 4 and label[i] != label[j]:
                        old, new = max(label[i], label[j]), min(label[i], label[j])
                        label = [new if x == old else x for x in label]
        assert simhash.similar(sets, key, side, other, (4, 5), room).tolist() == label


@pytest.mark.parametrize("weight", [1 << 18, 900])
def test_verified_groups_in_blocks(spark, weight):
    rng = np.random.default_rng(23)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 80)]
    rows = []
    for i in range(90):  # copies with one to nine words changed: some are near, some are only near in a chain or not at all
        t = base.copy()
        for k in rng.choice(80, 1 + i % 9, replace=False):
            t[k] = f"x{rng.integers(1 << 40)}"
        rows.append((1000 - i, " ".join(t)))
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[:5])] + [(7, ""), (8, None), (3000, " ".join(base[:40]))]
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in rows}
    label = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {k: new if v == old else v for k, v in label.items()}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.verified_groups(docs, size=5, least=(4, 5), words=4, limit=66, weight=weight)
    assert {r["id"]: r["component"] for r in found.collect()} == label


def test_wide_fingerprints_estimate_similarity():
    rng = np.random.default_rng(4)
    words = [str(i) for i in range(5000)]
    limit, right, near = 64, 0, 0
    for _ in range(60):
        a = list(rng.choice(words, 300))
        b = a.copy()
        for k in rng.choice(300, int(rng.integers(1, 30)), replace=False):
            b[k] = "changed"
        s, t = ({tuple(x[i : i + 5]) for i in range(296)} for x in (a, b))
        j = len(s & t) / len(s | t)
        f = simhash.fingerprints([" ".join(a).encode(), " ".join(b).encode()], 5, 6)
        close = np.bitwise_count(f[0] ^ f[1]).sum() <= limit
        if j >= 0.87 or j <= 0.65:
            near += 1
            right += close == (j >= 0.87)
    assert right >= 0.95 * near


@pytest.mark.parametrize("seed", range(3))
def test_components_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(300, 340)] + [(400, 400 + k) for k in range(1, 30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {n: find(n) for p in pairs for n in p if p[0] != p[1]}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- mixing

def test_running_total(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[int(rng.integers(2))], int(o), int(rng.integers(10))) for o in rng.choice(10**9, 500, replace=False)] + [("a", None, 7)]
    got = {(r["k"], r["o"]): r["t"] for r in running_total(spark.createDataFrame(rows, "k string, o bigint, v bigint"), ["k"], "o", "v", "t").collect()}
    for k, o, _ in rows:
        assert got[k, o] == sum(v for kk, oo, v in rows if kk == k and oo != o and (oo is None or (o is not None and oo < o)))


@pytest.mark.parametrize("ids", ["hashed", "null", "equal"])
def test_running_total_deals_evenly(spark, ids):
    """No range holds much more than its share, whatever the identifiers are."""
    i = {"hashed": F.xxhash64("id"), "null": F.lit(None).cast("bigint"), "equal": F.lit(7).cast("bigint")}[ids]
    rows = spark.range(20000, numPartitions=4).select(F.lit("s").alias("k"), i.alias("o"), F.lit(1).cast("bigint").alias("v"))
    got = running_total(rows, ["k"], "o", "v", "t")
    assert [r["t"] for r in got.select("t").orderBy("t").collect()] == list(range(20000))
    plan = got._jdf.queryExecution().toString()
    assert "Window" in plan
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(8, "k", "o", "at").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] <= 2 * 20000 / 8


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 7, "b": 1, "c": 1, "d": 4}, {"a": 70000, "b": 30000}, {f"s{i}": 1 + i % 5 for i in range(23)}])
def test_cycle_deviates_less_than_one_block(spark, shares):
    table = spark.createDataFrame(list(shares.items()), "source string, share int")
    rows = mixing.cycle(table)[0].collect()
    simulated, small = mixing.cycle(table, 0)
    assert not small and sorted(map(tuple, simulated.collect())) == sorted(map(tuple, rows))
    shares = {r["source"]: r["share"] for r in rows}
    h = sum(shares.values())
    assert sorted(r["slot"] for r in rows) == list(range(h))
    for s, a in shares.items():
        slots = sorted(r["slot"] for r in rows if r["source"] == s)
        assert len(slots) == a and [r["nth"] for r in sorted(rows, key=lambda r: r["slot"]) if r["source"] == s] == list(range(a))
        for j, t in enumerate(slots):
            assert j * h // a <= t < -(-(j + 1) * h // a)
        for t in range(h + 1):
            assert abs(sum(x < t for x in slots) - t * a / h) < 1


def test_mix_awkward(spark, tmp_path):
    rows = mixing.mix(awkward(spark), {"a": 2}, block_chars=50).collect()
    assert len(rows) == len(ROWS) and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    for source in (None, "a", "b", "c"):
        mine = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["id"] is not None, r["id"] or 0, r["chars"]))
        before = 0
        for r in mine:
            assert r["block"] == before // 50
            before += r["chars"]
    assert queries.op2_mix_sources(spark, table(tmp_path, spark, documents=empty(spark))).count() == 0


# --- packing

def test_pack_query_against_the_tokenizer(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    _check_packing(docs, queries.op8_pack_sequences(spark, SF).toPandas())


def _check_packing(docs, found, most=0.1):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.PACK_TOKENIZER))
    for i, text in docs.items():
        raw = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        at = 0
        for r in found[found.doc_id == i].sort_values("start").itertuples():
            piece = raw[4 * r.start : 4 * (r.start + r.length)]
            assert r.start == at and zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens * 4 == len(raw)
            at += r.length
        assert at * 4 == len(raw)
    used = 0
    for _, g in found.groupby("sequence_id"):
        at = 0
        for r in g.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 4096
        used += at if at & (at - 1) == 0 else 4096
    assert 1 - found.length.sum() / used <= most


def test_pack_awkward(spark, tmp_path):
    docs = awkward(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    found = packing.pack(docs, public_tokenizers.path(queries.PACK_TOKENIZER)).toPandas().rename(columns={"id": "doc_id"})
    _check_packing({r["doc_id"]: r["text"] for r in docs.collect()}, found, 1)
    every = packing.pack(awkward(spark), public_tokenizers.path(queries.PACK_TOKENIZER), with_ids=True).collect()
    assert sum(r["start"] == 0 for r in every) == len(ROWS) and all(len(r["ids"]) == 4 * r["length"] for r in every)
    assert queries.op8_pack_sequences(spark, table(tmp_path, spark, documents=empty(spark))).count() == 0


def test_sequences_follow_the_order(spark):
    """Any prefix of the sequences holds about the first documents of the order, so it keeps a mix."""
    rng = np.random.default_rng(31)
    rows = [(i, " ".join(["word"] * int(16 * rng.integers(1, 9) ** 2 if i % 7 else rng.integers(4000, 9000)))) for i in range(4000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), public_tokenizers.path(queries.PACK_TOKENIZER)).toPandas()
    sequences = found.sequence_id.max() + 1
    assert sorted(found.sequence_id.unique()) == list(range(sequences)) and found.length.sum() >= 0.95 * sequences * 4096
    gap = (found.id / 4000 - found.sequence_id / sequences).abs()
    assert gap.mean() < 0.1 and gap.quantile(0.9) < 0.25  # 0.33 on the average without any order; bins of a few documents have coarse ranks


@pytest.mark.parametrize("text", ["", "Ab,c  d\x1ce\x85f\u00a0g\u2003h", "it's  <|endoftext|> x<|startoftext|>", "e\u0301 \u0301x İstanbul ΣΑΣ ΟΔΟΣ.", "日本語 12 345³", "a\x0bb\x0cc\rd", "\ufeff a"])
def test_chunk_tokenizer_is_exact(text):
    path = public_tokenizers.path(queries.PACK_TOKENIZER)
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.chunk_tokenizer(path).encode_batch([text.encode()])[0], "<u4").tolist() == want


def test_nnls_and_plan():
    rng = np.random.default_rng(6)
    for _ in range(5):
        a, x = rng.random((20, 40)), np.maximum(rng.normal(size=40), 0)
        got = packing.nnls(a, a @ x)
        assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6
    histogram = {int(s): int(n) for s, n in zip(rng.integers(1, 257, 120), rng.integers(1, 900, 120), strict=True)}
    plan = packing.plan(histogram, 256)
    used = {s: 0 for s in histogram}
    for pattern, m in zip(plan.patterns, plan.repeats, strict=True):
        assert sum(s * c for s, c in pattern) <= 256
        for s, c in pattern:
            used[s] += c * m
    assert used == histogram
    total = sum(s * n for s, n in histogram.items())
    assert plan.sequences * 256 < total * 1.1
    assert packing.plan({}, 256).sequences == 0


# --- pipeline

def _stages(spark, docs, tmp_path):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        yield name, docs


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name, out in _stages(spark, docs, tmp_path):
        kept[name] = [r["doc_id"] for r in out.collect()]
        if name == "exact_dedup":
            want = {max(i for i in ids if i in kept["language_id"]) for ids in _groups([(i, r["text"]) for i, r in rows.items() if i in kept["language_id"]]).values()}
            assert set(kept[name]) == want
        if name == "simhash_near_dedup":
            words = {i: rows[i]["text"].lower().split() for i in kept["exact_dedup"]}
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
            gone = set(kept["exact_dedup"]) - set(kept[name])
            for i in gone:  # each has a neighbour that is at least rather similar
                assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in sets if j != i) > 0.5
            left = kept[name]
            assert sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.88 for i, j in itertools.combinations(left, 2)) <= 1
    assert len(kept["language_id"]) >= 0.98 * len(rows)
    assert sorted(kept["mix_sources"]) == sorted(kept["simhash_near_dedup"])
    place = {r["id"]: r["slot"] for r in mixing.mix(docs.filter(F.col("doc_id").isin(kept["mix_sources"])), queries.SHARES, default=1, block_chars=queries.BLOCK_CHARS).collect()}
    written = spark.read.parquet(f"{tmp_path}/mix_sources").select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    slots = [place[r["doc_id"]] for r in written]
    assert slots == sorted(slots)
    _check_packing({i: rows[i]["text"] for i in kept["mix_sources"]}, spark.read.parquet(f"{tmp_path}/pack").toPandas())
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_awkward(spark, tmp_path):
    for name, out in _stages(spark, awkward(spark), tmp_path):
        n = out.count()
        if name == "language_id":
            assert n == 9  # null, empty, letterless and white-space texts go
        if name == "exact_dedup":
            assert {r["doc_id"] for r in out.collect()} == {5, 6, 8, 9, 11, None} and n == 6
    assert n


def test_pipeline_empty(spark, tmp_path):
    for _, out in _stages(spark, empty(spark), tmp_path):
        assert out.count() == 0


def test_pipeline_near_dedup_decides_by_exact_similarity(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, want = [], set()
    for k in range(60):  # the last words replaced: n shingles, m of them shared, 4 / 5 at m = n * 8 / 9
        n, above = 90 + 9 * (k % 7), k % 2 == 0
        m = n * 8 // 9 if above else n * 8 // 9 - 2
        base = word(n + 4)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: m + 4] + word(n - m)))]
        want |= {2 * k + 1} if above else set()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()}
    assert {i for i, _ in rows} - left == want


def test_pipeline_near_dedup_links_chains_and_sets(spark):
    import corpus_pipeline

    words = [f"v{i}" for i in range(200)]
    line = "one line of seven words that repeats "
    rows = [(5, " ".join(words)), (3, " ".join(words[12:] + [f"x{i}" for i in range(12)])), (9, " ".join(words[24:] + [f"x{i}" for i in range(24)])), (4, line * 400 + " ".join(words[:40])), (2, line * 2 + " ".join(words[:40])), (None, " ".join(words)), (7, line * 400 + " ".join(f"y{i}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted((r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()), key=str)
    assert left == [2, 3, 7]  # the text without an identifier is a copy of one that has one
    alone = [f"z{i}" for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, " ".join(alone)), (None, " ".join(alone[:-1])), (None, " ".join(f"u{i}" for i in range(50)))], docs.schema)
    left = [r["text"][:2] for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).filter("doc_id IS NULL").collect()]
    assert sorted(left) == ["u0", "z0"]


class _Cluster:
    """Enough of a session on a cluster without a checkpoint folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

        class _jsc:
            @staticmethod
            def sc():
                class Held:
                    getCheckpointDir = staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))

                return Held

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(_Cluster)
