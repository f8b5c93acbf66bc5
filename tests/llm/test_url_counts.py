"""The URL models count every labelled URL, whole, and the threshold is that of all held-back ones."""

import numpy as np
from pyspark.sql import functions as F

from kinweave.llm import queries, urlfilter


def _held():
    key = F.xxhash64("id", F.col("url").cast("binary"), F.lit(77))
    return F.pmod(F.xxhash64(key, F.lit(9)), F.lit(4)) == 0


def test_every_labelled_url_counts_whole(spark):
    """20,400 URLs a class and one of 20,003 bytes: beyond the 20,000 and the 16 KB that were once taken."""
    number = 20_400
    kind = F.when(F.col("id") < number, F.lit("a://x.net/de/")).otherwise(F.lit("a://x.org/es/"))
    pages = spark.range(2 * number).select(F.col("id").alias("page_id"), F.concat(kind, F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("url"))
    long = [(10**6 + i, "a://x.net/de/" + "qv" * 9_995) for i in range(8)]
    asked = [(2 * 10**6 + i, u) for i, u in enumerate(["a://x.xyz/qvqvqv", "a://y.net/fr/77", "b://x.org/es"])]
    pages = pages.unionByName(spark.createDataFrame(long + asked, "page_id bigint, url string"))
    ruled = urlfilter.ruled(pages, queries.URL_RULES)
    model = urlfilter.train(ruled)
    rows = ruled.filter("allowed IS NOT NULL").select("id", "url", "allowed", _held().alias("held")).collect()
    of = lambda allowed, held: [r["url"].encode() for r in rows if (r["allowed"], r["held"]) == (allowed, held)]
    assert any(len(u) > 1 << 14 for u in of(True, False))
    good, bad = (urlfilter.Markov().train(of(a, False)) for a in (True, False))
    raw = lambda u: (good.log_likelihood(u) - bad.log_likelihood(u)) / (len(u) + 1)
    found = {r["id"]: r for r in urlfilter.judge(ruled.filter(F.col("id") >= 2 * 10**6), model).collect()}
    for i, u in asked:
        assert abs(found[i]["score"] - (raw(u.encode()) - model.threshold)) < 1e-9
    a, b = (np.sort([raw(u) for u in of(allowed, True)]) for allowed in (True, False))
    wrong = lambda t: np.searchsorted(a, t) / len(a) + 1 - np.searchsorted(b, t) / len(b)
    edges = np.unique(np.r_[a, b, min(a[0], b[0]) - 1, max(a[-1], b[-1]) + 1])
    assert wrong(model.threshold) <= min(wrong(t) for t in (edges[1:] + edges[:-1]) / 2) + 1e-9


def test_counts_of_urls_in_pieces(spark):
    """Grams over the seams of pieces are counted once, at lengths about a piece's and in URLs without a byte; scores follow the definition."""
    rng = np.random.default_rng(3)
    size = urlfilter.PIECE
    urls = [bytes(rng.choice(list(b"ab\xc3\x00\xff"), n)) for n in (0, 1, 4, 5, 6, size - 1, size, size + 1, 2 * size - 1, 2 * size, 2 * size + 5, 3 * size + 2, (urlfilter.SHARED + 1) * size + 3)]
    rows = spark.createDataFrame([(bytearray(u), i % 2 == 0) for i, u in enumerate(urls)], "url binary, allowed boolean")
    for order in (0, 2, 5):
        counts = urlfilter.count(rows, order)
        sums = counts.agg(F.sum("a"), F.sum("b")).first()
        assert tuple(sums) == (sum(len(u) + 1 for u in urls[::2]), sum(len(u) + 1 for u in urls[1::2]))
        good, bad = urlfilter.Markov(order).train(urls[::2]), urlfilter.Markov(order).train(urls[1::2])
        asked = urls + [b"abc" * 700, b"zz"]
        held = spark.createDataFrame([(i, bytearray(u)) for i, u in enumerate(asked)], "row long, url binary")
        found = dict(urlfilter.ratios(held, urlfilter.Filter(counts, order=order)).collect())
        assert found.keys() == set(range(len(asked)))
        assert all(abs(found[i] - good.log_likelihood(u) + bad.log_likelihood(u)) < 1e-7 for i, u in enumerate(asked))


def test_threshold_keeps_equal_scores_together(spark):
    rng = np.random.default_rng(8)
    for _ in range(4):
        rows = [(float(s) / 4, bool(a)) for s, a in zip(rng.integers(-4, 5, 40), rng.integers(0, 2, 40))]
        good, bad = ([s for s, a in rows if a == k] for k in (True, False))
        wrong = lambda t: sum(s < t for s in good) / len(good) + sum(s >= t for s in bad) / len(bad)
        cut = urlfilter.best_cut(spark.createDataFrame(rows, "score double, allowed boolean"), len(good), len(bad))
        assert wrong(cut) <= min(wrong(t) for t in np.arange(-1.1, 1.4, 0.125)) + 1e-9
    near = [(1.0, False), (np.nextafter(1.0, 2), True)]
    assert urlfilter.best_cut(spark.createDataFrame([(float(s), a) for s, a in near], "score double, allowed boolean"), 1, 1) == near[1][0]
