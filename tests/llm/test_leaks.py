import random
from collections import Counter

import numpy as np

from quillon.llm.leaks import as_read, leaked_passages, simhashes, weighted_similarity
from quillon.llm.words import Hashes, hashed, mix

W = [f"word{k}" for k in range(300)]


def test_as_read():
    assert as_read("ＦＵＬＬ  wi​dth, **mar­ked** _up_\n> Ünïcode é") == ["full", "width", "marked", "up", "ünïcode", "é"]
    assert as_read(None) == [] and as_read("") == [] and as_read("— !") == []


def test_against_all_passages(spark):
    rng = random.Random(3)
    text = lambda n: [rng.choice(W) for _ in range(n)]
    items = [(k, text(rng.randrange(8, 60))) for k in range(30)]
    items.append((30, items[3][1][:20] + text(9)))  # shares a passage
    docs = []
    for k in range(60):
        d = text(rng.randrange(0, 200))
        if k % 3 == 0:
            w = rng.choice(items)[1]
            at, n = rng.randrange(0, max(1, len(w) - 11)), rng.randrange(9, 25)
            p = rng.randrange(len(d) + 1)
            d[p:p] = w[at : at + n]
        docs.append((k, d))
    want = set()
    for d, dw in docs:
        windows = {tuple(dw[k : k + 12]) for k in range(len(dw) - 11)}
        for i, iw in items:
            if windows & {tuple(iw[k : k + 12]) for k in range(len(iw) - 11)}:
                want.add((d, i))
    ddf = spark.createDataFrame([(d, " ".join(w).title().replace(" ", ",\n> ")) for d, w in docs], "doc_id long, text string")
    idf = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for block in (400_000, 150):  # also in several passes
        got = leaked_passages(ddf, "doc_id", "text", idf, "item_id", "text", block=block)
        assert {(r.doc, r.item) for r in got.collect()} == want and want


def test_dirty_rows(spark):
    p = " ".join(W[:12])
    docs = spark.createDataFrame([(1, p, 9), (1, p, 9), (2, None, 9), (3, "", 9), (None, p, 9), (4, " ".join(W * 200), None)], "doc long, text string, item int")
    items = spark.createDataFrame([(7, p, 1), (7, p, 1), (8, None, 1), (None, p, 1), (9, "short", None)], "item long, text string, doc int")
    got = leaked_passages(docs, "doc", "text", items, "item", "text")
    assert sorted((r.doc, r["item"], r.n_passages) for r in got.collect()) == [(1, 7, 2), (4, 7, 200)] or sorted((r.doc, r["item"]) for r in got.collect()) == [(1, 7), (4, 7)]
    assert leaked_passages(docs.limit(0), "doc", "text", items, "item", "text").count() == 0
    assert leaked_passages(docs, "doc", "text", items.limit(0), "item", "text").count() == 0


def test_near_passages(spark):
    a, b = " ".join(W[:12]), " ".join([W[1], W[0], *W[2:12]])
    df = lambda t: spark.createDataFrame([(1, t)], "id long, text string")
    assert leaked_passages(df(b), "id", "text", df(a), "id", "text").count() == 0
    assert leaked_passages(df(b), "id", "text", df(a), "id", "text", similarity=0.8).count() == 0  # 6 of 10 shingles
    assert leaked_passages(df(b), "id", "text", df(a), "id", "text", similarity=0.6).count() == 1
    assert leaked_passages(df(b), "id", "text", df(a), "id", "text", similarity=0.8, shingle=1).count() == 1


def test_simhash_is_that_of_each_window():
    h = mix(hashed([W[k % 40] for k in range(100)], Hashes()))
    whole = simhashes(h, 12)
    assert len(whole) == 89 and all(simhashes(h[k : k + 12], 12)[0] == whole[k] for k in range(89))
    assert len(simhashes(h[:5], 12)) == 0
    one = lambda *x: np.array([x])
    assert weighted_similarity(h[None, :3], h[None, :3]) == [1.0] and weighted_similarity(one(1, 1, 2), one(1, 2, 2)) == [0.5]
    assert weighted_similarity(np.empty((0, 3)), np.empty((0, 3))).shape == (0,)


def test_weighted_similarity_against_counts():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 5, (200, 8)), rng.integers(0, 5, (200, 8))
    for x, y, got in zip(a, b, weighted_similarity(a, b)):
        c, d = Counter(x.tolist()), Counter(y.tolist())
        assert got == (c & d).total() / (c | d).total()


def test_same_shingles_in_another_order(spark):
    """Words that repeat, so that two orders have the same runs: only the exact passage counts."""
    a, b = "x a x b x a x b x a x b", "x b x a x b x a x b x a"
    df = lambda t: spark.createDataFrame([(1, t)], "id long, text string")
    for width in (1, 2):
        assert leaked_passages(df(b), "id", "text", df(a), "id", "text", shingle=width).count() == 0
    assert leaked_passages(df(f"{a} x"), "id", "text", df(a), "id", "text").count() == 1
