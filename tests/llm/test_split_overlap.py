import json
import random

import numpy as np

from quillon.llm.split_overlap import SplitOverlap, parity, shared_runs, spans, test_text, tests_of
from quillon.llm.words import words

test_text.__test__ = tests_of.__test__ = False
W = [f"t{k}" for k in range(500)]


def rows(seed=5):
    rng = random.Random(seed)
    out = []
    for k in range(60):
        base = [rng.choice(W) for _ in range(rng.choice([4, 5, 8, 14, 20, 30, 60, 110]))]
        tests = [(str(rng.randrange(10**6)), str(rng.randrange(9))) for _ in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(1, 4)):
            w, t = list(base), list(tests)
            for _ in range(rng.randrange(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = rng.choice(W)
            if rng.random() < 0.3:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            if rng.random() < 0.5:
                t.pop()
            rng.shuffle(t)
            doc = json.dumps({"inputs": [a + "\r\n " if rng.random() < 0.5 else [a, ""] for a, _ in t], "outputs": [b for _, b in t]})
            out.append((len(out), " ".join(w), doc, rng.random() < 0.6))
    return out


def by_pairs(data):
    tri = {i: frozenset(zip(w, w[1:], w[2:])) for i, t, _, _ in data for w in [words(t)]}
    tests = {i: {int(x) for x in tests_of(d)} for i, _, d, _ in data}
    want = set()
    for i, *_, a in data:
        for j, *_, b in data:
            if a and not b:
                near = tri[i] | tri[j] and len(tri[i] & tri[j]) >= 0.7 * len(tri[i] | tri[j])
                same = min(len(tests[i]), len(tests[j])) >= 3 and len(tests[i] & tests[j]) >= 0.8 * len(tests[i] | tests[j])
                if near or same:
                    want.add((min(i, j), max(i, j)))
    return want


def test_against_all_pairs(spark):
    data = rows()
    o = SplitOverlap(spark.createDataFrame(data, "id long, text string, tests string, trained boolean"), "id", "text", "tests", "trained", width=3, text_threshold=0.7)
    want = by_pairs(data)
    assert {tuple(r) for r in o.pairs().collect()} == want and len(want) > 10
    held = {i for i, *_, t in data if not t}
    assert {r.id for r in o.overlapping().collect()} == {i for p in want for i in p if i in held}


def test_dirty_rows(spark):
    t = " ".join(W[:12])
    doc = json.dumps({"inputs": ["1", "2", "3"], "outputs": ["a", "b", "c"], "note": 1})
    data = [(1, t, None, True), (1, t, None, True), (2, t, "{broken", False), (3, None, doc, True), (4, "", doc, False), (5, t, doc, None), (None, t, doc, False), (6, "a b", "[]", False), (7, " ".join(W * 40), None, True)]
    df = spark.createDataFrame([(*r, 0) for r in data], "id long, text string, tests string, trained boolean, node int")
    o = SplitOverlap(df, "id", "text", "tests", "trained")
    assert sorted(tuple(r) for r in o.pairs().collect()) == [(1, 2), (3, 4)]
    assert SplitOverlap(df.limit(0), "id", "text", "tests", "trained").pairs().count() == 0


def test_reordered_items_of_a_frame(spark):
    """Similar at 0.95 without a common run of 9 words; and equal sets of runs in two orders."""
    rng = random.Random(3)
    items = [f"add {w} to list" for w in W[:14]]
    other = rng.sample(items, len(items))
    data = [(1, " ".join(items), None, True), (2, " ".join(other), None, False), (3, "go on go on go on", None, True), (4, "on go on go on go on", None, False), (5, " ".join(f"add {w} to list" for w in W[20:34]), None, True)]
    seqs = [words(d[1]) for d in data[:2]]
    runs = [{tuple(w[k : k + 9]) for k in range(len(w) - 8)} for w in seqs]
    assert not runs[0] & runs[1]
    o = SplitOverlap(spark.createDataFrame(data, "id long, text string, tests string, trained boolean"), "id", "text", "tests", "trained", width=3, text_threshold=0.7)
    assert {tuple(r) for r in o.pairs().collect()} == by_pairs(data) == {(1, 2), (3, 4)}


def test_against_all_pairs_of_reordered_frames(spark):
    rng = random.Random(11)
    data = []
    for _ in range(30):
        frame = rng.choice(["add {} to list", "is {} in the set", "{} then", "print {} and stop now please"])
        items = [frame.format(rng.choice(W[:40])) for _ in range(rng.choice([3, 6, 12, 30]))]
        for _ in range(3):
            some = rng.sample(items, len(items) - rng.randrange(2))
            data.append((len(data), " ".join(some), None, rng.random() < 0.5))
    for t in (0.5, 0.7):
        o = SplitOverlap(spark.createDataFrame(data, "id long, text string, tests string, trained boolean"), "id", "text", "tests", "trained", width=3, text_threshold=t)
        tri = {i: set(zip(w, w[1:], w[2:])) for i, x, *_ in data for w in [words(x)]}
        want = {(min(i, j), max(i, j)) for i, *_, a in data for j, *_, b in data if a and not b and len(tri[i] & tri[j]) >= t * len(tri[i] | tri[j])}
        assert {tuple(r) for r in o.pairs().collect()} == want and len(want) > 20


def test_tests_are_compared_by_their_lines():
    a = tests_of(json.dumps({"inputs": ["1 2\r\n3 \n", ["x", "y"]], "outputs": ["\n7", "z "]}))
    b = tests_of(json.dumps({"outputs": [["7"], "z"], "inputs": ["1 2\n3", " x\ny\n\n"], "more": None}))
    assert len(a) == 2 and (a == b).all()
    for bad in (None, "", "{", "[1]", '{"inputs": 3, "outputs": 4}', '{"inputs": []}'):
        assert len(tests_of(bad)) == 0
    assert test_text([" a ", None, "b"]) == "a\n\nb"


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: rng.integers(0, 60)], rng.integers(0, 2**63, 20, dtype=np.uint64)]))
        differing = sum(int(v).bit_count() for v in (parity(x) ^ parity(y)).view(np.uint64))
        assert differing <= len(np.setxor1d(x, y))


def test_spans():
    x = np.arange(1, 30, dtype=np.uint64)
    assert spans(x, x[:10], 5) == [(0, 10)] and spans(x, np.arange(100, 120, dtype=np.uint64), 5) == []
    assert spans(x, np.concatenate([x[:6], x[20:22]]), 5) == [(0, 6)]
    assert spans(x, x[:3], 5) == [] and spans(x[:3], x[:3], 5) == [(0, 3)]


def test_coverage_is_merged_over_partners(spark):
    """Neither training row covers the held-out one alone."""
    w = W[:60]
    data = [(1, " ".join(w[:50] + W[100:110]), None, True), (2, " ".join(W[120:130] + w[10:]), None, True), (3, " ".join(w), None, False)]
    df = spark.createDataFrame(data, "id long, text string, tests string, trained boolean")
    o = SplitOverlap(df, "id", "text", "tests", "trained", width=3, text_threshold=0.7)
    assert [(r.id, r.by_text, r.by_tests, r.coverage) for r in o.overlapping().collect()] == [(3, True, False, 1.0)]
    alone = SplitOverlap(df.where("id <> 2"), "id", "text", "tests", "trained", width=3, text_threshold=0.7)
    assert [r.coverage for r in alone.overlapping().collect()] == [50 / 60]


def test_runs_across_ranges(spark):
    """A run longer than a range, with one suffix of the other split at its end; runs of one split only."""
    rows = [(7, 1, 1)] * 3000 + [(7, 2, 2)] + [(8, 1, 1)] * 50 + [(9, 9, 3)] + [(10, k, 1 + k % 2) for k in range(9)]
    df = spark.createDataFrame(rows, "key long, tail long, side byte")
    assert sorted(r.key for r in shared_runs(df).collect()) == [7, 9, 10]
    assert shared_runs(df.limit(0)).count() == 0


def test_a_frame_shared_by_all_rows(spark):
    rng = random.Random(2)
    frame = "write a program that reads one line and prints the answer for"
    data = [(k, f"{frame} {rng.choice(W)} {rng.choice(W)}", None, k % 3 > 0) for k in range(400)]
    o = SplitOverlap(spark.createDataFrame(data, "id long, text string, tests string, trained boolean"), "id", "text", "tests", "trained", width=3, text_threshold=0.7)
    assert {tuple(r) for r in o.pairs().collect()} == by_pairs(data)
