import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.near_duplicates import group_pairs, near_duplicate_groups, segments_for
from quillon.llm.words import Hashes, hashed, jaccard, shingles, words

VOCABULARY = [f"w{k}" for k in range(400)]


def edited(text: str, rng: random.Random, n: int) -> str:
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(2)] = [rng.choice(VOCABULARY)]
    return " ".join(w)


def texts(seed: int = 1) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        base = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(35, 90)))
        out += [base] + [edited(base, rng, rng.randrange(0, 9)) for _ in range(rng.randrange(0, 5))]
    rng.shuffle(out)
    return [(k * 3, t) for k, t in enumerate(out)]


def by_pairs(rows, width, threshold, least):
    """Groups by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words(t)
        if len(w) >= max(least, width):
            sets[i] = frozenset(zip(*(w[k:] for k in range(width))))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in sets:
        groups[root(i)].append(i)
    return {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}, set(sets)


def test_against_all_pairs(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "message_id long, content string")
    got = near_duplicate_groups(df, "message_id", "content", width=3, threshold=0.7, least_words=30)
    want, there = by_pairs(rows, 3, 0.7, 30)
    assert {tuple(r) for r in group_pairs(got).collect()} == want and len(want) > 20
    assert {r.id for r in got.collect()} == there


def test_dirty_rows(spark):
    long = " ".join(VOCABULARY * 60)
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "A, b; C d e f g!", None), (3, None, "x"), (4, "", "x"), (None, "a b c d e f g", "x"), (5, long, "y"), (6, long + " end", "y"), (7, "too short", "z")]
    df = spark.createDataFrame(rows, "id long, text string, key string").withColumnsRenamed({"key": "group_id"})
    got = {r.id: (r.class_id, r.group_id) for r in near_duplicate_groups(df, "id", "text").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 5: (5, 5), 6: (6, 5)}
    assert near_duplicate_groups(df.limit(0), "id", "text").count() == 0


def test_hot_group(spark):
    """A third of all rows are edits of one text and another third its copies: every row is in one group."""
    rng = random.Random(4)
    base = " ".join(rng.choice(VOCABULARY) for _ in range(80))
    rows = [(k, edited(base, rng, 1)) for k in range(60)] + [(k, base) for k in range(60, 120)] + [(k, " ".join(rng.choice(VOCABULARY) for _ in range(60))) for k in range(120, 180)]
    got = near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text", width=3, threshold=0.7)
    groups = defaultdict(set)
    for r in got.collect():
        groups[r.group_id].add(r.id)
    assert max(groups.values(), key=len) == set(range(120)) and len(groups) == 61


def chain(n: int, step: int, rng: random.Random) -> list[str]:
    """Texts each of which is close to its neighbours only: many components in the same buckets until all are linked."""
    w = [rng.choice(VOCABULARY) for _ in range(60 + n * step)]
    return [" ".join(w[k * step : k * step + 60]) for k in range(n)]


@pytest.mark.parametrize("crowd", [0, 4, 256])
def test_crowded_buckets(spark, crowd):
    rng = random.Random(9)
    frame = [rng.choice(VOCABULARY) for _ in range(25)]
    rows = chain(30, 5, rng) + [" ".join(frame + rng.sample(VOCABULARY, 14)) for _ in range(60)] + [edited(" ".join(frame + VOCABULARY[:12]), rng, 2) for _ in range(40)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text", width=3, threshold=0.7, miss=1e-6, crowd=crowd)
    want, _ = by_pairs(rows, 3, 0.7, 1)
    assert {tuple(r) for r in group_pairs(got).collect()} == want and len(want) > 400


def test_exact_finds_what_the_tables_miss(spark):
    """With tables that miss nearly everything, the exact way still finds every group."""
    rows = texts(5)
    df = spark.createDataFrame(rows, "id long, text string")
    want, _ = by_pairs(rows, 3, 0.7, 1)
    loose, exact = (group_pairs(near_duplicate_groups(df, "id", "text", width=3, threshold=0.7, miss=0.99, exact=e)) for e in (False, True))
    assert {tuple(r) for r in loose.collect()} < want and {tuple(r) for r in exact.collect()} == want


def test_segments():
    assert segments_for(1.0, 1e-3) == 1
    for t in (0.5, 0.7, 0.8, 0.9):
        n = segments_for(t, 1e-3)
        hit = t**5 + 5 * t**4 * (1 - t)
        assert (1 - hit) ** n <= 1e-3 < (1 - hit) ** (n - 1)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
def test_jaccard_is_that_of_the_sets(a, b):
    of = lambda w: np.unique(shingles(hashed(w, Hashes()), 3))
    x, y = set(zip(a, a[1:], a[2:])), set(zip(b, b[1:], b[2:]))
    assert jaccard(of(a), of(b)) == pytest.approx(len(x & y) / len(x | y) if x | y else 0)
