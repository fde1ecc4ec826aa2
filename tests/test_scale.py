"""Operators that work in ranges, against brute force, with hot keys and many ranges."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.functions import recursions as R
from quillon.operators import losses as L
from quillon.operators import sampling as S
from quillon.streaming import windows as W


@pytest.fixture()
def many_ranges(monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 37)


def rows(n=600, keys=("hot",) * 8 + ("a", "b"), seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice(keys), rng.randrange(50), rng.random() if rng.random() < 0.9 else None) for k in range(n)]


def test_positions_and_first_rows(spark, many_ranges, monkeypatch):
    df = spark.createDataFrame(rows(), "id long, key string, t long, v double")
    got = {r.id: r.position for r in S.with_position(df, ["t", "id"]).collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((t, i) for i, _, t, _ in rows()))}
    few = {r.id for r in S.first_rows(df, ["t", "id"], 100).collect()}
    monkeypatch.setattr(S, "DRIVER_ROWS", 10)
    assert few == {r.id for r in S.first_rows(df, ["t", "id"], 100).collect()} and len(few) == 100
    assert S.with_position(df.limit(0), ["t"]).count() == 0


def test_places_and_running_sums_of_a_hot_key(spark, many_ranges):
    data = rows()
    df = spark.createDataFrame(data, "id long, key string, t long, v double")
    by = defaultdict(list)
    for i, k, t, v in sorted(data, key=lambda r: (r[2], r[0])):
        by[k].append((i, v))
    place = {i: n + 1 for g in by.values() for n, (i, _) in enumerate(g)}
    assert {r.id: r.place for r in S.ordered_within(df, "key", ["t", "id"]).collect()} == place
    mean = {}
    for g in by.values():
        seen = []
        for i, v in g:
            seen += [v] if v is not None else []
            mean[i] = sum(seen) / len(seen) if seen else None
    got = {r.id: r.running for r in W.running_mean(df, "key", ["t", "id"], "v").collect()}
    assert got.keys() == mean.keys() and all(got[i] == (None if m is None else pytest.approx(m)) for i, m in mean.items())


def test_sessions_of_a_hot_key(spark, many_ranges):
    data = [(i, k, t, v) for i, k, t, v in rows() if v is not None]
    df = spark.createDataFrame(data, "id long, key string, t long, v double")
    best, want = {}, {}
    for i, k, _, v in sorted(data, key=lambda r: (r[2], r[0])):
        want[i] = 0.0 if v > best.get(k, float("-inf")) else -0.05
        best[k] = max(v, best.get(k, v))
    assert {r.id: r.penalty for r in W.session_penalties(df, "key", ["t", "id"], "v").collect()} == want


def test_trailing_counts_of_a_hot_key(spark):
    rng = random.Random(3)
    data = [(k, rng.choice("aaab"), rng.randrange(0, 900_000_000)) for k in range(500)] + [(900, "a", 60_000_000), (901, "a", 0)]
    df = spark.createDataFrame(data, "id long, key string, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {r.id: r.n_trailing for r in W.trailing_counts(df, "key", "ts").collect()}
    assert got == {i: sum(k == kk and 0 <= u - uu < 60_000_000 for _, kk, uu in data) for i, k, u in data}


def test_missing_keys_times_and_values(spark, many_ranges):
    """A missing key is a key of its own, whose rows lie in several ranges."""
    data = [(k, None if k % 3 else "a", k, None if k % 7 == 0 else float(k % 5)) for k in range(200)]
    df = spark.createDataFrame(data, "id long, key string, t long, v double")
    seen = defaultdict(list)
    place, best, want = {}, {}, {}
    for i, k, _, v in data:
        seen[k].append(v)
        place[i] = len(seen[k])
        want[i] = 0.0 if v is not None and v > best.get(k, float("-inf")) else -0.05
        best[k] = max(best.get(k, float("-inf")), v if v is not None else float("-inf"))
    assert {r.id: r.place for r in S.ordered_within(df, "key", ["t"]).collect()} == place
    assert {r.id: r.penalty for r in W.session_penalties(df, "key", ["t"], "v").collect()} == want
    last = max(i for i, k, *_ in data if k is None)
    known = [v for _, k, _, v in data if k is None and v is not None]
    assert W.running_mean(df, "key", ["t"], "v").where(F.col("id") == last).first().running == pytest.approx(sum(known) / len(known))
    late = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, "a", 5), (3, None, 5)], "id int, key string, us long").withColumn("ts", F.timestamp_micros("us"))
    assert {r.id: r.n_trailing for r in W.trailing_counts(late, "key", "ts").collect()} == {0: 2, 1: 2, 2: 1, 3: 1}
    few = {r.id for r in S.top_rows(df, "key", [F.desc("v"), "id"], 2).collect()}
    assert len(few) == 4


def test_empty_tables(spark):
    df = spark.createDataFrame([], "row_id long, key string, t long, v double")
    assert S.resample(df, "row_id", "v").count() == 0 and W.running_mean(df, "key", ["t"], "v").count() == 0
    assert W.session_penalties(df, "key", ["t"], "v").count() == 0 and L.pairwise_accuracy(df, "key", "row_id", "v", "v").count() == 0
    assert S.ordered_within(df, "key", ["t"]).count() == 0 and L.best_of_n_weights(df, "key", "v").count() == 0


def test_draws_meet_their_rows(spark, many_ranges):
    n = 500
    df = spark.createDataFrame([(k, float(k % 5)) for k in range(n)], "row_id long, w double")
    edges, at = [], 0.0
    for k in range(n):
        edges.append(at)
        at += k % 5 + 1e-8
    import bisect
    import hashlib

    want = {k: bisect.bisect_right(edges, int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:12], 16) / 16**12 * at) - 1 for k in range(n)}
    got = {r.draw: r.row_id for r in S.resample(df, "row_id", "w").collect()}
    assert sum(got[k] != want[k] for k in want) <= 1 and len(got) == n  # sums differ in the last bit


def test_samplers(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    for drop, size in ((False, 4), (True, 3)):
        d = S.distributed_sampler(df, "k", 3, drop_last=drop).collect()
        assert sorted((r.rank, r.place) for r in d) == [(a, b) for a in range(3) for b in range(size)]
    assert [r.k for r in S.distributed_sampler(df, "k", 2, shuffle=False).where("rank = 1").orderBy("place").collect()] == [1, 3, 5, 7, 9]
    assert len(S.distributed_sampler(df.limit(2), "k", 5).collect()) == 5 and S.distributed_sampler(df.limit(0), "k", 3).count() == 0
    with pytest.raises(ValueError, match="divide"):
        S.batch_numbers(df, "k", 3, divide=True)
    assert [r.batch for r in S.batch_numbers(df, "k", 5, shuffle=False).orderBy("k").collect()] == [0] * 5 + [1] * 5


def test_pairwise_accuracy_against_all_pairs(spark):
    rng = random.Random(6)
    data = [(k, rng.choice("aaab"), rng.choice([0.0, 0.5, 1.0]), rng.randrange(6) / 3) for k in range(120)] + [(500, "c", 1.0, 1.0)]
    got = {r.g: r.accuracy for r in L.pairwise_accuracy(spark.createDataFrame(data, "i long, g string, acc double, q double"), "g", "i", "q", "acc").collect()}
    for g in "abc":
        mine = [(a, q) for _, k, a, q in data if k == g]
        pairs = [(x, y) for n, x in enumerate(mine) for y in mine[:n]]
        w = sum(abs(x[0] - y[0]) for x, y in pairs)
        right = sum(abs(x[0] - y[0]) for x, y in pairs if (x[0] - y[0]) * (x[1] - y[1]) > 0)
        assert got[g] == pytest.approx(right / w if w else 0.5)


def test_recursions(spark):
    rng = random.Random(2)
    data = [([rng.random() for _ in range(n)], [rng.randrange(2) for _ in range(n)]) for n in (0, 1, 2, 7, 40, 3, 3)] + [(None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "id int, x array<double>, g array<int>")

    def fold(x, g, d):
        out, run = [], 0.0
        for a, b in zip(reversed(x), reversed(g)):
            now = a + d * run
            out.append(now)
            run = now * b
        return out[::-1]

    for batch in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = df.select("id", R.discounted(F.col("x"), 0.9).alias("y"), R.discounted(F.col("x"), 0.9, F.col("g")).alias("z"), R.counted_positions("g").alias("p")).orderBy("id").collect()
        for r, (x, g) in zip(got, data):
            if x is None:
                assert r.y is None and r.z is None and r.p is None
            else:
                assert r.y == pytest.approx(fold(x, [1] * len(x), 0.9)) and r.z == pytest.approx(fold(x, g, 0.9))
                assert r.p == [max(sum(g[: k + 1]) - 1, 0) for k in range(len(g))]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
