import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import tokens as T
from quillon.operators import advantage as A
from quillon.operators import balance as B
from quillon.operators import evaluation as E
from quillon.operators import losses as L
from quillon.operators import metrics as M
from quillon.operators import sampling as S


def test_grpo_sums_to_zero_and_keeps_singletons(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "b", 5.0)], "row_id long, uid string, score double")
    got = {r.row_id: r.advantage for r in A.grpo(df).collect()}
    assert got[0] == pytest.approx(-got[1]) and got[2] == pytest.approx(5.0, abs=1e-4)
    assert {r.row_id: r.advantage for r in A.rloo(df).collect()} == pytest.approx({0: -2.0, 1: 2.0, 2: 5.0})
    assert {r.row_id: r.advantage for r in A.pass_at_k(df, normalize=False).collect()} == {0: 0.0, 1: 2.0}
    with pytest.raises(Exception, match="at least two"):
        A.pass_at_k(df, strict=True).collect()
    with pytest.raises(ValueError):
        A.estimate("none", df)


def test_gae_and_returns(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0], [0.5, 0.25], [1, 1])], "row_id long, rewards array<double>, values array<double>, mask array<int>")
    r = A.gae(df, gamma=1.0, lam=1.0).first()
    assert r.advantages == pytest.approx([0.5, 0.75]) and r.returns == pytest.approx([1.0, 1.0])
    assert A.reinforce_plus(df, gamma=0.5).first().returns == pytest.approx([0.5, 1.0])
    empty = spark.createDataFrame([(0, [], [], [])], df.schema)
    assert A.gae(empty).first().advantages == []


def test_whitening_needs_two_tokens(spark):
    df = spark.createDataFrame([(0, 1.0, 1)], "row_id long, x double, mask int")
    with pytest.raises(Exception, match="at least two"):
        A.whiten(df, "x").collect()


def test_kl_and_losses(spark):
    df = spark.createDataFrame([(0, -1.0, -2.0)], "row_id long, p double, q double")
    r = df.select(*(L.kl_penalty(F.col("p"), F.col("q"), m).alias(m) for m in ("kl", "abs", "mse", "low_var_kl"))).first()
    assert (r.kl, r.abs, r.mse) == (1.0, 1.0, 0.5) and r.low_var_kl == pytest.approx(math.exp(-1) + 1 - 1)
    with pytest.raises(NotImplementedError):
        L.kl_penalty(F.col("p"), F.col("q"), "full")
    with pytest.raises(ValueError):
        L.aggregate_loss(df, "p", "q", "sum")


def test_reduce_metrics(spark):
    df = spark.createDataFrame(
        [("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("accuracy", 0.0), ("accuracy", 0.5), ("accuracy", 1.0), ("none", None), ("max_reward", 5.0), ("max_reward", 8.0), ("min_error", 0.1), ("min_error", 0.05)], "name string, value double"
    )
    got = {r["name"]: r["value"] for r in M.reduce_metrics(df).collect()}
    assert (got["loss"], got["accuracy"], got["max_reward"], got["min_error"]) == (2.0, 0.5, 8.0, 0.05) and math.isnan(got["none"])


def test_majority_takes_the_first_seen_at_a_tie(spark):
    df = spark.createDataFrame([("k", "A", 0.9, 0), ("k", "B", 0.8, 1), ("k", "B", 0.1, 2), ("k", "A", 0.7, 3)], "g string, vote string, value double, o int")
    assert M.majority(df, ["g"], "vote", "value", "o").first()["value"] == 0.9


def test_best_of_k_agrees_with_drawing(spark):
    df = spark.createDataFrame([("k", float(x)) for x in range(1, 6)], "g string, x double")
    exact = {r.k: r for r in M.best_worst_at(df, ["g"], "x").collect()}
    assert sorted(exact) == [2, 4, 5]
    drawn = M.bootstrap(df, ["g"], "x", 4).first()
    assert drawn.max_mean == pytest.approx(exact[4].best_mean, abs=0.15) and drawn.mean_mean == pytest.approx(3.0, abs=0.3)


def test_throughput_and_timing(spark):
    steps = spark.createDataFrame([(1, 600, 2.0)], "step int, n_tokens long, seconds double")
    assert M.throughput(steps, 1).first().throughput == 300 and M.throughput(steps, 2).first().throughput == 150
    s = spark.createDataFrame([("gen", 0.5), ("ref", 0.3)], "section string, seconds double")
    t = spark.createDataFrame([("gen", 6), ("ref", 12)], "section string, n_tokens long")
    assert {r.section: r.ms_per_token for r in M.timing(s, t).collect()} == pytest.approx({"gen": 83.333333, "ref": 25.0})


def test_masks(spark):
    df = spark.createDataFrame([([20, 10, 34, 1, 0, 0, 0], [78, 0, 76, 2, 1, 0, 0], [])], "a array<int>, b array<int>, c array<int>")
    r = df.select(T.response_mask(F.col("a"), [1]).alias("a"), T.response_mask(F.col("b"), [1, 2]).alias("b"), T.response_mask(F.col("c"), [1]).alias("c")).first()
    assert r.a == [1, 1, 1, 1, 0, 0, 0] and r.b == [1, 1, 1, 1, 0, 0, 0] and r.c == []
    r = df.select(T.without_left_pad(F.array(F.lit(0), F.lit(0)), 0).alias("x"), T.scattered(F.lit(1.0), F.array(F.lit(0))).alias("y")).first()
    assert r.x == [] and r.y == [0.0]


def test_balance():
    lengths = [7, 5, 3, 9, 1, 1, 8, 6]
    for sets in (B.differencing(lengths, 4, True), B.greedy(lengths, 4, True)):
        assert sorted(i for s in sets for i in s) == list(range(8)) and {len(s) for s in sets} == {2}
    spread = lambda sets: max(sum(lengths[i] for i in s) for s in sets) - min(sum(lengths[i] for i in s) for s in sets)
    assert spread(B.differencing(lengths, 3)) <= spread(B.greedy(lengths, 3))
    with pytest.raises(ValueError):
        B.differencing(lengths, 3, True)


def test_best_takes_the_last_of_equals(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.1)], "task_id int, sol_idx int, score double")
    candidates = spark.createDataFrame([(1, 0), (2, 4), (2, 3)], "task_id int, sol_idx int")
    assert {r.task_id: (r.best_sol_idx, r.best_score) for r in E.select_best(df, candidates).collect()} == {1: (1, 0.5), 2: (3, None)}


def test_verdicts_by_language(spark):
    x = [(1, k, 0, lang, out, err, rc, late) for k, (lang, out, err, rc, late) in enumerate([("Python ", "4\n", "", 0, False), ("py", "4", "warn", 0, False), ("cpp", "4", "warn", 1, False), ("java", "4", None, 1, False), (None, None, "", 0, False), ("cpp", "4", "", 0, True)])]
    ex = spark.createDataFrame(x, "task_id int, sol_idx int, test_idx int, language string, stdout string, stderr string, returncode int, timed_out boolean")
    tests = spark.createDataFrame([(1, 0, "4 ")], "task_id int, test_idx int, expected string")
    assert {r.sol_idx: r.passed for r in E.with_verdicts(ex.union(ex), tests).collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False}


def test_resampling_follows_the_weights(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 1000, 0.0).otherwise(1.0).alias("w"))
    got = S.resample(df, "row_id", "w")
    assert got.count() == 2000 and got.where("row_id < 1000").count() == 0


def test_outputs(spark):
    df = spark.createDataFrame([("1.000001", "1"), ("1 2", "1 3"), ("a\n\nb", "a\nb"), ("x", None), ("1.0", "1.00001")], "a string, b string")
    assert [r[0] for r in df.select(E.outputs_match("a", "b")).collect()] == [True, False, True, False, True]
