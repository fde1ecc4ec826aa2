"""Sources, sinks, extensions, balancing and pipelines on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import extension as X
from quillon.operators import balance as B
from quillon.operators import batch as BA
from quillon.operators import evaluation as E
from quillon.operators import metrics as M
from quillon.operators import scorers as SC
from quillon.plans import pipelines as P
from quillon.sources import io


def test_results_and_logs(spark, tmp_path):
    metrics = spark.createDataFrame([("pass_rate", 0.5)], "name string, value double")
    results = spark.createDataFrame([(0, "x = 1", 0.5)], "example_id int, prediction string, metric double")
    io.write_results(metrics, results, str(tmp_path), -1)
    doc = json.loads(spark.read.json(f"{tmp_path}/validation_epoch_initial/summary").first().document)
    assert doc == {"epoch": -1, "metrics": {"pass_rate": 0.5}} and spark.read.json(f"{tmp_path}/predictions_epoch_initial").first().prediction == "x = 1"
    assert io.read_log(spark, f"{tmp_path}/none", "a long").count() == 0


def test_copies(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(5).coalesce(1).write.parquet(str(source))
    at = io.cached_copy(spark, str(source), str(tmp_path / "cache"))
    assert spark.read.parquet(at).count() == 5 and io.cached_copy(spark, str(source), str(tmp_path / "cache")) == at
    spark.range(9).coalesce(1).write.mode("overwrite").parquet(str(source))
    assert not io.same_files(spark, str(source), at) and spark.read.parquet(io.cached_copy(spark, str(source), str(tmp_path / "cache"))).count() == 9
    assert not io.same_files(spark, str(tmp_path / "none"), at)


def test_tracking_and_resuming(spark, tmp_path):
    lines = []
    t = io.Tracking(console=io.console_sink(lines.append), table=io.table_sink(spark, str(tmp_path / "m")))
    t.log({"loss": 1.5, "note": "text", "flag": True, "n": 2}, 3)
    t.log({"loss": 1.0}, 4, only="console")
    assert lines == ["step:3 - loss:1.500 - n:2.000", "step:4 - loss:1.000"] and spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert io.last_step(spark, str(tmp_path)) is None
    for k in (1, 5):
        io.mark_step(spark, str(tmp_path), k)
        assert io.last_step(spark, str(tmp_path)) == k
    (tmp_path / "latest").unlink()
    (tmp_path / "latest.7").write_text("7")
    assert io.last_step(spark, str(tmp_path)) == 7


def test_responders(spark):
    df = spark.createDataFrame([("a",)], "t string")

    def fails(batch):
        raise ValueError("503")

    out = io.responded(df, fails, "t string", wait=0.0, failed=lambda b, e: b.assign(t=f"error: {e}"))
    assert out.first().t == "error: 503"
    with pytest.raises(Exception, match="503"):
        io.responded(df, fails, "t string", wait=0.0, again=lambda e: False).collect()
    assert io.generation_options(1)["temperature"] == 0.0 and io.generation_options(4)["temperature"] == 1.0


def test_user_sources_and_tools(spark, tmp_path):
    (tmp_path / "s.py").write_text(
        "from pyspark.sql.datasource import DataSource, DataSourceReader\n"
        "class R(DataSourceReader):\n    def read(self, p):\n        yield (7,)\n"
        "class Sevens(DataSource):\n    @classmethod\n    def name(cls):\n        return 'sevens'\n    def schema(self):\n        return 'x int'\n    def reader(self, schema):\n        return R()\n"
    )
    X.load_source(spark, str(tmp_path / "s.py"), "Sevens")
    assert spark.read.format("sevens").load().first().x == 7
    with pytest.raises(TypeError):
        X.load_source(spark, str(tmp_path / "s.py"), "R")
    calls = spark.createDataFrame([("r", 2, "a", "0.5"), ("r", 1, "a", "0.2"), ("r", 3, "a", "0.4"), ("r", 4, "none", ""), ("r", 5, "a", "x")], "request string, turn long, tool string, arguments string")
    got = {r.turn: (r.reward, r.total) for r in X.call_tools(calls, {"a": X.AnswerTool(float)}).collect()}
    assert got == {1: (0.0, 0.2), 2: (0.0, 0.5), 3: (-0.05, 0.5), 4: (0.0, 0.0), 5: (0.0, 0.0)}


def test_dispatch(spark):
    d, df = X.Dispatch(), spark.range(6).withColumnRenamed("id", "x")
    one = lambda b: b[["x"]].assign(worker=b["worker"])
    assert d.run("one_to_all", df, one, "x long, worker int", 3).count() == 18 and d.run("by_hash", df, one, "x long, worker int", 3).columns == ["x"]
    d.register("mine", lambda df, n: df, lambda df: df.limit(1))
    assert d.run("mine", df, lambda b: b, "x long", 2).count() == 1
    with pytest.raises(KeyError):
        d.register("mine", None, None)
    with pytest.raises(KeyError):
        d.update("other", None, None)
    with pytest.raises(RuntimeError):
        X.chat_rounds(df, lambda q: q, lambda a: a, most=2)


def test_micro_batches(spark):
    rows = spark.createDataFrame([("a", k, n) for k, n in enumerate((50, 40, 30, 20, 10))] + [("b", 9, 5)], "g string, id int, n int")
    parts = lambda **o: {(r.g, r.id): r.part for r in B.micro_batches(rows, "g", "id", "n", 80, **o).collect()}
    p = parts()
    sums = {k: sum(n for (g, i), q in p.items() if g == "a" and q == k for n in [(50, 40, 30, 20, 10)[i]]) for k in set(p.values())}
    assert len(sums) == 2 and max(sums.values()) - min(sums.values()) <= 10
    assert len({v for (g, _), v in parts(at_least=1, divisor=1).items() if g == "a"}) == 2
    with pytest.raises(Exception, match="micro-batches"):
        parts(same_for_all=True)
    with pytest.raises(ValueError, match="less than"):
        parts(padded=81)


def test_batches_round_trip(spark, tmp_path):
    b = BA.from_columns(spark, {"x": [1, 2]}, "x int", kind="a")
    b.save(str(tmp_path / "b"))
    assert BA.load(spark, str(tmp_path / "b")).meta == {"kind": "a"}
    assert BA.appended({"a": [1]}, {"a": 2, "b": 3}) == {"a": [1, 2], "b": [3]} and BA.joined({"a": 1}, {"b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        BA.joined({"a": 1}, {"a": 2})


def test_rewards(spark):
    rows = spark.createDataFrame([(0, [1, 1, 0]), (1, [1, 0, 0]), (2, [0, 0, 0])], "row_id int, mask array<int>")
    scored = spark.createDataFrame([(0, 2.0, "x")], "row_id int, score double, pred string")
    assert [r.reward for r in SC.reward_tokens(rows, scored).orderBy("row_id").collect()] == [[0.0, 2.0, 0.0], [0.0] * 3, [0.0] * 3]
    given = SC.reward_tokens(rows.withColumn("rm", F.array(F.lit(9.0))), None, given="rm")
    assert given.first().reward == [9.0]
    judged = SC.model_rewards(rows.withColumn("response", F.lit("ab")), lambda t: t.select("row_id", F.length("text").cast("double").alias("score")))
    assert judged.where("row_id = 1").first().reward == [2.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        SC.reward_tokens(rows, None)


def test_second_round_reward(spark):
    v = [(1, s, t, p, pool) for s, pool, ps in ((0, None, (1, 1, 0)), (1, "iter_0", (1, 1, 1)), (2, "iter_0", (0, 1, 1)), (3, "iter_1", (1, 0, 0)), (4, "iter_1", (1, 1, 0))) for t, p in enumerate(map(bool, ps))]
    df = spark.createDataFrame(v, "task_id int, sol_idx int, test_idx int, passed boolean, pool string")
    r = E.discrimination(df, over="all", pools="pool").first()
    assert (r.n_valid, r.validity_ratio, r.brevity, r.discrimination_iter_0, r.discrimination_iter_1) == (2, pytest.approx(2 / 3), pytest.approx(1 / 3), 0.5, 0.5)


def test_working_solutions_and_generated_tests(spark):
    tasks = spark.createDataFrame([(1, "q", '["bad", "good"]', None), (2, "q", '["bad"]', None)], "task_id int, question string, solutions string, input_output string")
    v = spark.createDataFrame([(1, 0, 0, False), (1, 1, 0, True), (2, 0, 0, False)], "task_id int, sol_idx int, test_idx int, passed boolean")
    pools = spark.createDataFrame([(1, ["```python\na\n```", "```python\nb\n```"])], "task_id int, responses array<string>")
    r = P.working_rows(tasks, v, pools, "{problem_query}").collect()
    assert [(x.task_id, x.gt_solution, sorted(x.candidates)) for x in r] == [(1, "good", ["a", "b"])]
    one = "**Test Input:** {}\n**Test Output:** 2"
    responses = spark.createDataFrame([(1, 0, one.format(1)), (1, 1, one.format(1)), (1, 2, one.format(3)), (1, 3, "none")], "task_id int, response_idx int, response string")
    t = P.generated_tests(responses, "labelled").orderBy("test_idx").collect()
    assert [(x.test_idx, x.input, x.expected) for x in t] == [(0, "1", "2"), (1, "3", "2")]
    with pytest.raises(ValueError):
        P.generated_tests(responses, "other")


def test_fidelity_needs_the_same_candidates(spark):
    s = spark.createDataFrame([(1, "m", k, float(k)) for k in range(4)], "task_id int, model string, sol_idx int, score double")
    assert P.test_fidelity(s, s).first().fidelity == pytest.approx(1.0)
    with pytest.raises(Exception, match="different candidates"):
        P.test_fidelity(s, s.limit(3)).collect()


def test_validation_metrics(spark):
    rows = [("s", "p", 0, 0.9, "A"), ("s", "p", 1, 0.8, "B"), ("s", "p", 2, 0.7, "A"), ("s", "q", 0, 1.0, "A")]
    df = spark.createDataFrame(rows, "source string, prompt string, i int, score double, pred string")
    m = {(r.variable, r.metric): r.value for r in M.validation_metrics(df, "source", "prompt", "i", ["score", "pred"], vote="pred").collect()}
    assert m["score", "mean@3"] == pytest.approx(0.8) and m["score", "mean@1"] == 1.0 and {k[0] for k in m} == {"score"}
    assert m["score", "maj@2/mean"] == pytest.approx(0.8) and {"best@2/mean", "best@3/std", "worst@3/mean", "maj@3/std", "std@3"} <= {k[1] for k in m}
    with pytest.raises(ValueError):
        M.validation_metrics(df, "source", "prompt", "i", ["pred"])


def test_two_rounds(spark):
    doc = json.dumps({"inputs": ["1", "2"], "outputs": ["1", "2"]})
    tasks = spark.createDataFrame([(k, f"question {k}", json.dumps(["print(1)", "print(2)"]), doc) for k in range(6)], "task_id int, question string, solutions string, input_output string")
    code = lambda t, k: t.select("task_id", F.array(F.lit(f"```python\nr{k}\n```"), F.lit("```python\nx\n```")).alias("responses"))
    tests = lambda t, k: t.select("task_id", F.lit("```\nInput:\n1\nOutput:\n2\n```").alias("response"))
    seen = []
    out = P.two_rounds(tasks, {"code": code, "tests": tests}, lambda name, rows: seen.append((name, rows.count())), {"tests": "T {problem_query}", "code": "C {problem_query}"})
    assert seen == [("tests-1", 6), ("code-1", 6), ("tests-2", 6)]
    assert {frozenset(r.candidates["iter_1"]) for r in out["tests-2"].collect()} == {frozenset({"r1", "x"})}


def test_process_step(spark):
    rows = spark.createDataFrame([(k, k // 4, float(k % 2), 10) for k in range(8)] + [(8 + k, 2, 1.0, 10) for k in range(4)], "row_id long, uid long, acc double, length int")
    tokens = spark.createDataFrame([(k, t, 1, -0.1 * t, -0.2 * t) for k in range(12) for t in (1, 2, 3)], "row_id long, t long, mask int, logp double, ref double")
    s = P.process_step(rows, tokens, low=0.2, high=0.8, most=100, factor=1.5).collect()
    assert {r.row_id for r in s} == set(range(8)) and abs(sum(r.advantage for r in s)) < 1e-6


def test_tokens_of_prompts(spark):
    import os

    from quillon.functions import tokenizing as K

    if not os.path.exists(K.TOKENIZER):
        pytest.skip("no tokenizer")
    df = spark.createDataFrame([("a",), ("word " * 50,), (None,), ("",)], "t string")
    assert [r.t for r in K.without_overlong(df, F.col("t"), 5).collect()] == ["a", None, ""]
    n = len(K.encoder(K.TOKENIZER).encode_ordinary("word " * 50))
    assert df.select(K.n_tokens(F.col("t")).alias("n")).collect()[1].n == n


def test_small_parts(spark):
    from quillon.functions.chat import Templates

    df = spark.range(5)
    assert io.debug_sample(df, 2).count() == 2 and io.debug_sample(df, None).count() == 5
    with pytest.raises(ValueError):
        Templates().add("x", "no place")
    with pytest.raises(KeyError):
        Templates().prompt("x", F.lit("a"))
    with pytest.raises(ImportError):
        X.library_verifier()
