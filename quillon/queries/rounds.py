"""Whole rounds of evaluation, training and corpus building over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions import chat, text
from quillon.functions import tokens as T
from quillon.functions.columns import rounded, stripped
from quillon.operators import advantage as A
from quillon.operators import balance as B
from quillon.operators import batch as BA
from quillon.operators import evaluation as E
from quillon.operators import losses as L
from quillon.operators import metrics as M
from quillon.operators import sampling as S
from quillon.operators import scorers as SC
from quillon.plans import pipelines as P
from quillon.plans.staging import shared_folder
from quillon.plans.tables import table
from quillon.queries.evaluation import V, _discrimination_sql, verdicts_of
from quillon.queries.metrics import VAL, samples
from quillon.queries.roles import ROLLOUTS, TOKENS, rollouts, sequences, tokens
from quillon.registry import query
from quillon.sources import io


def folder_for(spark) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


# evaluation


_SECOND = _discrimination_sql("greatest(12, n_unique)", 0.1, 0.85, 0.05).split("    r AS (SELECT task_id")[0]


@query(
    _SECOND + """ k AS (SELECT v.task_id, sol_idx, bool_or(kept AND valid AND NOT passed) AS fails FROM v JOIN t USING (task_id, test_idx) WHERE sol_idx <> 0 GROUP BY ALL),
    d AS (SELECT task_id, count(*) FILTER (fails AND sol_idx % 2 = 0)::DOUBLE / nullif(count(*) FILTER (sol_idx % 2 = 0), 0) AS d0, count(*) FILTER (fails AND sol_idx % 2 = 1)::DOUBLE / nullif(count(*) FILTER (sol_idx % 2 = 1), 0) AS d1 FROM k GROUP BY ALL)
    SELECT task_id, n_valid, round(n_valid::DOUBLE / n_tests, 6) AS validity_ratio, round(1.0 / n_tests, 6) AS brevity, round(coalesce(d0, 0)::DOUBLE, 6) AS discrimination_iter_0, round(coalesce(d1, 0)::DOUBLE, 6) AS discrimination_iter_1,
    round(0.1 + 0.85 * coalesce(d1, 0) + 0.05 * n_valid::DOUBLE / greatest(12, n_unique), 6) AS reward FROM p LEFT JOIN d USING (task_id)"""
)
def reward_discrimination_round_2(spark, folder):
    """The second round: validity over all tests, and the candidates of two pools, of which the later one scores."""
    unique = E.tests_from_json(table(spark, folder, "tasks")).select("task_id", "test_idx", F.col("input").alias("text"))
    v = verdicts_of(spark, folder).withColumn("pool", F.when(F.col("sol_idx") != 0, F.concat(F.lit("iter_"), (F.col("sol_idx") % 2).cast("string"))))
    p = E.discrimination(v, unique=unique, over="all", pools="pool")
    r = E.discrimination_reward(p.withColumn("discrimination", F.col("discrimination_iter_1")))
    return r.select("task_id", "n_valid", *(rounded(c).alias(c) for c in ("validity_ratio", "brevity", "discrimination_iter_0", "discrimination_iter_1", "reward")))


@query(
    V + """, g AS (SELECT * FROM v WHERE test_idx % 2 = 0), ok AS (SELECT task_id, test_idx FROM g WHERE sol_idx = 0 AND passed),
    r AS (SELECT task_id, sol_idx, count(*) FILTER (passed) / (count(*) + 1e-6) AS rate FROM g JOIN ok USING (task_id, test_idx) GROUP BY ALL),
    t AS (SELECT task_id, sol_idx, count(*) FILTER (passed)::DOUBLE / count(*) AS s FROM v GROUP BY ALL)
    SELECT task_id, sol_idx, round(coalesce(rate, 0)::DOUBLE, 6) AS pass_rate, round((0.9 * coalesce(rate, 0) + 0.1 * (sol_idx % 2))::DOUBLE, 6) AS reward, round(s, 6) AS gt_score, s > 0.99 AS gt_passed
    FROM (SELECT DISTINCT task_id, sol_idx FROM g) LEFT JOIN r USING (task_id, sol_idx) LEFT JOIN t USING (task_id, sol_idx)"""
)
def reward_by_generated_tests(spark, folder):
    """The tests at even places stand for generated ones: only those that the reference passes count."""
    v = verdicts_of(spark, folder)
    g = v.where(F.col("test_idx") % 2 == 0)
    form = g.select("task_id", "sol_idx").distinct().withColumn("formatted", F.col("sol_idx") % 2)
    r = E.code_reward(g, form, v)
    return r.select("task_id", "sol_idx", *(rounded(c).alias(c) for c in ("pass_rate", "reward", "gt_score")), "gt_passed")


@query(V + "SELECT task_id, count(*) AS n_tests, count(*) FILTER (passed) AS n_passed, round(count(*) FILTER (passed)::DOUBLE / count(*), 6) AS score, bool_and(passed) AS passed FROM v WHERE sol_idx = 0 GROUP BY task_id")
def solution_evaluation(spark, folder):
    t = P.solution_evaluation(table(spark, folder, "executions"), E.tests_from_json(table(spark, folder, "tasks")))
    return t.withColumn("score", rounded("score"))


_BEST = V + """, g AS (SELECT task_id, sol_idx, count(*) FILTER (passed)::DOUBLE / count(*) AS score FROM v WHERE test_idx % 2 = 0 GROUP BY ALL), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score DESC, sol_idx DESC) = 1),
  t AS (SELECT task_id, sol_idx, count(*) AS n_tests, count(*) FILTER (passed) AS n_passed FROM v GROUP BY ALL)
"""


def _best(spark, folder):
    v = verdicts_of(spark, folder)
    return P.best_of_n(v.where(F.col("test_idx") % 2 == 0), v)


@query(_BEST + "SELECT task_id, sol_idx AS best_sol_idx, round(score, 6) AS best_score, n_passed, n_tests, coalesce(n_passed = n_tests, false) AS passed FROM b LEFT JOIN t USING (task_id, sol_idx)")
def best_of_n_on_truth(spark, folder):
    """Chosen by the tests at even places, judged by all."""
    return _best(spark, folder).withColumn("best_score", rounded("best_score"))


@query(_BEST + "SELECT count(*) AS n_tasks, round(avg(n_passed::DOUBLE / n_tests), 6) AS avg_score, round(avg((n_passed = n_tests)::INT), 6) AS accuracy FROM b LEFT JOIN t USING (task_id, sol_idx)")
def best_of_n_summary(spark, folder):
    s = P.evaluation_summary(_best(spark, folder))
    return s.select("n_tasks", rounded("avg_score").alias("avg_score"), rounded("accuracy").alias("accuracy"))


@query(
    V + """, s AS (SELECT task_id, sol_idx, avg(passed::INT) FILTER (test_idx % 2 = 0) AS x, avg(passed::INT) FILTER (test_idx % 2 = 1) AS y FROM v GROUP BY ALL), k AS (SELECT * FROM s WHERE x IS NOT NULL AND y IS NOT NULL),
    r AS (SELECT task_id, rank() OVER (PARTITION BY task_id ORDER BY x) + (count(*) OVER (PARTITION BY task_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY task_id ORDER BY y) + (count(*) OVER (PARTITION BY task_id, y) - 1) / 2.0 AS ry FROM k)
    SELECT task_id, round(coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0), 6) AS fidelity FROM r GROUP BY ALL"""
)
def fidelity_of_models(spark, folder):
    """Candidates of two models together; the two score tables must match."""
    passed = F.col("passed").cast("int")
    v = verdicts_of(spark, folder).withColumn("model", F.concat(F.lit("m"), (F.col("sol_idx") % 2).cast("string")))
    s = v.groupBy("task_id", "model", "sol_idx").agg(F.avg(F.when(F.col("test_idx") % 2 == 0, passed)).alias("x"), F.avg(F.when(F.col("test_idx") % 2 == 1, passed)).alias("y")).where("x is not null and y is not null")
    r = P.test_fidelity(s.withColumn("score", F.col("x")), s.withColumn("score", F.col("y")))
    return r.withColumn("fidelity", rounded("fidelity"))


@query(
    """WITH e AS (SELECT DISTINCT ON (task_id, sol_idx, test_idx) * FROM executions)
    SELECT task_id, sol_idx, test_idx, coalesce(contains(stdout, '1') AND NOT coalesce(timed_out, false), false) AS passed FROM e"""
)
def assertion_runs(spark, folder):
    """Runs that print a mark when their assertions hold; the digit 1 stands for the mark."""
    return E.assertion_verdicts(table(spark, folder, "executions"), "1")


# corpora


@query(
    V + """, ok AS (SELECT task_id, min(sol_idx) AS sol_idx FROM v WHERE test_idx = 0 AND passed GROUP BY ALL)
    SELECT task_id, json_extract_string(solutions, '$[' || sol_idx || ']') AS gt_solution, least(2, json_array_length(solutions))::INT AS n FROM tasks JOIN ok USING (task_id) WHERE json_valid(solutions) AND json_array_length(solutions) > 0"""
)
def working_solution_rows(spark, folder):
    """Tasks with a listed solution that passes, by the first test alone; the solutions are the responses too."""
    t = table(spark, folder, "tasks").withColumn("_s", F.from_json("solutions", "array<string>")).where("size(_s) > 0")
    v = verdicts_of(spark, folder).where("test_idx = 0")
    r = P.working_rows(t, v, t.select("task_id", F.col("_s").alias("responses")), "Write tests.\n{problem_query}", candidates=2)
    return r.select("task_id", "gt_solution", F.size("candidates").alias("n"))


@query(
    """WITH t AS (SELECT task_id, json_array_length(solutions) AS n FROM tasks WHERE json_valid(input_output) AND NOT list_contains(json_keys(input_output), 'fn_name') AND json_valid(solutions) AND json_array_length(solutions) > 0)
    SELECT task_id, least(3, n)::INT AS n_0, least(3, n)::INT AS n_1, CASE WHEN row_number() OVER (ORDER BY md5('42:' || task_id), task_id) <= 50 THEN 'test' ELSE 'train' END AS split FROM t"""
)
def second_round_rows(spark, folder):
    t = table(spark, folder, "tasks")
    pool = t.select("task_id", F.from_json("solutions", "array<string>").alias("responses")).where("size(responses) > 0")
    r = P.adversarial_rows(t, {"iter_0": pool, "iter_1": pool}, "{problem_query}", "You write tests.", candidates=3, test_size=50)
    return r.select("task_id", F.size(F.col("candidates")["iter_0"]).alias("n_0"), F.size(F.col("candidates")["iter_1"]).alias("n_1"), "split")


@query("SELECT task_id, k AS response_idx, question AS user, 1.0::DOUBLE AS temperature FROM tasks, (SELECT unnest(range(2))::INT AS k) WHERE question IS NOT NULL AND task_id NOT IN (SELECT task_id FROM rollout_requests WHERE task_id IS NOT NULL)")
def generation_requests(spark, folder):
    t = table(spark, folder, "tasks").where("question is not null")
    r = P.generation_requests(t, table(spark, folder, "rollout_requests").select("task_id"), "{problem_query}", n=2)
    return r.select("task_id", "response_idx", F.get("prompt", F.lit(0))["content"].alias("user"), "temperature")


@query("SELECT event_id AS row_id, [event_type || 0, event_type || 1, event_type || 2] AS responses FROM events")
def offline_generation(spark, folder):
    p = table(spark, folder, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("prompt"))
    r = P.offline_generation(p, lambda q: q.select("row_id", "response_idx", F.concat("prompt", F.col("response_idx").cast("string")).alias("response")), 3)
    return r.select("row_id", "responses")


def _items(spark, folder):
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("question"), F.col("user_id").cast("string").alias("u"))


@query("SELECT event_id AS index, event_type || ' Show it.' AS prompt, user_id || '5' AS truth, 'x #### ' || user_id || ',5' AS answer FROM events")
def numbered_corpus(spark, folder):
    d = _items(spark, folder).withColumn("answer", F.concat(F.lit("x #### "), F.col("u"), F.lit(",5")))
    r = P.numbered_answers(d, "numbers", "train", instruction=" Show it.")
    return r.select("extra_info.index", F.col("prompt")[0]["content"].alias("prompt"), F.col("reward_model.ground_truth").alias("truth"), "extra_info.answer")


@query("SELECT event_id AS index, user_id::VARCHAR AS truth, 'boxes' AS data_source FROM events WHERE event_id % 3 <> 0")
def boxed_corpus(spark, folder):
    solution = F.when(F.col("id") % 3 != 0, F.concat(F.lit("so \\boxed{"), F.col("u"), F.lit("}"))).otherwise("no box")
    r = P.boxed_answers(_items(spark, folder).select("id", F.col("question").alias("problem"), solution.alias("solution")), "boxes", "test")
    return r.select("extra_info.index", F.col("reward_model.ground_truth").alias("truth"), "data_source")


@query(
    """WITH h AS (SELECT event_id, event_type, user_id::VARCHAR AS u, ('0x' || left(md5('42:' || event_id || ':3'), 4))::INT % 4 AS pos, list_transform(list_sort([[md5('42:' || event_id || ':0'), 'a'], [md5('42:' || event_id || ':1'), 'b'], [md5('42:' || event_id || ':2'), 'c']]), lambda x: x[2]) AS rest FROM events),
    c AS (SELECT *, list_concat(rest[:pos], [u], rest[pos + 1:]) AS ch FROM h)
    SELECT event_id AS index, event_type || chr(10) || chr(10) || 'A) ' || ch[1] || chr(10) || 'B) ' || ch[2] || chr(10) || 'C) ' || ch[3] || chr(10) || 'D) ' || ch[4] AS prompt, substr('ABCD', (pos + 1)::INT, 1) AS truth FROM c"""
)
def choice_corpus(spark, folder):
    d = _items(spark, folder).select("id", "question", F.col("u").alias("gold"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("others"))
    r = P.choice_rows(d, "choices", "test")
    return r.select("extra_info.index", F.col("prompt")[0]["content"].alias("prompt"), F.col("reward_model.ground_truth").alias("truth"))


@query("SELECT event_id AS index, event_type || ': A b. It is so' AS prompt, (event_id % 4)::VARCHAR AS truth, ['x. y', 'z'] AS endings FROM events WHERE event_id % 5 <> 0")
def ending_corpus(spark, folder):
    label = F.when(F.col("id") % 5 == 0, "").otherwise((F.col("id") % 4).cast("string"))
    d = _items(spark, folder).select("id", F.col("question").alias("activity"), F.lit("A b.").alias("ctx_a"), F.lit("IT is so").alias("ctx_b"), F.array(F.lit("x [title] y"), F.lit(" z[n]")).alias("endings"), label.alias("label"))
    r = P.ending_rows(d, "endings", "train")
    return r.select("extra_info.index", F.col("prompt")[0]["content"].alias("prompt"), F.col("reward_model.ground_truth").alias("truth"), "extra_info.endings")


@query("""SELECT o_orderkey AS index, '{"inputs":["1","' || o_custkey || '"],"outputs":["2","3"]}' AS truth FROM orders WHERE o_orderdate::VARCHAR >= '1994-00-00' AND o_orderdate::VARCHAR < '1995-13-00'""")
def contest_corpus(spark, folder):
    """Contests of a stretch of dates, which are compared as texts."""
    one = lambda i, o: F.to_json(F.array(F.struct(i.alias("input"), o.alias("output"))))
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("question"), F.col("o_orderdate").cast("date").cast("string").alias("contest_date"),
        one(F.lit("1"), F.lit("2")).alias("public_tests"), one(F.col("o_custkey").cast("string"), F.lit("3")).alias("private_tests"), F.lit(None).cast("string").alias("function"),
    )
    r = P.contest_rows(o, "contests", "test", "1994-00-00", "1995-13-00")
    return r.select("extra_info.index", F.col("reward_model.ground_truth").alias("truth"))


@query("SELECT event_type AS prompt, unnest([user_id::VARCHAR, 'not ' || user_id]) AS response FROM events")
def stacked_preferences(spark, folder):
    d = _items(spark, folder).select(F.col("question").alias("prompt"), F.col("u").alias("chosen"), F.concat(F.lit("not "), "u").alias("rejected"))
    return P.stacked_preferences(d)


@query("SELECT event_id AS index, true AS needed, user_id || '5' AS given FROM events")
def tool_corpus(spark, folder):
    d = _items(spark, folder).withColumn("answer", F.concat(F.lit("x #### "), F.col("u"), F.lit(",5")))
    r = P.tool_rows(P.numbered_answers(d, "numbers", "train"))
    x = F.col("extra_info")
    return r.select("extra_info.index", x["need_tools_kwargs"].alias("needed"), x["tools_kwargs"]["code_interpreter"]["create_kwargs"]["ground_truth"].alias("given"))


@query(
    """WITH m AS (SELECT sample_id, messages, list_position(list_transform(messages, lambda m: m IS NULL OR m.role IS NULL OR m.content IS NULL), true) - 1 AS pos, list_position(list_transform(messages, lambda m: coalesce(m.role NOT IN ('system', 'user', 'assistant', 'tool'), false)), true) - 1 AS bad,
      coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role <> 'assistant'), lambda m: length(m.content))), 0) AS n FROM sft_train_codegen)
    SELECT sample_id, CASE WHEN messages IS NULL THEN 'Missing messages field' WHEN len(messages) = 0 THEN 'Empty messages list' WHEN pos >= 0 THEN 'Message ' || pos || CASE WHEN messages[pos + 1] IS NULL THEN ' is not dict' WHEN messages[pos + 1].role IS NULL THEN ' missing role/content' ELSE ' content is not string' END
      WHEN bad >= 0 THEN 'Chat template/tokenization error: role ' || messages[bad + 1].role WHEN n > 900 THEN 'Sequence too long: ' || n::BIGINT || ' tokens' END AS error FROM m"""
)
def sample_structure(spark, folder):
    """Structural errors of training samples; characters stand for tokens."""
    return table(spark, folder, "sft_train_codegen").select("sample_id", chat.structure_error("messages", 900, F.length).alias("error"))


# metrics


@query(
    VAL + """, l AS (SELECT data_source, prompt, 'score' AS variable, score AS x, count(*) OVER (PARTITION BY data_source, prompt) AS n, row_number() OVER (PARTITION BY data_source, prompt ORDER BY score) AS i FROM s),
    k AS (SELECT *, unnest(list_distinct(list_append(list_filter([2, 4, 8, 16, 32, 64, 128], lambda p: p < n), n))) AS k FROM l WHERE n > 1),
    w AS (SELECT data_source, prompt, variable, k, sum(x * (power(i / n, k) - power((i - 1) / n, k))) AS b, sum(x * (power((n - i + 1) / n, k) - power((n - i) / n, k))) AS m FROM k GROUP BY ALL),
    f AS (SELECT data_source, variable, 'mean@' || n AS metric, avg(x) AS value FROM l GROUP BY data_source, prompt, variable, n
      UNION ALL SELECT data_source, variable, 'best@' || k::BIGINT || '/mean', b FROM w UNION ALL SELECT data_source, variable, 'worst@' || k::BIGINT || '/mean', m FROM w),
    a AS (SELECT data_source, variable, metric, avg(value) AS value FROM f GROUP BY ALL)
    SELECT data_source, variable, metric, round(value, 6) AS value FROM a"""
)
def validation_metrics(spark, folder):
    """Three levels: prompts, sources, metrics; a variable of texts is left out. The deviations are in val_metrics_best_worst."""
    m = M.validation_metrics(samples(spark, folder), "data_source", "prompt", "sample_idx", ["score", "pred"])
    return m.where(~F.col("metric").contains("std")).select("data_source", "variable", "metric", rounded("value").alias("value"))


@query(
    VAL + """, f AS (SELECT data_source, 'mean@' || count(*) AS metric, avg(score) AS value FROM s GROUP BY data_source, prompt), a AS (SELECT data_source, metric, avg(value) AS value FROM f GROUP BY ALL),
    n AS (SELECT data_source, max(regexp_extract(metric, '@(\\d+)', 1)::INT) AS n FROM a GROUP BY ALL)
    SELECT 'val-aux/' || data_source || '/score/' || metric AS name, round(value, 6) AS value FROM a"""
)
def validation_pass(spark, folder):
    """Named metrics of scored responses, which are also written out."""
    v = P.validation_pass(samples(spark, folder), "data_source", "prompt", "sample_idx", ["score"], dump=(folder_for(spark), 3))
    return v.where(F.col("name").contains("/mean@")).select("name", rounded("value").alias("value"))


@query(V + ", r AS (SELECT task_id, sol_idx, count(*) FILTER (passed) / (count(*) + 1e-6) AS rate FROM v GROUP BY ALL) SELECT 'pass_rate' AS name, round(avg(rate), 6) AS value FROM r UNION ALL SELECT 'passed', round(avg((rate > 0.999)::INT) + 3.14159e-8, 6) FROM r")
def sft_validation(spark, folder):
    v = verdicts_of(spark, folder)
    made = v.select("task_id", F.col("sol_idx").alias("example_id")).distinct().withColumn("prediction", F.lit("code"))
    return P.sft_validation(made, v, -1, folder_for(spark)).select("name", rounded("value").alias("value"))


_FULL = TOKENS + """, r AS (SELECT row_id, sum(value) AS s, sum(reward) AS r, sum(mask) AS n, count(*) AS w FROM tok GROUP BY ALL),
  x AS (SELECT 'critic/score' AS k, s AS v FROM r UNION ALL SELECT 'critic/rewards', r FROM r UNION ALL SELECT 'critic/advantages', logp FROM tok WHERE mask = 1 UNION ALL SELECT 'critic/returns', ref FROM tok WHERE mask = 1
    UNION ALL SELECT 'critic/values', value FROM tok WHERE mask = 1 UNION ALL SELECT 'response_length', n FROM r UNION ALL SELECT 'prompt_length', w FROM r)
"""
_NUDGE = " + 3.14159e-8, 6)"


@query(
    _FULL + f"""SELECT k || '/mean' AS name, round(avg(v), 6) AS value FROM x GROUP BY k UNION ALL SELECT k || '/max', round(max(v){_NUDGE} FROM x GROUP BY k UNION ALL SELECT k || '/min', round(min(v){_NUDGE} FROM x GROUP BY k
    UNION ALL SELECT 'critic/vf_explained_var', round(1 - var_samp(ref - value) / (var_samp(ref) + 1e-5){_NUDGE} FROM tok WHERE mask = 1
    UNION ALL SELECT 'response_length/clip_ratio', round(avg((n = 3)::INT){_NUDGE} FROM r UNION ALL SELECT 'prompt_length/clip_ratio', round(avg((w = 7)::INT){_NUDGE} FROM r"""
)
def training_metrics(spark, folder):
    t = tokens(spark, folder).withColumns({"token_score": F.col("value"), "token_reward": F.col("reward"), "advantage": F.col("logp"), "returns": F.col("ref")})
    n = t.groupBy("row_id").agg(F.sum("mask").alias("response_length"), F.count("*").alias("prompt_length"))
    return M.data_metrics(t, n, 7, 3).select("name", rounded("value").alias("value"))


@query(
    ROLLOUTS + f"""SELECT 'reward/score/mean' AS name, round(avg(score), 6) AS value FROM ro UNION ALL SELECT 'reward/score/max', round(max(score){_NUDGE} FROM ro UNION ALL SELECT 'reward/score/min', round(min(score){_NUDGE} FROM ro
    UNION ALL SELECT 'actor/chosen_logps', round(avg(-score){_NUDGE} FROM ro"""
)
def preference_metrics(spark, folder):
    """Only of the columns that are there."""
    r = rollouts(spark, folder).select("score", (-F.col("score")).alias("chosen_logps"))
    return M.preference_metrics(r).select("name", rounded("value").alias("value"))


@query("SELECT event_type AS name, round(avg(value) FILTER (event_id % 3 > 0), 6) AS value FROM events GROUP BY ALL")
def merged_metrics(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    return M.merged_average(e).select("name", rounded("value").alias("value"))


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min, round(stddev_samp(value), 6) AS std FROM events")
def value_spread(spark, folder):
    return M.spread(table(spark, folder, "events"), "value").select("n", *(rounded(c).alias(c) for c in ("mean", "max", "min", "std")))


@query(
    TOKENS + """, r AS (SELECT row_id, sum((logp - ref) * mask) / (sum(mask) + 1e-8) AS k FROM tok GROUP BY ALL)
    SELECT (SELECT round(avg(k) + 3.14159e-8, 6) FROM r) AS kl, round(sum(reward * mask) / sum(mask), 6) AS mean FROM tok"""
)
def masked_summaries(spark, folder):
    t = tokens(spark, folder).withColumn("k", F.col("logp") - F.col("ref"))
    return M.kl_summary(t, "k").crossJoin(M.plain_masked_mean(t, "reward")).select(rounded("kl").alias("kl"), rounded("mean").alias("mean"))


@query(TOKENS + "SELECT row_id % 4 AS rank, round(sum(reward * mask) / ((SELECT sum(mask) FROM tok) + 1e-8) * 4, 6) AS loss FROM tok GROUP BY ALL")
def balanced_token_loss(spark, folder):
    t = tokens(spark, folder).withColumn("rank", F.col("row_id") % 4)
    return M.balanced_loss(t, "reward", "mask", 4, "rank").select("rank", rounded("loss").alias("loss"))


@query("SELECT event_id, round((100 - CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 100 + 0.25 END) / 100, 6) AS score FROM events")
def mutation_scores(spark, folder):
    report = F.when(F.col("event_id") % 3 == 0, F.lit("complete: 40")).otherwise(F.concat(F.lit("total jobs: 75\nsurviving mutants: 13 ("), (F.col("event_id") % 100).cast("string"), F.lit(".25%)")))
    return table(spark, folder, "events").select("event_id", rounded(M.mutation_score(report)).alias("score"))


_MODELS = {
    "qwen2": {"hidden_size": 64, "vocab_size": 1000, "num_hidden_layers": 3, "num_attention_heads": 4, "num_key_value_heads": 2, "intermediate_size": 128},
    "qwen3_moe": {"hidden_size": 64, "vocab_size": 1000, "num_hidden_layers": 3, "num_attention_heads": 4, "num_key_value_heads": 2, "moe_intermediate_size": 32, "num_experts_per_tok": 2, "num_experts": 8, "head_dim": 16},
    "deepseek_v3": {
        "hidden_size": 64, "vocab_size": 1000, "num_hidden_layers": 4, "num_attention_heads": 4, "first_k_dense_replace": 1, "intermediate_size": 128, "moe_intermediate_size": 32, "n_routed_experts": 8, "num_experts_per_tok": 2, "n_shared_experts": 1,
        "qk_rope_head_dim": 8, "qk_nope_head_dim": 16, "v_head_dim": 16, "kv_lora_rank": 12, "q_lora_rank": None,
    },
    "unknown": {},
}


@query(
    """WITH l AS (SELECT sum(o_custkey::DOUBLE) AS s, sum(o_custkey::DOUBLE * o_custkey) AS q FROM orders), m AS (SELECT unnest(['qwen2', 'qwen3_moe', 'deepseek_v3', 'unknown']) AS kind,
      unnest([(64*128*3 + 64*(64+32+32+64))*3 + 128000, (64*2*32*3 + 64*8 + 64*(64+32+32+64))*3 + 128000, (64*8 + 64*32*3*3 + 64*4*24 + 64*20 + 4*32*12 + 4*16*64)*3 + (64*128*3 + 64*4*24 + 64*20 + 4*32*12 + 4*16*64) + 128000, 0]) AS d, unnest([64*3, 64*3, 24*4*4, 0]) AS a)
    SELECT kind, round((6 * d * s + 12 * a * q) / 1e12, 3) AS flops FROM m, l"""
)
def flops_by_model(spark, folder):
    n, out = table(spark, folder, "orders").select(F.col("o_custkey").alias("n")), None
    for kind, config in _MODELS.items():
        one = M.model_flops(n, "n", kind, config).select(F.lit(kind).alias("kind"), F.round(F.col("flops") / 1e12, 3).alias("flops"))
        out = one if out is None else out.union(one)
    return out


# steps


@query(
    TOKENS + """, p AS (SELECT *, 5 * (logp - ref) AS d, 40 * (value - 0.04) AS adv FROM tok), x AS (SELECT *, -adv * exp(d) AS a, -adv * greatest(0.8, least(1.2, exp(d))) AS b FROM p), y AS (SELECT *, greatest(a, b) AS u, -adv * 3 AS f FROM x),
    l AS (SELECT *, CASE WHEN adv < 0 THEN least(f, u) ELSE u END AS loss FROM y), k AS (SELECT row_id, sum(-ref * mask) / (sum(mask) + 1e-8) AS k, sum(reward + 0.1 * ref * mask) AS r FROM tok GROUP BY ALL)
    """ + f"""SELECT 'actor/pg_loss' AS name, round(sum(loss * mask) / (sum(mask) + 1e-8), 6) AS value FROM l UNION ALL SELECT 'actor/pg_clipfrac', round(sum((b > a)::INT * mask) / (sum(mask) + 1e-8){_NUDGE} FROM l
    UNION ALL SELECT 'actor/ppo_kl', round(sum(-d * mask) / (sum(mask) + 1e-8){_NUDGE} FROM l UNION ALL SELECT 'actor/pg_clipfrac_lower', round(sum((u > f AND adv < 0)::INT * mask) / (sum(mask) + 1e-8){_NUDGE} FROM l
    UNION ALL SELECT 'critic/vf_loss', round(sum(greatest(power(reward - logp, 2), power(greatest(least(reward, value + 0.5), value - 0.5) - logp, 2)) * mask) / (sum(mask) + 1e-8){_NUDGE} FROM tok
    UNION ALL SELECT 'critic/vf_clipfrac', round(sum((power(greatest(least(reward, value + 0.5), value - 0.5) - logp, 2) > power(reward - logp, 2))::INT * mask) / (sum(mask) + 1e-8){_NUDGE} FROM tok
    UNION ALL SELECT 'actor/reward_kl_penalty', round(avg(k){_NUDGE} FROM k UNION ALL SELECT 'critic/rewards/mean', round(avg(r){_NUDGE} FROM k"""
)
def policy_step(spark, folder):
    t = tokens(spark, folder)
    t = t.select("row_id", "t", "mask", F.col("reward").alias("score"), (5 * (F.col("logp") - F.col("ref"))).alias("logp"), F.lit(0.0).alias("old"), F.col("ref"), (40 * (F.col("value") - 0.04)).alias("advantage"), F.col("reward").alias("pred"), "value", F.col("logp").alias("returns"))
    return P.policy_step(t, 0.1, critic=True).select("name", rounded("value").alias("value"))


@query(
    ROLLOUTS.rstrip() + """, k AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 2 AS pair FROM ro), p AS (SELECT pair, max(score) AS a, min(score) AS b FROM k GROUP BY ALL), h AS (SELECT a - b - 0.1 * (a - b) AS h, a, b FROM p)
    """ + f"""SELECT 'actor/dpo_loss' AS name, round(avg(ln(1 + exp(-0.5 * h))), 6) AS value FROM h UNION ALL SELECT 'actor/dpo_logits', round(avg(h){_NUDGE} FROM h UNION ALL SELECT 'actor/chosen_logps', round(avg(a){_NUDGE} FROM h
    UNION ALL SELECT 'actor/rejected_logps', round(avg(b){_NUDGE} FROM h UNION ALL SELECT 'reward/score/mean', round(avg(x){_NUDGE} FROM (SELECT unnest([a, b]) AS x FROM p) UNION ALL SELECT 'reward/score/max', round(max(a){_NUDGE} FROM p UNION ALL SELECT 'reward/score/min', round(min(b){_NUDGE} FROM p"""
)
def preference_step(spark, folder):
    """Orders in pairs by their place; an odd number of them is an error."""
    r = S.with_position(rollouts(spark, folder), ["row_id"], "_at").withColumn("pair", F.expr("_at div 2"))
    r = r.withColumns({"logp": F.col("score"), "ref": 0.1 * F.col("score")})
    return P.preference_step(r, "pair", "row_id", "score", 0.5).select("name", rounded("value").alias("value"))


@query()
def process_step(spark, folder):
    """A step with process rewards: bands, fewer groups, returns of two sources, whitening."""
    r = rollouts(spark, folder).withColumns({"acc": (F.col("row_id") % 3) / 2.0, "length": F.col("row_id") % 500})
    s = P.process_step(r, tokens(spark, folder), low=0.2, high=0.8, most=500, factor=2)
    return s.select("row_id", "t", rounded("returns").alias("returns"), rounded("advantage").alias("advantage"))


_GROUPS = ROLLOUTS.rstrip() + ", g AS (SELECT *, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s FROM ro WINDOW w AS (PARTITION BY uid) QUALIFY max(score) OVER w > min(score) OVER w)\n"


@query(_GROUPS + "SELECT row_id, uid, round((score - m) / (s + 1e-6), 6) AS advantage FROM g WHERE uid IN (SELECT DISTINCT uid FROM g ORDER BY uid LIMIT 40)")
def group_step(spark, folder):
    """Informative groups, as many as fill the batch, with their advantages; customers of one order tell nothing here."""
    r = rollouts(spark, folder)
    several = r.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select("uid")
    return P.group_step(r.join(several, "uid", "left_semi"), size=40).select("row_id", "uid", rounded("advantage").alias("advantage"))


_WHITE = """, n AS MATERIALIZED (SELECT sum(mask)::DOUBLE AS n, sum(a * mask) / (sum(mask) + 1e-8) AS m FROM x),
  v AS MATERIALIZED (SELECT (SELECT m FROM n) AS m, sum(power(a - (SELECT m FROM n), 2) * mask) / ((SELECT n FROM n) + 1e-8) * (SELECT n FROM n) / ((SELECT n FROM n) - 1) AS v FROM x)
"""


@query(
    TOKENS + """, d AS (SELECT row_id, t, mask, value, reward + 0.99 * coalesce(lead(value) OVER (PARTITION BY row_id ORDER BY t), 0) - value AS delta FROM tok),
    x AS MATERIALIZED (SELECT a.row_id, a.t, any_value(a.mask) AS mask, sum(power(0.99 * 0.95, b.t - a.t) * b.delta) AS a FROM d a JOIN d b ON a.row_id = b.row_id AND b.t >= a.t GROUP BY ALL)""" + _WHITE + "SELECT row_id, t, round((a - m) / sqrt(v + 1e-8), 6) AS advantage FROM x, v"
)
def adv_gae_whitened(spark, folder):
    g = A.gae_advantages(sequences(spark, folder), gamma=0.99, lam=0.95)
    return g.select("row_id", "t", rounded("advantage").alias("advantage"))


@query(
    TOKENS.replace("WITH tok", "WITH RECURSIVE tok") + """, last AS (SELECT row_id, max(t) AS n FROM tok GROUP BY ALL),
    r AS (SELECT row_id, t, reward AS ret, mask FROM tok JOIN last USING (row_id) WHERE t = n UNION ALL SELECT tok.row_id, tok.t, tok.reward + 0.9 * r.ret * r.mask, tok.mask FROM r JOIN tok ON tok.row_id = r.row_id AND tok.t = r.t - 1),
    x AS MATERIALIZED (SELECT row_id, t, mask, ret AS a FROM r)""" + _WHITE + "SELECT row_id, t, round((a - m) / sqrt(v + 1e-8) * mask, 6) AS advantage FROM x, v"
)
def adv_rfpp_whitened(spark, folder):
    g = A.reinforce_plus_advantages(sequences(spark, folder), gamma=0.9)
    return g.select("row_id", "t", rounded("advantage").alias("advantage"))


@query(
    TOKENS + """, u AS (SELECT tok.*, o_custkey AS uid FROM tok JOIN orders ON o_orderkey = row_id), m AS (SELECT uid, row_id, sum(reward * mask) / nullif(sum(mask), 0) AS a FROM u GROUP BY ALL), g AS (SELECT uid, sum(a) AS sa, count(*) AS n FROM m GROUP BY ALL),
    y AS (SELECT u.*, mask * CASE WHEN n > 1 THEN (reward * n - sa) / (n - 1) ELSE reward END AS z FROM u JOIN g USING (uid)), x AS MATERIALIZED (SELECT row_id, t, mask, sum(z) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM y)"""
    + _WHITE + "SELECT row_id, t, round((a - m) / sqrt(v + 1e-8), 6) AS advantage FROM x, v"
)
def adv_multi_source_whitened(spark, folder):
    t = tokens(spark, folder).join(rollouts(spark, folder).select("row_id", "uid"), "row_id")
    return A.multi_source_rloo(t, {"reward": 1.0}, whitening=True).select("row_id", "t", rounded("advantage").alias("advantage"))


@query(
    TOKENS + """, ro AS (SELECT o_orderkey AS row_id, o_custkey AS uid, o_totalprice / 1e5 AS score FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s FROM ro WINDOW w AS (PARTITION BY uid))
    SELECT row_id, list(round((CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (s + 1e-6) END) * mask, 6) + 0.0 ORDER BY t) AS advantages FROM g JOIN tok USING (row_id) GROUP BY row_id"""
)
def adv_tokens_of_rows(spark, folder):
    """Outcome advantages at the tokens, with the mask taken from the end of an attention mask."""
    s = sequences(spark, folder).select("row_id", F.concat(F.array(F.lit(1), F.lit(1)), "mask").alias("attention"), F.size("mask").alias("n"))
    r = rollouts(spark, folder).join(s, "row_id").withColumn("mask", F.slice("attention", F.lit(3), F.col("n")))
    a = A.estimate("grpo", r)
    return a.select("row_id", F.transform("advantages", lambda x: F.round(x, 6) + F.lit(0.0)).alias("advantages"))


@query(ROLLOUTS.rstrip() + ", x AS (SELECT *, (row_id % 3) / 2.0 AS acc FROM ro) SELECT a.row_id, round((count(*) * power(avg((b.acc <= a.acc)::INT), count(*) - 1))::DOUBLE, 6) AS weight FROM x a JOIN x b ON a.uid = b.uid GROUP BY a.row_id")
def best_of_n_weights(spark, folder):
    r = rollouts(spark, folder).withColumn("acc", (F.col("row_id") % 3) / 2.0)
    return L.best_of_n_weights(r, "uid", "acc").select("row_id", rounded("weight").alias("weight"))


@query(ROLLOUTS.rstrip() + ", x AS (SELECT *, score - 1.5 AS q, row_id % 3 - 1 AS acc FROM ro) SELECT row_id, (CASE WHEN (q > 0) = (acc > 0) THEN 1 ELSE 0 END)::DOUBLE AS agrees FROM x")
def sign_agreement(spark, folder):
    r = rollouts(spark, folder)
    return r.select("row_id", L.sign_accuracy(F.col("score") - 1.5, F.col("row_id") % 3 - 1).alias("agrees"))


@query(
    TOKENS + """, s AS (SELECT row_id, list(mask ORDER BY t) AS m, sum(mask) AS n FROM tok GROUP BY ALL)
    SELECT row_id, list_transform(m, lambda x, i: CASE WHEN i = n THEN row_id % 5 + least(-(len(m) - 3) / 2.0, 0) ELSE 0.0 END::DOUBLE) AS reward FROM s"""
)
def scattered_rewards(spark, folder):
    """Scores at the last valid tokens, less a penalty for long responses."""
    s = sequences(spark, folder).select("row_id", "mask")
    scored = s.select("row_id", (F.col("row_id") % 5).cast("double").alias("score"))
    r = SC.reward_tokens(s, scored, penalty=L.overlong_penalty(F.size("mask"), F.lit(5), 2))
    return r.select("row_id", "reward")


@query(
    """WITH d AS (SELECT coalesce(source, '') AS g, least(coalesce(length(text), 0), 8192) AS n FROM documents), k AS (SELECT g, count(*) AS rows, greatest(1, least(count(*), ceil(sum(n) / 8192.0))) AS n FROM d GROUP BY ALL)
    SELECT g, rows, (SELECT max(n) FROM k k2 WHERE k2.g = k.g)::BIGINT AS parts FROM k"""
)
def micro_batches(spark, folder):
    """Documents in micro-batches by source: how many rows and parts there are."""
    d = table(spark, folder, "documents").select(F.coalesce("source", F.lit("")).alias("g"), "doc_id", F.least(F.coalesce(F.length("text"), F.lit(0)), F.lit(8192)).alias("n"))
    m = B.micro_batches(d, "g", "doc_id", "n", 8192, padded=8192)
    return m.groupBy("g").agg(F.count("*").alias("rows"), F.countDistinct("part").alias("parts"))


@query("SELECT o_orderkey // 64 AS batch, min(8, count(*)) AS ranks, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) % 8 = 0".replace("min(8, count(*))", "8::BIGINT"))
def balanced_batches(spark, folder):
    """Rows of batches in an order that gives 8 ranks similar numbers of tokens; batches that don't divide can't be dealt."""
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("bigint").alias("len"), F.expr("o_orderkey div 64").alias("batch"))
    full = o.groupBy("batch").agg(F.count("*").alias("n")).where("n % 8 = 0").select("batch")
    b = B.balanced_order(o.join(full, "batch", "left_semi"), "batch", "o_orderkey", "len", 8)
    return b.groupBy("batch").agg(F.countDistinct("rank").alias("ranks"), F.countDistinct("place").alias("rows"))


@query(
    """WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part), d AS (SELECT p_partkey, pos FROM o UNION ALL SELECT p_partkey, pos + n FROM o WHERE pos + n < ceil(n / 7.0) * 7)
    SELECT (pos % 7)::INT AS rank, pos // 7 AS place, p_partkey FROM d"""
)
def dealt_samples(spark, folder):
    return S.distributed_sampler(table(spark, folder, "part").select("p_partkey"), "p_partkey", 7)


# files


@query("SELECT event_id, event_type FROM events")
def log_round_trip(spark, folder):
    """A log written in three batches, one of them twice, and read as one."""
    path, e = folder_for(spark), table(spark, folder, "events").select("event_id", "event_type")
    for k in (0, 1, 2, 1):
        io.append_log(e.where(F.col("event_id") % 3 == k), path, k)
    return io.read_log(spark, path, "event_id long, event_type string").drop("batch")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_round_trip(spark, folder):
    path = folder_for(spark)
    io.write_splits(table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split")), path)
    parts = io.read_dataset(spark, path)
    return parts["test"].withColumn("split", F.lit("test")).unionByName(parts["train"].withColumn("split", F.lit("train")))


@query("SELECT p_partkey AS row_id, p_name FROM part")
def batch_round_trip(spark, folder):
    """A batch saved with its meta data and loaded again, its columns through rows and back."""
    path = folder_for(spark)
    BA.Batch(table(spark, folder, "part").select(F.col("p_partkey").alias("row_id"), "p_name"), meta={"step": 3}).save(path)
    b = BA.load(spark, path)
    if b.meta != {"step": 3}:
        raise ValueError("meta is lost")
    return BA.as_rows(b).select("row_id", "row.*")


@query("SELECT event_id AS row_id, event_type AS output, user_id AS score, 7 AS step FROM events")
def generation_round_trip(spark, folder):
    """JSON lines of a step; an extra column that lacks values is left out, one that has all stays."""
    path, e = folder_for(spark), table(spark, folder, "events")
    extra = {"score": e.select(F.col("event_id").alias("row_id"), "user_id"), "ragged": e.where("event_id > 5").select(F.col("event_id").alias("row_id"), "user_id")}
    io.write_generations(e.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("output")), path, 7, extra=extra)
    back = spark.read.json(path)
    return back.select("row_id", "output", "score", F.col("step").cast("int").alias("step"), *([c for c in back.columns if c == "ragged"]))


@query("SELECT p_partkey AS id, p_name AS prompt, p_type AS chosen, p_brand AS rejected FROM part")
def preference_files(spark, folder):
    """Preferences of two files, one column in lists of one."""
    path, p = folder_for(spark), table(spark, folder, "part")
    d = p.select(F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("prompt")).alias("info"), F.array("p_type").alias("chosen"), F.col("p_brand").alias("rejected"))
    for k in (0, 1):
        d.where(F.col("id") % 2 == k).write.mode("overwrite").parquet(f"{path}/{k}")
    r = io.read_columns(io.read_many(spark, [f"{path}/0", f"{path}/1"]), {"id": "id", "prompt": "info.prompt", "chosen": "chosen", "rejected": "rejected"})
    return r.select("id", "prompt", "chosen", "rejected")


@query("SELECT sample_id, len(messages)::INT AS n FROM sft_train_codegen WHERE messages IS NOT NULL")
def conversation_files(spark, folder):
    """Conversations written as JSON text and read as lists."""
    path, s = folder_for(spark), table(spark, folder, "sft_train_codegen").where("messages is not null")
    s.select("sample_id", F.to_json("messages").alias("messages")).write.mode("overwrite").parquet(path)
    ids = spark.read.parquet(path).select("sample_id", chat.parse_messages(F.col("messages")).alias("m"))
    if io.read_conversations(spark, [path]).count() != ids.count():
        raise ValueError("conversations are lost")
    return ids.select("sample_id", F.size("m").alias("n"))


# tools and workers


@query("SELECT event_id AS turn, (CASE WHEN value > greatest(0, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) THEN 0.0 ELSE -0.05 END)::DOUBLE AS reward FROM events")
def tool_calls(spark, folder):
    """Answers handed in to a tool, session by session."""
    from quillon.functions.extension import AnswerTool, call_tools

    e = S.ordered_within(table(spark, folder, "events"), "user_id", ["ts", "event_id"])
    calls = e.select(F.col("user_id").cast("string").alias("request"), F.col("place").alias("turn"), F.lit("answer").alias("tool"), F.concat_ws(":", F.col("value").cast("string"), F.col("event_id").cast("string")).alias("arguments"))
    r = call_tools(calls, {"answer": AnswerTool(lambda x: float(x.split(":")[0]))})
    keys = e.select(F.col("user_id").cast("string").alias("request"), F.col("place").alias("turn"), "event_id")
    return r.join(keys, ["request", "turn"]).select(F.col("event_id").alias("turn"), "reward")


@query("SELECT p_partkey, p_size * 2 AS twice FROM part")
def dispatched(spark, folder):
    """Rows dealt to workers in contiguous shares, through a function, and put together."""
    from quillon.functions.extension import Dispatch

    p = table(spark, folder, "part").select("p_partkey", "p_size")
    return Dispatch().run("contiguous", p, lambda b: b.assign(twice=b["p_size"] * 2)[["p_partkey", "twice", "worker"]], "p_partkey long, twice long, worker int", 5)


@query("WITH RECURSIVE r AS (SELECT event_id, event_id % 4 AS remaining, 0 AS k FROM events UNION ALL SELECT event_id, remaining - 1, k + 1 FROM r WHERE remaining > 0) SELECT event_id, max(k)::INT AS rounds FROM r GROUP BY ALL")
def chat_rounds(spark, folder):
    """Requests that ask again as often as their number says."""
    from quillon.functions.extension import chat_rounds

    asked = table(spark, folder, "events").select("event_id", (F.col("event_id") % 4).alias("left"))
    done = chat_rounds(asked, lambda q: q.withColumn("reply", F.lit("r")), lambda a: a.where("left > 0").select("event_id", (F.col("left") - 1).alias("left")))
    return done.groupBy("event_id").agg(F.max("round").alias("rounds"))


@query("SELECT p_partkey, [p_size, 1, 0][1:2] AS kept, [0, p_size, 1] AS joined, least(2, greatest(p_size % 7 - 1, 0))::INT AS n FROM part")
def token_joins(spark, folder):
    """Masked entries, a prompt with its response, and a response cut to what the prompt leaves."""
    size = F.col("p_size").cast("bigint")
    ids, mask = F.array(size, F.lit(1).cast("bigint"), F.lit(0).cast("bigint")), F.array(F.lit(1), F.lit(1), F.lit(0))
    prompt = F.when(F.col("p_size") % 7 == 0, F.array_repeat(F.lit(1), 7)).otherwise(F.array_repeat(F.lit(1), 8 - (F.col("p_size") % 7).cast("int")))
    cut = T.limited_request(prompt, F.array_repeat(F.lit(5), 6), 2, 7)
    joined = T.joined_response(F.array(F.lit(0).cast("bigint")), F.array(size, F.lit(1).cast("bigint")))
    return table(spark, folder, "part").select("p_partkey", T.unpadded(ids, mask).alias("kept"), joined.alias("joined"), F.size(cut).alias("n"))


@query("WITH a AS (SELECT message_id, content FROM messages WHERE lower(trim(role)) = 'assistant' AND content IS NOT NULL), c AS (SELECT message_id, regexp_extract_all(content, '(?s)```[\\s\\S]*?Input:\\n([\\s\\S]*?)\\nOutput:\\n([\\s\\S]*?)```', 1) AS i, regexp_extract_all(content, '(?s)```[\\s\\S]*?Input:\\n([\\s\\S]*?)\\nOutput:\\n([\\s\\S]*?)```', 2) AS o FROM a) SELECT message_id AS task_id, len(list_distinct(list_transform(list_zip(i, o), lambda z: [regexp_replace(z[1], '^\\s+|\\s+$', '', 'g'), regexp_replace(z[2], '^\\s+|\\s+$', '', 'g')])))::BIGINT AS n FROM c WHERE len(i) > 0")
def generated_test_tables(spark, folder):
    """Distinct tests in generated answers, each answer a task of its own."""
    m = table(spark, folder, "messages").where((F.lower(stripped("role")) == "assistant") & F.col("content").isNotNull())
    t = P.generated_tests(m.select(F.col("message_id").alias("task_id"), F.lit(0).alias("response_idx"), F.col("content").alias("response")))
    return t.groupBy("task_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 63.0 WHEN 1 THEN 0.0 ELSE 80.5 END::DOUBLE AS coverage FROM events")
def coverage_reports(spark, folder):
    r = F.when(F.col("event_id") % 3 == 0, F.lit("Name Stmts\na.py 1 90%\nTOTAL 9 4 63%")).when(F.col("event_id") % 3 == 1, F.lit("no report")).otherwise(F.lit("solution.py 10 2 80.5%\nTOTAL 40 2 95%"))
    return table(spark, folder, "events").select("event_id", M.coverage_percent(r).alias("coverage"))


@query("SELECT message_id, content || '!' AS text FROM messages WHERE content IS NOT NULL")
def outside_responder(spark, folder):
    """Texts through an outside responder that fails at first."""
    seen = []

    def respond(batch):
        if not seen:
            seen.append(1)
            raise ConnectionError("504")
        return batch.assign(text=batch["text"] + "!")

    m = table(spark, folder, "messages").where("content is not null").select("message_id", F.col("content").alias("text"))
    return io.responded(m, respond, "message_id long, text string", wait=0.0)


@query("SELECT event_id, event_type AS kind, 'user' AS role FROM events")
def extracted_code_of_pools(spark, folder):
    """Programs of fenced responses, as they enter the pools."""
    r = F.concat(F.lit("x ```python\n"), F.col("event_type"), F.lit("\n``` y"))
    return table(spark, folder, "events").select("event_id", text.python_code(r).alias("kind"), F.lit("user").alias("role"))


@query(
    """WITH s AS (SELECT task_id, solutions, input_output, unnest(range(json_array_length(solutions)::BIGINT)) AS i FROM tasks WHERE json_valid(solutions)),
    t AS (SELECT task_id, unnest(range(least(json_array_length(input_output, '$.inputs'), json_array_length(input_output, '$.outputs'))::BIGINT)) AS k FROM tasks WHERE json_valid(input_output))
    SELECT s.task_id, i::INT AS sol_idx, k::INT AS test_idx, json_extract_string(solutions, '$[' || i || ']') AS code, json_extract_string(input_output, '$.inputs[' || k || ']') AS input FROM s JOIN t USING (task_id)"""
)
def execution_requests(spark, folder):
    """Each solution against each test of its task."""
    return E.execution_requests(table(spark, folder, "tasks")).drop("expected")


@query(V + ", ok AS (SELECT task_id, test_idx FROM v WHERE sol_idx = 0 AND passed) SELECT DISTINCT task_id, sol_idx FROM v JOIN ok USING (task_id, test_idx) WHERE sol_idx <> 0 AND NOT passed")
def failing_candidates(spark, folder):
    return E.failing_candidates(verdicts_of(spark, folder))


@query(ROLLOUTS + "SELECT row_id, uid, round(score, 6) AS score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id)::INT AS rank FROM ro QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) <= 2")
def top_two(spark, folder):
    r = S.top_rows(rollouts(spark, folder), "uid", [F.desc("score"), "row_id"], 2)
    return r.select("row_id", "uid", rounded("score").alias("score"), "rank")


@query("SELECT p_partkey, 'S' AS system, 'Solve: ' || p_name || ' Go.' || CASE WHEN p_partkey % 2 = 0 THEN ' /no_think' ELSE '' END AS user FROM part")
def named_templates(spark, folder):
    t = chat.Templates().add("solve", "Solve: {problem_query}", "S", " Go.")
    p = F.when(F.col("p_partkey") % 2 == 0, t.prompt("solve", F.col("p_name"), thinking=False)).otherwise(t.prompt("solve", F.col("p_name")))
    m = table(spark, folder, "part").select("p_partkey", p.alias("m"))
    return m.select("p_partkey", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"))
