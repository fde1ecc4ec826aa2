"""Best-of-N evaluation and rewards over executions and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.columns import rounded
from quillon.operators import evaluation as E
from quillon.plans.tables import table
from quillon.registry import query

V = r"""
WITH tests AS (
  SELECT task_id, i AS test_idx, json_extract_string(input_output, '$.outputs[' || i || ']') AS expected
  FROM (SELECT task_id, input_output, unnest(range(least(json_array_length(input_output, '$.inputs'), json_array_length(input_output, '$.outputs'))::BIGINT)) AS i
        FROM tasks WHERE json_valid(input_output))
), e AS (
  SELECT DISTINCT ON (task_id, sol_idx, test_idx) * FROM executions
), v AS (
  SELECT e.task_id, sol_idx, e.test_idx, coalesce(
    CASE WHEN coalesce(lower(trim(language)), 'python') IN ('python', 'py', 'python3')
           THEN regexp_replace(stdout, '^\s+|\s+$', '', 'g') = regexp_replace(expected, '^\s+|\s+$', '', 'g') AND coalesce(stderr, '') = '' AND returncode = 0 AND stdout <> ''
         WHEN lower(trim(language)) IN ('java', 'c') THEN regexp_replace(stdout, '^\s+|\s+$', '', 'g') = regexp_replace(expected, '^\s+|\s+$', '', 'g') AND coalesce(stderr, '') = ''
         ELSE regexp_replace(stdout, '^\s+|\s+$', '', 'g') = regexp_replace(expected, '^\s+|\s+$', '', 'g') END AND NOT coalesce(timed_out, false), false) AS passed
  FROM e LEFT JOIN tests USING (task_id, test_idx)
)
"""
M = V + ", m AS (SELECT task_id, sol_idx, count(*) AS n_tests, count(*) FILTER (passed) AS n_passed, count(*) FILTER (passed)::DOUBLE / count(*) AS score FROM v GROUP BY ALL)"


def verdicts_of(spark, folder):
    return E.with_verdicts(table(spark, folder, "executions"), E.tests_from_json(table(spark, folder, "tasks")))


@query(V + "SELECT task_id, sol_idx, test_idx, passed FROM v")
def verdicts(spark, folder):
    return verdicts_of(spark, folder)


@query(M + "SELECT task_id, sol_idx, n_tests, n_passed, round(score, 6) AS score FROM m")
def bon_pass_matrix(spark, folder):
    return E.pass_matrix(verdicts_of(spark, folder)).withColumn("score", rounded("score"))


@query(
    M + """SELECT t.task_id, coalesce(b.sol_idx, 0)::INT AS best_sol_idx, round(b.score, 6) AS best_score
    FROM (SELECT DISTINCT task_id FROM tasks) t LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score DESC, sol_idx DESC) = 1) b USING (task_id)"""
)
def bon_select_last_max(spark, folder):
    candidates = table(spark, folder, "tasks").select("task_id", F.lit(0).alias("sol_idx"))
    best = E.select_best(E.pass_matrix(verdicts_of(spark, folder)), candidates)
    return best.withColumn("best_score", rounded("best_score"))


@query(
    M + """, b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score DESC, sol_idx DESC) = 1)
    SELECT count(*) AS n_tasks, round(coalesce(avg(score), 0), 6) AS avg_score, round(coalesce(avg((n_passed = n_tests)::INT), 0), 6) AS accuracy FROM b"""
)
def bon_summary(spark, folder):
    m = E.pass_matrix(verdicts_of(spark, folder))
    best = E.select_best(m).select("task_id", F.col("best_sol_idx").alias("sol_idx")).join(m, ["task_id", "sol_idx"])
    return best.agg(
        F.count("*").alias("n_tasks"), rounded(F.coalesce(F.avg("score"), F.lit(0.0))).alias("avg_score"),
        rounded(F.coalesce(F.avg((F.col("n_passed") == F.col("n_tests")).cast("int")), F.lit(0.0))).alias("accuracy"),
    )


@query(V + "SELECT task_id, min(sol_idx) AS sol_idx FROM (SELECT task_id, sol_idx FROM v GROUP BY ALL HAVING bool_and(passed)) GROUP BY ALL")
def working_solution(spark, folder):
    return E.working_solution(verdicts_of(spark, folder))


_RATES = """SELECT task_id, sol_idx, round(n_passed / (n_tests + 1e-6), 6) AS pass_rate, round(score, 6) AS gt_score, score > 0.99 AS reward_passed, score > 0.999 AS sft_passed,
  n_passed = n_tests AS all_passed, round(0.9 * (n_passed / (n_tests + 1e-6)) + 0.1, 6) AS reward FROM m"""


@query(M + _RATES)
def reward_passrate(spark, folder):
    r = E.solution_reward(E.pass_rates(verdicts_of(spark, folder)))
    return r.select("task_id", "sol_idx", *(rounded(c).alias(c) for c in ("pass_rate", "gt_score", "reward")), "reward_passed", "sft_passed", "all_passed")


@query(M.replace("FROM v GROUP BY ALL)", "FROM v WHERE test_idx < 12 GROUP BY ALL)") + _RATES)
def reward_first_tests(spark, folder):
    r = E.solution_reward(E.pass_rates(verdicts_of(spark, folder), first=E.REQUESTED_TESTS))
    return r.select("task_id", "sol_idx", *(rounded(c).alias(c) for c in ("pass_rate", "gt_score", "reward")), "reward_passed", "sft_passed", "all_passed")


def _discrimination_sql(denominator: str, f: float, d: float, v: float) -> str:
    return V + f""", texts AS (
      SELECT task_id, i AS test_idx, json_extract_string(input_output, '$.inputs[' || i || ']') AS text
      FROM (SELECT task_id, input_output, unnest(range(least(json_array_length(input_output, '$.inputs'), json_array_length(input_output, '$.outputs'))::BIGINT)) AS i FROM tasks WHERE json_valid(input_output))
    ), kept AS (SELECT task_id, min(test_idx) AS test_idx FROM texts GROUP BY task_id, text),
    t AS (SELECT d.task_id, d.test_idx, k.test_idx IS NOT NULL AS kept, g.test_idx IS NOT NULL AS valid FROM (SELECT DISTINCT task_id, test_idx FROM v) d
      LEFT JOIN kept k USING (task_id, test_idx) LEFT JOIN (SELECT task_id, test_idx FROM v WHERE sol_idx = 0 AND passed) g USING (task_id, test_idx)),
    p AS (SELECT task_id, count(*) AS n_tests, count(*) FILTER (kept) AS n_unique, count(*) FILTER (kept AND valid) AS n_valid FROM t GROUP BY ALL),
    c AS (SELECT task_id, count(DISTINCT sol_idx) AS n_candidates FROM v WHERE sol_idx <> 0 GROUP BY ALL),
    f AS (SELECT v.task_id, count(DISTINCT sol_idx) AS n_fail FROM v JOIN t USING (task_id, test_idx) WHERE kept AND valid AND sol_idx <> 0 AND NOT passed GROUP BY ALL),
    r AS (SELECT task_id, n_tests, n_unique, n_valid, coalesce(n_valid::DOUBLE / nullif(n_unique, 0), 0) AS validity_ratio, coalesce(n_valid::DOUBLE / nullif({denominator}, 0), 0) AS clipped_validity,
      coalesce(coalesce(n_fail, 0)::DOUBLE / n_candidates, 0) AS discrimination, coalesce(1.0 / nullif(n_unique, 0), 0) AS brevity, 1 - n_unique::DOUBLE / n_tests AS duplication
      FROM p LEFT JOIN c USING (task_id) LEFT JOIN f USING (task_id))
    SELECT task_id, n_tests, n_unique, n_valid, round(validity_ratio, 6) AS validity_ratio, round(clipped_validity, 6) AS clipped_validity, round(discrimination, 6) AS discrimination,
      round(brevity::DOUBLE, 6) AS brevity, round(duplication, 6) AS duplication, round({f} + {d} * discrimination + {v} * clipped_validity, 6) AS reward FROM r"""


def _discrimination(spark, folder, denominator, kind):
    tasks = table(spark, folder, "tasks")
    unique = E.tests_from_json(tasks).select("task_id", "test_idx", F.col("input").alias("text"))
    parts = E.discrimination(verdicts_of(spark, folder), denominator=denominator, unique=unique)
    r = E.discrimination_reward(parts, kind=kind)
    return r.select("task_id", "n_tests", "n_unique", "n_valid", *(rounded(c).alias(c) for c in ("validity_ratio", "clipped_validity", "discrimination", "brevity", "duplication", "reward")))


@query(_discrimination_sql("greatest(12, n_unique)", 0.1, 0.85, 0.05))
def reward_discrimination(spark, folder):
    return _discrimination(spark, folder, "requested", "full")


@query(_discrimination_sql("n_unique", 0.1, 0.85, 0.05))
def reward_discrimination_by_unique(spark, folder):
    return _discrimination(spark, folder, "unique", "full")


@query(_discrimination_sql("greatest(12, n_unique)", 0.15, 0.85, 0.0))
def reward_discrimination_no_validity(spark, folder):
    return _discrimination(spark, folder, "requested", "no_validity")


_CODES = r"""WITH e AS (SELECT DISTINCT ON (task_id, sol_idx, test_idx) * FROM executions), c AS (
  SELECT task_id, sol_idx, test_idx, CASE WHEN coalesce(timed_out, false) THEN -3 WHEN coalesce(regexp_matches(stderr, 'SyntaxError|IndentationError|CompileError|error:'), false) THEN -4
    WHEN returncode IS NULL THEN -1 WHEN returncode <> 0 THEN -2 ELSE 1 END AS code FROM e)
"""


@query(
    _CODES + """, f AS (SELECT task_id, sol_idx, min(test_idx) AS first FROM c WHERE code = -4 GROUP BY ALL)
    SELECT task_id, sol_idx, test_idx, (CASE WHEN test_idx > first THEN -4 ELSE code END)::INT AS code FROM c LEFT JOIN f USING (task_id, sol_idx)"""
)
def compile_error_propagation(spark, folder):
    return E.propagate_compile_errors(E.status_codes(table(spark, folder, "executions")))


@query(
    V + """SELECT task_id, sol_idx, round(CASE WHEN bool_and(passed) THEN 1.0 ELSE coalesce(count(*) FILTER (passed AND test_idx < 10)::DOUBLE / nullif(count(*) FILTER (test_idx < 10), 0), 0) END, 6) AS score
    FROM v GROUP BY ALL"""
)
def continuous_score(spark, folder):
    return E.continuous_score(verdicts_of(spark, folder)).withColumn("score", rounded("score"))


@query(
    V + """, s AS (SELECT task_id, sol_idx, avg(passed::INT) FILTER (test_idx % 2 = 0) AS x, avg(passed::INT) FILTER (test_idx % 2 = 1) AS y FROM v GROUP BY ALL),
    k AS (SELECT * FROM s WHERE x IS NOT NULL AND y IS NOT NULL),
    r AS (SELECT task_id, rank() OVER (PARTITION BY task_id ORDER BY x) + (count(*) OVER (PARTITION BY task_id, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY task_id ORDER BY y) + (count(*) OVER (PARTITION BY task_id, y) - 1) / 2.0 AS ry FROM k)
    SELECT task_id, round(coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0), 6) AS fidelity FROM r GROUP BY ALL"""
)
def ut_fidelity(spark, folder):
    """Do the tests at even places rank the candidates as those at odd places do?"""
    even, odd = F.col("test_idx") % 2 == 0, F.col("test_idx") % 2 == 1
    passed = F.col("passed").cast("int")
    s = verdicts_of(spark, folder).groupBy("task_id", "sol_idx").agg(F.avg(F.when(even, passed)).alias("x"), F.avg(F.when(odd, passed)).alias("y"))
    r = E.rank_fidelity(s.where("x is not null and y is not null"), ["task_id"], "x", "y")
    return r.withColumn("fidelity", rounded("fidelity"))


@query(
    V + """, m AS (SELECT task_id, avg(passed::INT) AS a FROM v GROUP BY ALL)
    SELECT coalesce(source, '') AS data_source, round(avg(a), 6) AS test_score, count(*) AS n FROM m JOIN (SELECT DISTINCT task_id, source FROM tasks) USING (task_id) GROUP BY ALL"""
)
def eval_mean_of_means(spark, folder):
    """Mean over tasks of the mean over their responses, for each source."""
    means = verdicts_of(spark, folder).groupBy("task_id").agg(F.avg(F.col("passed").cast("int")).alias("a"))
    source = table(spark, folder, "tasks").select("task_id", F.coalesce("source", F.lit("")).alias("data_source")).distinct()
    return means.join(source, "task_id").groupBy("data_source").agg(rounded(F.avg("a")).alias("test_score"), F.count("*").alias("n"))


@query(
    V + r""", o AS (SELECT e.task_id, e.sol_idx, e.test_idx, regexp_replace(stdout, '^\s+|\s+$', '', 'g') AS a, regexp_replace(expected, '^\s+|\s+$', '', 'g') AS b FROM e JOIN tests USING (task_id, test_idx)),
    p AS (SELECT *, list_filter(string_split_regex(a, '\s+'), lambda x: x <> '') AS ta, list_filter(string_split_regex(b, '\s+'), lambda x: x <> '') AS tb,
      list_filter(list_transform(string_split(a, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS la,
      list_filter(list_transform(string_split(b, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lb FROM o)
    SELECT task_id, sol_idx, test_idx, coalesce(a = b OR la = lb OR (
      NOT coalesce(list_bool_and(list_transform(list_concat(ta, tb), lambda x: regexp_matches(x, '^[+-]?\d+$'))), true) AND len(ta) = len(tb) AND len(tb) > 0
      AND list_bool_and(list_transform(list_zip(ta, tb), lambda z: coalesce(abs(try_cast(z[1] AS DOUBLE) - try_cast(z[2] AS DOUBLE)) <= 1e-8 + 1e-5 * abs(try_cast(z[2] AS DOUBLE)), false)))), false) AS matches FROM p"""
)
def output_comparators(spark, folder):
    e = table(spark, folder, "executions").dropDuplicates(["task_id", "sol_idx", "test_idx"])
    t = E.tests_from_json(table(spark, folder, "tasks"))
    return e.join(t, ["task_id", "test_idx"]).select("task_id", "sol_idx", "test_idx", E.outputs_match("stdout", "expected").alias("matches"))


_MADE = "Write tests.\n{problem_query}"


@query(
    """WITH t AS (SELECT task_id, question, solutions FROM tasks WHERE json_valid(input_output) AND NOT list_contains(json_keys(input_output), 'fn_name') AND json_valid(solutions) AND json_array_length(solutions) > 0)
    SELECT task_id, 'Write tests.' || chr(10) || question AS user, least(8, json_array_length(solutions))::INT AS n_candidates,
    CASE WHEN row_number() OVER (ORDER BY md5('42:' || task_id), task_id) <= 50 THEN 'test' ELSE 'train' END AS split FROM t"""
)
def pipeline_test_generation(spark, folder):
    from quillon.plans.pipelines import test_generation_rows

    r = test_generation_rows(table(spark, folder, "tasks"), _MADE, "You write tests.", test_size=50)
    return r.select("task_id", F.element_at("prompt", 2)["content"].alias("user"), F.size("candidates").alias("n_candidates"), "split")


@query(
    """WITH t AS (SELECT task_id, question, least(json_array_length(input_output, '$.inputs'), json_array_length(input_output, '$.outputs'))::INT AS n FROM tasks WHERE json_valid(input_output) AND NOT list_contains(json_keys(input_output), 'fn_name'))
    SELECT task_id, n AS n_tests, CASE WHEN row_number() OVER (ORDER BY md5('42:' || task_id), task_id) <= 50 THEN 'test' ELSE 'train' END AS split FROM t WHERE n > 0"""
)
def pipeline_code_generation(spark, folder):
    from quillon.plans.pipelines import code_generation_rows

    r = code_generation_rows(table(spark, folder, "tasks"), _MADE, "You write code.", test_size=50)
    return r.select("task_id", F.size("gt_tests").alias("n_tests"), "split")
