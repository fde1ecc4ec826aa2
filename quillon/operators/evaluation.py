"""Candidates against tests: verdicts, scores, selection and rewards over recorded executions. Nothing is executed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import stripped
from quillon.plans.staging import stage

# Weights of the rewards and thresholds of "all tests passed".
PASS_EPS = 1e-6
REWARD_GATE, SFT_GATE = 0.99, 0.999
REQUESTED_TESTS = 12
FORMAT_WEIGHT = 0.1


def tests_from_json(tasks: DataFrame, json_col: str = "input_output") -> DataFrame:
    """(task_id, test_idx, input, expected): inputs and outputs paired by position up to the shorter list.

    A missing or unreadable document gives no rows.
    """
    doc = F.from_json(json_col, "struct<inputs:array<string>,outputs:array<string>>")
    pairs = tasks.select("task_id", doc.alias("d")).select("task_id", F.arrays_zip("d.inputs", "d.outputs").alias("z"), F.least(F.size("d.inputs"), F.size("d.outputs")).alias("n"))
    rows = pairs.where("n > 0").select("task_id", F.posexplode(F.slice("z", F.lit(1), F.col("n"))).alias("test_idx", "t"))
    return rows.select("task_id", "test_idx", F.col("t.inputs").alias("input"), F.col("t.outputs").alias("expected"))


def execution_requests(tasks: DataFrame, solutions: str = "solutions", tests: str = "input_output") -> DataFrame:
    """(task_id, sol_idx, test_idx, code, input, expected): each solution of a task against each of its tests, for an
    executor outside. Tasks without readable solutions or tests give no rows."""
    s = tasks.select("task_id", F.posexplode(F.from_json(solutions, "array<string>")).alias("sol_idx", "code"))
    return s.join(tests_from_json(tasks, tests), "task_id").select("task_id", "sol_idx", "test_idx", "code", "input", "expected")


def failing_candidates(verdicts: DataFrame, reference: int = 0) -> DataFrame:
    """(task_id, sol_idx): the candidates that fail some test that the reference passes."""
    return on_valid_tests(verdicts, reference).where((F.col("sol_idx") != reference) & ~F.col("passed")).select("task_id", "sol_idx").distinct()


def with_verdicts(executions: DataFrame, tests: DataFrame) -> DataFrame:
    """(task_id, sol_idx, test_idx, passed): the rule depends on the language (missing: Python).

    Output must equal what is expected but for outer white space. Python also wants an empty error stream, return code 0
    and some output; Java and C an empty error stream; C++ nothing else. A timeout, a missing output or a test without
    an expected output fails; a missing error stream counts as empty. A row repeated as a whole counts once.
    """
    key = ["task_id", "sol_idx", "test_idx"]
    # outputs are long: they are shuffled once, to the expected output; repeated rows are dropped from the verdicts
    rows = executions.join(tests.select("task_id", "test_idx", "expected"), ["task_id", "test_idx"], "left")
    lang = F.coalesce(F.lower(stripped("language")), F.lit("python"))
    equal = stripped("stdout") == stripped("expected")
    quiet = F.coalesce("stderr", F.lit("")) == ""
    rule = F.when(lang.isin("python", "py", "python3"), equal & quiet & (F.col("returncode") == 0) & (F.col("stdout") != ""))
    rule = rule.when(lang.isin("java", "c"), equal & quiet).otherwise(equal)
    passed = F.coalesce(rule & ~F.coalesce("timed_out", F.lit(False)), F.lit(False))
    return rows.groupBy(*key).agg(F.bool_or(passed).alias("passed"))


def assertion_verdicts(executions: DataFrame, mark: str = "PASS") -> DataFrame:
    """(task_id, sol_idx, test_idx, passed) of runs that print the mark once their assertions hold."""
    passed = F.coalesce(F.col("stdout").contains(mark) & ~F.coalesce("timed_out", F.lit(False)), F.lit(False))
    return executions.groupBy("task_id", "sol_idx", "test_idx").agg(F.bool_or(passed).alias("passed"))


def pass_matrix(verdicts: DataFrame) -> DataFrame:
    """(task_id, sol_idx, n_tests, n_passed, score): score without an epsilon."""
    agg = verdicts.groupBy("task_id", "sol_idx").agg(F.count("*").alias("n_tests"), F.count_if("passed").alias("n_passed"))
    return agg.withColumn("score", F.try_divide(F.col("n_passed").cast("double"), F.col("n_tests")))


def select_best(scores: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(task_id, best_sol_idx, best_score): of the candidates with the highest score the last one.

    With candidates (task_id, sol_idx), tasks without any score get their first candidate and a NULL score.
    """
    # max of a struct keeps one row for each task and combines before the shuffle; no window sorts a task's candidates
    best = scores.groupBy("task_id").agg(F.max(F.struct("score", "sol_idx")).alias("b")).select("task_id", F.col("b.sol_idx").alias("best_sol_idx"), F.col("b.score").alias("best_score"))
    if candidates is None:
        return best
    first = candidates.groupBy("task_id").agg(F.min("sol_idx").alias("first"))
    return first.join(best, "task_id", "left").select("task_id", F.coalesce("best_sol_idx", "first").alias("best_sol_idx"), "best_score")


def pass_rates(verdicts: DataFrame, first: int | None = None) -> DataFrame:
    """(task_id, sol_idx, pass_rate, gt_score, reward_passed, sft_passed, all_passed), optionally over the first tests.

    The three flags are different gates on purpose: above 0.99, above 0.999, and every single test.
    """
    rows = verdicts if first is None else verdicts.where(F.col("test_idx") < first)
    m = pass_matrix(rows)
    rate = F.col("n_passed") / (F.col("n_tests") + PASS_EPS)
    return m.select(
        "task_id", "sol_idx", rate.alias("pass_rate"), F.col("score").alias("gt_score"), (F.col("score") > REWARD_GATE).alias("reward_passed"),
        (F.col("score") > SFT_GATE).alias("sft_passed"), (F.col("n_passed") == F.col("n_tests")).alias("all_passed"),
    )


def working_solution(verdicts: DataFrame) -> DataFrame:
    """(task_id, sol_idx): each task's first candidate that passes all of its tests; other tasks are dropped."""
    ok = verdicts.groupBy("task_id", "sol_idx").agg(F.bool_and("passed").alias("ok")).where("ok")
    return ok.groupBy("task_id").agg(F.min("sol_idx").alias("sol_idx"))


def discrimination(
    verdicts: DataFrame, reference: int = 0, *, denominator: str = "requested", unique: DataFrame | None = None, over: str = "unique", pools: str | None = None
) -> DataFrame:
    """Reward parts of a task's tests, judged by the reference solution and the other candidates.

    (task_id, n_tests, n_unique, n_valid, validity_ratio, clipped_validity, discrimination, brevity, duplication).
    A test is valid if the reference passes it. discrimination is the share of candidates that fail a valid test, 0
    without valid tests. clipped_validity divides by at least the requested number of tests, or by the unique ones.
    unique (task_id, test_idx, text) says which tests are repeats; without it each is unique. over says of which tests
    validity_ratio and brevity are shares: the unique ones, or all. With pools, a column of the verdicts that says from
    which round of training a candidate is, there is also discrimination_{pool} for each, by the candidates of that pool;
    discrimination is that of all.
    """
    v = stage(verdicts, "verdicts")  # a few numbers a row, read several times
    tests = v.groupBy("task_id", "test_idx").agg(F.bool_or((F.col("sol_idx") == reference) & F.col("passed")).alias("valid"))
    if unique is not None:
        kept = unique.groupBy("task_id", "text").agg(F.min("test_idx").alias("test_idx")).select("task_id", "test_idx", F.lit(True).alias("kept"))
        tests = tests.join(kept, ["task_id", "test_idx"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    else:
        tests = tests.withColumn("kept", F.lit(True))
    per_task = tests.groupBy("task_id").agg(
        F.count("*").alias("n_tests"), F.count_if("kept").alias("n_unique"), F.count_if(F.col("kept") & F.col("valid")).alias("n_valid"),
    )
    names = [r[0] for r in v.select(pools).where(F.col(pools).isNotNull()).distinct().orderBy(pools).collect()] if pools else []  # rounds of training: a few
    fails = F.bool_or(F.col("kept") & F.col("valid") & ~F.col("passed"))
    by = v.where(F.col("sol_idx") != reference).join(tests, ["task_id", "test_idx"]).groupBy("task_id", "sol_idx", *([pools] if pools else [])).agg(fails.alias("fails"))
    share = lambda of: F.try_divide(F.count_if(F.col("fails") & of).cast("double"), F.count_if(of))
    judged = by.groupBy("task_id").agg(share(F.lit(True)).alias("_d"), *(share(F.col(pools) == p).alias(f"_d_{p}") for p in names))
    below = F.greatest(F.lit(REQUESTED_TESTS), F.col("n_unique")) if denominator == "requested" else F.col("n_unique")
    rows = per_task.join(judged, "task_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    of = F.col("n_unique") if over == "unique" else F.col("n_tests")
    return rows.select(
        "task_id", "n_tests", "n_unique", "n_valid", zero(F.try_divide(F.col("n_valid").cast("double"), of)).alias("validity_ratio"),
        zero(F.try_divide(F.col("n_valid").cast("double"), below)).alias("clipped_validity"), zero(F.col("_d")).alias("discrimination"),
        *(zero(F.col(f"_d_{p}")).alias(f"discrimination_{p}") for p in names),
        zero(F.try_divide(F.lit(1.0), of)).alias("brevity"), (1 - F.col("n_unique") / F.col("n_tests")).alias("duplication"),
    )


# Fixed values: (format, discrimination, validity) weights.
DISCRIMINATION_WEIGHTS = {"full": (0.1, 0.85, 0.05), "no_validity": (0.15, 0.85, 0.0)}


def discrimination_reward(parts: DataFrame, formatted: str | float = 1.0, kind: str = "full") -> DataFrame:
    """parts with the column reward; formatted is a column name or a constant."""
    f, d, v = DISCRIMINATION_WEIGHTS[kind]
    fmt = F.col(formatted) if isinstance(formatted, str) else F.lit(formatted)
    return parts.withColumn("reward", f * fmt + d * F.col("discrimination") + v * F.col("clipped_validity"))


def solution_reward(rates: DataFrame, formatted: str | float = 1.0) -> DataFrame:
    """rates with reward = 0.9 pass rate + 0.1 formatting."""
    fmt = F.col(formatted) if isinstance(formatted, str) else F.lit(formatted)
    return rates.withColumn("reward", (1 - FORMAT_WEIGHT) * F.col("pass_rate") + FORMAT_WEIGHT * fmt)


def on_valid_tests(verdicts: DataFrame, reference: int = 0) -> DataFrame:
    """The verdicts on the tests that the reference solution passes."""
    valid = verdicts.where((F.col("sol_idx") == reference) & F.col("passed")).select("task_id", "test_idx").distinct()
    return verdicts.join(valid, ["task_id", "test_idx"], "left_semi")


def code_reward(generated: DataFrame, formatted: DataFrame, truth: DataFrame | None = None, reference: int = 0, first: int | None = None) -> DataFrame:
    """(task_id, sol_idx, pass_rate, formatted, reward[, gt_score, gt_passed]) of generated programs.

    pass_rate is over the generated tests that the reference passes, or over the first tests; formatted (task_id, sol_idx,
    formatted) says how well formed each response is; truth, verdicts over the task's own tests, adds the true score.
    """
    rates = pass_rates(on_valid_tests(generated, reference) if first is None else generated, first)
    every = generated.select("task_id", "sol_idx").distinct().join(rates.select("task_id", "sol_idx", "pass_rate"), ["task_id", "sol_idx"], "left")
    r = every.join(formatted, ["task_id", "sol_idx"], "left").select("task_id", "sol_idx", F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"), F.coalesce(F.col("formatted").cast("double"), F.lit(0.0)).alias("formatted"))
    r = solution_reward(r, "formatted")
    if truth is None:
        return r
    gold = pass_rates(truth).select("task_id", "sol_idx", "gt_score", F.col("reward_passed").alias("gt_passed"))
    return r.join(gold, ["task_id", "sol_idx"], "left")


def status_codes(executions: DataFrame) -> DataFrame:
    """(task_id, sol_idx, test_idx, code): 1 fine, -2 runtime error, -3 timeout, -4 compile error, -1 unknown."""
    compile_error = F.coalesce(F.col("stderr").rlike("SyntaxError|IndentationError|CompileError|error:"), F.lit(False))
    code = F.when(F.coalesce("timed_out", F.lit(False)), -3).when(compile_error, -4).when(F.col("returncode").isNull(), -1).when(F.col("returncode") != 0, -2).otherwise(1)
    return executions.dropDuplicates(["task_id", "sol_idx", "test_idx"]).select("task_id", "sol_idx", "test_idx", code.cast("int").alias("code"))


def propagate_compile_errors(codes: DataFrame) -> DataFrame:
    """All tests of a candidate after its first compile error get its code."""
    first = codes.where("code = -4").groupBy("task_id", "sol_idx").agg(F.min("test_idx").alias("first"))
    return codes.join(first, ["task_id", "sol_idx"], "left").select("task_id", "sol_idx", "test_idx", F.when(F.col("test_idx") > F.col("first"), F.lit(-4)).otherwise(F.col("code")).alias("code"))


def continuous_score(verdicts: DataFrame, first: int = 10) -> DataFrame:
    """(task_id, sol_idx, score): 1 if every test passes, else the share passed of the first tests."""
    head = F.col("test_idx") < first
    agg = verdicts.groupBy("task_id", "sol_idx").agg(F.bool_and("passed").alias("all"), F.count_if(head & F.col("passed")).alias("p"), F.count_if(head).alias("n"))
    return agg.select("task_id", "sol_idx", F.when(F.col("all"), 1.0).otherwise(F.coalesce(F.try_divide(F.col("p").cast("double"), F.col("n")), F.lit(0.0))).alias("score"))


def average_ranks(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """df with the average rank of value inside its group."""
    w = Window.partitionBy(*groups)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*groups, value)) - 1) / F.lit(2.0))


def rank_fidelity(scores: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """(groups, fidelity): Spearman's correlation of x and y; 0 where a side is constant or there is one row."""
    r = average_ranks(average_ranks(scores, groups, x, "_rx"), groups, y, "_ry")
    # no corr(): over a constant column it divides by zero
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    return r.groupBy(*groups).agg(F.coalesce(rho, F.lit(0.0)).alias("fidelity"))


def outputs_match(actual, expected):
    """Whether two outputs agree: as text, line by line, without blank lines, or as numbers.

    Numbers agree within 1e-8 + 1e-5 |expected|, unless all of them are written as integers.
    """
    lines = lambda c: F.transform(F.split(stripped(c), "\n"), lambda x: stripped(x))
    solid = lambda c: F.filter(lines(c), lambda x: x != "")
    tokens = lambda c: F.filter(F.split(stripped(c), r"\s+"), lambda x: x != "")
    numbers = lambda c: F.transform(tokens(c), lambda x: x.try_cast("double"))
    whole = F.forall(F.concat(tokens(actual), tokens(expected)), lambda x: x.rlike(r"^[+-]?\d+$"))
    close = F.forall(F.zip_with(numbers(actual), numbers(expected), lambda a, b: F.coalesce(F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b), F.lit(False))), lambda ok: ok)
    by_value = ~whole & (F.size(tokens(actual)) == F.size(tokens(expected))) & (F.size(tokens(expected)) > 0) & close
    return F.coalesce((stripped(actual) == stripped(expected)) | (lines(actual) == lines(expected)) | (solid(actual) == solid(expected)) | by_value, F.lit(False))
