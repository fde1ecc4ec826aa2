"""Whole preparations and evaluations, put together from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import chat, text
from quillon.functions.answers import boxed_udf
from quillon.operators import advantage as A
from quillon.operators import evaluation as E
from quillon.operators import losses as L
from quillon.operators import metrics as M
from quillon.operators.sampling import accumulate_groups, banded_groups, downsample_groups, exact_split, informative_groups, sample_elements
from quillon.plans.staging import stage
from quillon.sources.io import generation_options, missing, write_generations, write_results


def standard_io(tasks: DataFrame, document: str = "input_output") -> DataFrame:
    """Tasks that read standard input: readable test documents without the key fn_name."""
    return tasks.where(F.json_object_keys(document).isNotNull() & ~F.coalesce(text.has_key(F.col(document), "fn_name"), F.lit(False)))


def test_generation_rows(tasks: DataFrame, template: str, system: str, candidates: int = 8, test_size: int = 1000, seed: int = 42) -> DataFrame:
    """(task_id, prompt, gt_solution, candidates, split): rows for training a generator of tests.

    One solution of each task is the reference, up to `candidates` more are to be told apart; tasks without a readable
    solution are dropped; test_size rows go to the test split.
    """
    s = standard_io(tasks).select("task_id", "question", F.from_json("solutions", "array<string>").alias("s")).where("size(s) > 0")
    rows = s.select(
        "task_id", chat.prompt(template, F.col("question"), system).alias("prompt"), F.get(sample_elements(F.col("s"), F.col("task_id"), 1, seed), F.lit(0)).alias("gt_solution"),
        sample_elements(F.col("s"), F.col("task_id"), candidates, seed + 1).alias("candidates"),
    )
    return exact_split(rows.where("gt_solution is not null"), "task_id", test_size, seed)


def code_generation_rows(tasks: DataFrame, template: str, system: str, tests: DataFrame | None = None, test_size: int = 1000, seed: int = 42) -> DataFrame:
    """(task_id, prompt, gt_tests, split): rows for training a generator of code, with the tasks' own tests or with
    those of tests (task_id, response), read from generated text."""
    t = standard_io(tasks)
    if tests is None:
        g = E.tests_from_json(t).groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("test_idx", "input", "expected"))).alias("g"))
    else:
        found = text.distinct_cases(text.test_cases(F.col("response")))
        g = tests.select("task_id", F.transform(found, lambda x, i: F.struct(i.alias("test_idx"), x["input"].alias("input"), x["output"].alias("expected"))).alias("g"))
    rows = t.join(g.where("size(g) > 0"), "task_id").select("task_id", chat.prompt(template, F.col("question"), system).alias("prompt"), F.col("g").alias("gt_tests"))
    return exact_split(rows, "task_id", test_size, seed)


def adversarial_rows(tasks: DataFrame, pools: dict[str, DataFrame], template: str, system: str, candidates: int = 8, test_size: int = 1000, seed: int = 42) -> DataFrame:
    """(task_id, prompt, gt_solution, candidates, split): rows for the second round of training a generator of tests.

    pools (task_id, responses: array of texts) are the programs of each round; candidates is a map from the pool's name to
    up to `candidates` of its programs. A task needs programs in every pool and a readable solution.
    """
    s = standard_io(tasks).select("task_id", "question", F.from_json("solutions", "array<string>").alias("s")).where("size(s) > 0")
    drawn = []
    for k, (name, pool) in enumerate(sorted(pools.items())):
        programs = F.transform("responses", lambda r: text.python_code(r))
        s = s.join(pool.select("task_id", sample_elements(programs, F.col("task_id"), candidates, seed + 1 + k).alias(f"_p{k}")), "task_id")
        drawn += [F.lit(name), F.col(f"_p{k}")]
    one = F.get(sample_elements(F.col("s"), F.col("task_id"), 1, seed), F.lit(0))
    rows = s.select("task_id", chat.prompt(template, F.col("question"), system).alias("prompt"), one.alias("gt_solution"), F.create_map(*drawn).alias("candidates"))
    return exact_split(rows.where("gt_solution is not null"), "task_id", test_size, seed)


def working_rows(tasks: DataFrame, verdicts: DataFrame, responses: DataFrame, template: str, candidates: int = 8, seed: int = 42) -> DataFrame:
    """(task_id, prompt, gt_solution, candidates): tasks of which some listed solution passes all tests, with the first
    such; verdicts are over the listed solutions, responses (task_id, responses) hold the programs to be told apart."""
    found = E.working_solution(verdicts)
    s = tasks.select("task_id", "question", F.from_json("solutions", "array<string>").alias("s")).join(found, "task_id")
    programs = F.transform("responses", lambda r: text.python_code(r))
    drawn = responses.select("task_id", sample_elements(programs, F.col("task_id"), candidates, seed).alias("candidates"))
    return s.join(drawn, "task_id").select("task_id", chat.prompt(template, F.col("question")).alias("prompt"), F.get("s", F.col("sol_idx")).alias("gt_solution"), "candidates")


def generated_tests(responses: DataFrame, form: str = "fenced") -> DataFrame:
    """(task_id, test_idx, input, expected) of responses (task_id, response_idx, response): all fenced cases of a response
    of the form fenced, the one case of a labelled one; distinct, in the order of the responses."""
    if form == "fenced":
        cases = responses.select("task_id", "response_idx", F.posexplode(text.test_cases(F.col("response"))).alias("k", "c"))
    elif form == "labelled":
        cases = responses.select("task_id", "response_idx", F.lit(0).alias("k"), text.labelled_case(F.col("response")).alias("c")).where("c.input <> '' or c.output <> ''")
    else:
        raise ValueError(f"unknown form {form!r}")
    first = cases.groupBy("task_id", F.col("c.input").alias("input"), F.col("c.output").alias("expected")).agg(F.min(F.struct("response_idx", "k")).alias("at"))
    g = first.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("at", "input", "expected"))).alias("g"))  # a task's tests
    return g.select("task_id", F.posexplode("g").alias("test_idx", "x")).select("task_id", "test_idx", "x.input", "x.expected")


def solution_evaluation(executions: DataFrame, tests: DataFrame, sol_idx: int = 0) -> DataFrame:
    """(task_id, n_tests, n_passed, score, passed) of one solution of each task; tasks without runs are left out."""
    m = E.pass_matrix(E.with_verdicts(executions.where(F.col("sol_idx") == sol_idx), tests))
    return m.select("task_id", "n_tests", "n_passed", "score", (F.col("n_passed") == F.col("n_tests")).alias("passed"))


def best_of_n(measured: DataFrame, truth: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(task_id, best_sol_idx, best_score, n_passed, n_tests, passed): the candidate that does best on the tests of
    measured, and how it does on those of truth (the same, if there is none).

    Both are verdicts (task_id, sol_idx, test_idx, passed): of generated tests and of the task's own. With candidates
    (task_id, sol_idx), tasks without measured tests get their first.
    """
    best = E.select_best(E.pass_matrix(measured), candidates)
    gold = E.pass_matrix(measured if truth is None else truth).select("task_id", F.col("sol_idx").alias("best_sol_idx"), "n_passed", "n_tests")
    return best.join(gold, ["task_id", "best_sol_idx"], "left").withColumn("passed", F.coalesce(F.col("n_passed") == F.col("n_tests"), F.lit(False)))


def evaluation_summary(best: DataFrame) -> DataFrame:
    """One row (n_tasks, avg_score, accuracy): 0 where there are no tasks."""
    share = F.try_divide(F.col("n_passed").cast("double"), F.col("n_tests"))
    return best.agg(F.count("*").alias("n_tasks"), F.coalesce(F.avg(F.coalesce(share, F.lit(0.0))), F.lit(0.0)).alias("avg_score"), F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("accuracy"))


def test_fidelity(generated: DataFrame, truth: DataFrame) -> DataFrame:
    """(task_id, fidelity): rank correlation of the candidates' scores by generated tests with those by the true ones,
    over the candidates of all models together. Both are (task_id, model, sol_idx, score); they must hold the same
    candidates."""
    keys = ["task_id", "model", "sol_idx"]
    g = generated.select(*keys, F.col("score").alias("x"), F.lit(1).alias("_g"))
    t = truth.select(*keys, F.col("score").alias("y"), F.lit(1).alias("_t"))
    both = g.join(t, keys, "full_outer")
    ok = F.when(F.col("_g").isNull() | F.col("_t").isNull(), F.raise_error(F.lit("scores of different candidates"))).otherwise(F.lit(True))
    return E.rank_fidelity(both.where(ok), ["task_id"], "x", "y")


def generation_requests(tasks: DataFrame, cached: DataFrame, template: str, system: str | None = None, suffix: str = "", n: int = 1) -> DataFrame:
    """(task_id, response_idx, prompt, temperature): the requests for n responses of each task without a cached one."""
    wanted = missing(tasks.select("task_id", "question"), cached, "task_id").withColumn("response_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return wanted.select("task_id", "response_idx", chat.prompt(template, F.col("question"), system, suffix).alias("prompt"), F.lit(generation_options(n)["temperature"]).alias("temperature"))


def offline_generation(prompts: DataFrame, respond, n: int) -> DataFrame:
    """prompts (row_id, prompt, …) with responses, an array of n: respond(requests) gives (row_id, response_idx, response)
    for requests (row_id, response_idx, prompt); a missing response is an error."""
    asked = prompts.select("row_id", "prompt").withColumn("response_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    g = respond(asked).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("response_idx", "response"))).alias("_r"))
    full = F.when(F.coalesce(F.size("_r"), F.lit(0)) != n, F.raise_error(F.lit("responses are missing"))).otherwise(F.lit(True))
    return prompts.join(g, "row_id", "left").where(full).withColumn("responses", F.transform("_r", lambda x: x["response"])).drop("_r")


def offline_evaluation(scored: DataFrame, source: str, row: str, score: str) -> DataFrame:
    """(source, test_score): the mean over rows of the mean over a row's responses."""
    return scored.groupBy(source, row).agg(F.avg(score).alias("_m")).groupBy(source).agg(F.avg("_m").alias("test_score"))


def corpus_rows(df: DataFrame, question: Column, truth: Column, source: str, ability: str, split: str, id: str, extra: dict[str, Column] | None = None, template: str = "{problem_query}", system: str | None = None) -> DataFrame:
    """Rows of the general training layout from a table of questions and true answers; rows without either are left out."""
    info = F.struct(F.lit(split).alias("split"), F.col(id).cast("long").alias("index"), *(c.alias(k) for k, c in (extra or {}).items()))
    rows = df.select(
        F.lit(source).alias("data_source"), chat.prompt(template, question, system).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), info.alias("extra_info"),
    )
    return rows.where("reward_model.ground_truth is not null and prompt[0].content is not null")


def numbered_answers(df: DataFrame, source: str, split: str, id: str = "id", instruction: str = "") -> DataFrame:
    """Corpus rows of (id, question, answer) whose answer ends in #### and a number; question and answer are kept."""
    q = F.concat(F.col("question"), F.lit(instruction))
    return corpus_rows(df, q, text.hash_answer(F.col("answer")), source, "math", split, id, {"answer": F.col("answer"), "question": F.col("question")})


def boxed_answers(df: DataFrame, source: str, split: str, id: str = "id", instruction: str = "") -> DataFrame:
    """Corpus rows of (id, problem, solution) whose solution has its answer in a box."""
    return corpus_rows(df, F.concat(F.col("problem"), F.lit(instruction)), boxed_udf("solution"), source, "math", split, id)


def choice_rows(df: DataFrame, source: str, split: str, id: str = "id", seed: int = 42) -> DataFrame:
    """Corpus rows of (id, question, gold, others: array of three): a multiple choice with the gold one at a drawn place."""
    c = chat.shuffled_choice(F.col("question"), F.col("gold"), [F.get("others", F.lit(k)) for k in range(3)], F.col(id), seed)
    d = df.withColumn("_c", c)
    return corpus_rows(d, F.col("_c.prompt"), F.col("_c.letter"), source, "multiple choice", split, id)


def ending_rows(df: DataFrame, source: str, split: str, id: str = "id") -> DataFrame:
    """Corpus rows of (id, activity, ctx_a, ctx_b, endings, label): which ending goes on; rows without a label are left out."""
    begun = F.concat(F.col("activity"), F.lit(": "), F.col("ctx_a"), F.lit(" "), text.capitalized(F.col("ctx_b")))
    d = df.where(F.length("label") > 0)
    return corpus_rows(d, text.cleaned_option(begun), F.col("label"), source, "continuation", split, id, {"endings": F.transform("endings", text.cleaned_option)})


def contest_rows(df: DataFrame, source: str, split: str, start: str, end: str, id: str = "id", template: str = "{problem_query}") -> DataFrame:
    """Corpus rows of programming contests (id, question, contest_date, public_tests, private_tests, function): those
    with start <= contest_date < end as texts, which need be no dates; the truth is JSON of all tests, public ones first."""
    tests = lambda c: F.coalesce(F.from_json(c, "array<struct<input:string,output:string>>"), F.array().cast("array<struct<input:string,output:string>>"))
    d = df.where((F.col("contest_date") >= start) & (F.col("contest_date") < end)).withColumn("_t", F.concat(tests("public_tests"), tests("private_tests")))
    doc = F.to_json(F.struct(F.transform("_t", lambda t: t["input"]).alias("inputs"), F.transform("_t", lambda t: t["output"]).alias("outputs"), F.col("function").alias("fn_name")))
    return corpus_rows(d, F.col("question"), doc, source, "code", split, id, template=template)


def stacked_preferences(df: DataFrame) -> DataFrame:
    """(prompt, response): two rows for each (prompt, chosen, rejected), for supervised training."""
    return df.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


def tool_rows(rows: DataFrame, tool: str = "code_interpreter") -> DataFrame:
    """Corpus rows with the truth among the arguments that the tool is made with."""
    return rows.withColumn("extra_info", chat.with_tool_arguments(F.col("extra_info"), F.col("reward_model.ground_truth"), tool))


def validation_pass(scored: DataFrame, source: str, prompt: str, order: str, variables: list[str], vote: str | None = None, dump: tuple[str, int] | None = None) -> DataFrame:
    """(name, value): the metrics of scored responses, named section/source/variable/metric; with dump (folder, step) the
    responses are written too."""
    if dump:
        write_generations(scored, *dump)
    m = M.core_or_auxiliary(M.validation_metrics(scored, source, prompt, order, variables, vote), "variable", "metric")
    return m.select(F.concat_ws("/", "section", "data_source", "variable", "metric").alias("name"), "value")


def sft_validation(samples: DataFrame, verdicts: DataFrame, epoch: int, folder: str | None = None) -> DataFrame:
    """(name, value): the mean pass rate and share passed of the answers to samples (example_id, task_id, prediction), by
    verdicts over the task's tests for candidate example_id; answers without runs count as failed."""
    rates = E.pass_rates(verdicts).select("task_id", F.col("sol_idx").alias("example_id"), "pass_rate", "gt_score")
    r = samples.join(rates, ["task_id", "example_id"], "left").select("example_id", "prediction", F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"))
    r = r.withColumn("passed", (F.col("pass_rate") > E.SFT_GATE).cast("int"))
    long = r.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("pass_rate", "passed")))).alias("x")).select("x.*")
    metrics = M.merged_average(long)
    if folder:
        write_results(metrics, r.select("example_id", "prediction", F.struct("pass_rate", "passed").alias("metric")), folder, epoch)
    return metrics


def group_step(rows: DataFrame, uid: str = "uid", score: str = "score", filtered: bool = True, size: int | None = None) -> DataFrame:
    """One step of group-relative training: uninformative groups go, the first `size` of the others stay (an error if
    there are fewer), the rest gets its advantages."""
    kept = informative_groups(rows, uid, score) if filtered else rows
    return A.grpo(accumulate_groups(kept, uid, size) if size else kept, uid, score)


def policy_step(tokens: DataFrame, beta: float, *, mode: str = "kl", aggregation: str = "token-mean", critic: bool = False, row: str = "row_id") -> DataFrame:
    """(name, value) of one step over tokens (row, t, mask, score, logp, old, ref, advantage[, pred, value, returns]): the
    rewards less the KL penalty, the KL of the step, the policy's loss with its clipped shares, and the critic's."""
    c = F.col
    p = L.policy_loss(c("logp"), c("old"), c("advantage"))
    t = tokens.withColumns({"_loss": p["loss"], "_clipped": p["clipped"], "_kl": p["kl"], "_low": p["clipped_low"], "_ref": L.kl_penalty(c("old"), c("ref"), mode), "_reward": L.kl_reward(c("score"), c("old"), c("ref"), c("mask"), beta, mode)})
    if critic:
        v = L.value_loss(c("pred"), c("value"), c("returns"))
        t = t.withColumns({"_vf": v["loss"], "_vfclip": v["clipped"]})
    t = stage(t, "policy-step")
    mean = lambda x: L.aggregate_loss(t, x, "mask", "token-mean", row)
    parts = [("actor/pg_loss", L.aggregate_loss(t, "_loss", "mask", aggregation, row)), ("actor/pg_clipfrac", mean("_clipped")), ("actor/ppo_kl", mean("_kl")), ("actor/pg_clipfrac_lower", mean("_low"))]
    parts += [("critic/vf_loss", mean("_vf")), ("critic/vf_clipfrac", mean("_vfclip"))] if critic else []
    parts += [("actor/reward_kl_penalty", M.kl_summary(t, "_ref", "mask", row)), ("critic/rewards/mean", t.groupBy(row).agg(F.sum("_reward").alias("r")).agg(F.avg("r").alias("r")))]
    return reduce(DataFrame.union, (df.select(F.lit(k).alias("name"), F.col(df.columns[0]).cast("double").alias("value")) for k, df in parts))


def process_step(rows: DataFrame, tokens: DataFrame, *, low: float, high: float, most: int, factor: float, beta: float = 0.05, weights: tuple[float, float] = (5.0, 5.0)) -> DataFrame:
    """One step with process rewards: groups whose mean acc is in the band and whose responses end come first, one in
    `factor` stays; tokens (row_id, t, mask, logp, ref) of those get process rewards and, with the outcome at the last
    token, returns and whitened advantages. rows are (row_id, uid, acc, length)."""
    kept = downsample_groups(banded_groups(rows, "uid", "acc", "length", low, high, most), "uid", "kept", factor)
    kept = stage(kept.select("row_id", "uid", "acc"), "kept-rows")
    t = tokens.join(kept, "row_id")
    last = t.where("mask = 1").groupBy("row_id").agg(F.max("t").alias("_last"))
    t = A.process_reward(t.join(last, "row_id"), "logp", "ref", beta).withColumn("outcome", F.when(F.col("t") == F.col("_last"), F.col("acc")).otherwise(0.0)).drop("_last")
    return A.multi_source_rloo(t, {"r": weights[0], "outcome": weights[1]}, whitening=True)


def preference_step(rows: DataFrame, pair: str, order: str, score: str, beta: float, kind: str = "sigmoid", smoothing: float = 0.0) -> DataFrame:
    """(name, value) of one step of preference training over rows (pair, order, score, logp, ref): the better response of
    each pair is chosen; the loss and the metrics of the batch."""
    p = L.preference_pairs(rows, pair, order, score)
    side = lambda c, chosen: F.max(F.when(F.col("chosen") == chosen, F.col(c)))
    g = p.groupBy(pair).agg(*(side(c, k).alias(f"{n}_{c}") for c in ("logp", "ref") for n, k in (("chosen", True), ("rejected", False))), F.max(score).alias("score"))
    h = F.col("chosen_logp") - F.col("rejected_logp") - (F.col("chosen_ref") - F.col("rejected_ref"))
    g = stage(g.withColumns({"_l": L.preference_loss(F.col("chosen_logp"), F.col("rejected_logp"), F.col("chosen_ref"), F.col("rejected_ref"), beta, kind, smoothing), "dpo_logits": h, "chosen_logps": F.col("chosen_logp"), "rejected_logps": F.col("rejected_logp")}), "preferences")
    loss = g.agg(F.avg("_l").alias("value")).select(F.lit("actor/dpo_loss").alias("name"), "value")
    return loss.union(M.preference_metrics(g.select("dpo_logits", "chosen_logps", "rejected_logps"))).union(M.preference_metrics(rows.select(F.col(score).alias("score"))))


def two_rounds(tasks: DataFrame, respond: dict, train, templates: dict[str, str], system: str = "") -> dict[str, DataFrame]:
    """The tables of two rounds of training against each other: solutions are drawn, a generator of tests is trained on
    them, its tests train a generator of code, whose solutions train the generator of tests once more.

    respond["code"](tasks, round) and respond["tests"](tasks, round) give (task_id, responses) and (task_id, response);
    train(name, rows) is called with the rows of each of the three trainings.
    """
    programs = stage(respond["code"](tasks, 0), "programs-0")
    first = test_generation_rows(tasks, templates["tests"], system)
    pool = programs.select("task_id", F.transform("responses", lambda r: text.python_code(r)).alias("candidates"))
    first = stage(first.drop("candidates").join(pool, "task_id"), "round-1-tests")
    train("tests-1", first)
    second = stage(code_generation_rows(tasks, templates["code"], system, tests=respond["tests"](tasks, 1)), "round-1-code")
    train("code-1", second)
    third = stage(adversarial_rows(tasks, {"iter_0": programs, "iter_1": respond["code"](tasks, 1)}, templates["tests"], system), "round-2-tests")
    train("tests-2", third)
    return {"tests-1": first, "code-1": second, "tests-2": third}
