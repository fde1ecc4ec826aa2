"""Metrics over validation samples, tokens and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.columns import rounded
from quillon.operators import metrics as M
from quillon.plans.tables import table
from quillon.queries.roles import TOKENS, tokens
from quillon.registry import query

VAL = "WITH s AS (SELECT DISTINCT data_source, prompt, sample_idx, score, acc, pred FROM validation_samples WHERE isfinite(score))"


def samples(spark, folder):
    """Validation samples without repeated rows and without NaN scores."""
    return table(spark, folder, "validation_samples").select("data_source", "prompt", "sample_idx", "score", "acc", "pred").distinct().where("score < 1e300")  # NaN sorts above all numbers


@query(
    VAL + """, p AS (SELECT data_source, prompt, count(score) AS n, avg(score) AS m, stddev_pop(score) AS d FROM s GROUP BY ALL)
    SELECT data_source, n, count(*) AS n_prompts, round(avg(m), 6) AS mean, round(avg(d), 6) AS std FROM p GROUP BY ALL"""
)
def val_metrics_mean_std(spark, folder):
    p = M.mean_std(samples(spark, folder), ["data_source", "prompt"], "score")
    return p.groupBy("data_source", "n").agg(F.count("*").alias("n_prompts"), rounded(F.avg("mean")).alias("mean"), rounded(F.avg("std")).alias("std"))


@query(
    VAL + """, r AS (SELECT *, count(*) OVER (PARTITION BY data_source, prompt) AS n, row_number() OVER (PARTITION BY data_source, prompt ORDER BY score) AS i FROM s),
    k AS (SELECT *, unnest(list_distinct(list_append(list_filter([2, 4, 8, 16, 32, 64, 128], lambda p: p < n), n))) AS k FROM r WHERE n > 1),
    w AS (SELECT *, power(i / n, k) - power((i - 1) / n, k) AS up, power((n - i + 1) / n, k) - power((n - i) / n, k) AS dn FROM k),
    a AS (SELECT data_source, prompt, k, sum(score * up) AS b, sum(score * score * up) AS b2, sum(score * dn) AS l, sum(score * score * dn) AS l2 FROM w GROUP BY ALL)
    SELECT data_source, k::BIGINT AS k, round(avg(b), 6) AS best_mean, round(avg(sqrt(greatest(b2 - b * b, 0))), 5) AS best_std, round(avg(l), 6) AS worst_mean, round(avg(sqrt(greatest(l2 - l * l, 0))), 5) AS worst_std FROM a GROUP BY ALL"""
)
def val_metrics_best_worst(spark, folder):
    a = M.best_worst_at(samples(spark, folder), ["data_source", "prompt"], "score")
    return a.groupBy("data_source", "k").agg(
        rounded(F.avg("best_mean")).alias("best_mean"), F.round(F.avg("best_std"), 5).alias("best_std"), rounded(F.avg("worst_mean")).alias("worst_mean"), F.round(F.avg("worst_std"), 5).alias("worst_std")
    )


@query(
    VAL + """, v AS (SELECT data_source, prompt, pred, count(*) AS n, min(sample_idx) AS o, arg_min(score, sample_idx) AS score FROM s WHERE pred IS NOT NULL GROUP BY ALL)
    SELECT data_source, prompt, pred, round(score, 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY data_source, prompt ORDER BY n DESC, o) = 1"""
)
def majority_vote(spark, folder):
    m = M.majority(samples(spark, folder).where("pred is not null"), ["data_source", "prompt"], "pred", "score", "sample_idx")
    return m.withColumn("score", rounded("score"))


@query(VAL + "SELECT data_source, prompt, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s WHERE pred IS NOT NULL GROUP BY ALL")
def majority_at_k(spark, folder):
    """Of all draws of two, where the first drawn always wins: its values are those of the rows."""
    m = M.majority_at(samples(spark, folder).where("pred is not null"), ["data_source", "prompt"], "pred", "score", "sample_idx", 2, resamples=1_000_000)
    return m.select("data_source", "prompt", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(
    VAL + """, p AS (SELECT a.data_source, a.prompt, (a.score + b.score) / 2 AS m, greatest(a.score, b.score) AS hi, least(a.score, b.score) AS lo FROM s a JOIN s b USING (data_source, prompt))
    SELECT data_source, prompt, round(avg(m), 6) AS mean_mean, round(stddev_pop(m), 6) AS mean_std, round(avg(hi), 6) AS max_mean, round(stddev_pop(hi), 6) AS max_std, round(avg(lo), 6) AS min_mean FROM p GROUP BY ALL"""
)
def bootstrap_metrics(spark, folder):
    """All draws of two, under three reducers."""
    import numpy as np

    b = M.bootstrap(samples(spark, folder), ["data_source", "prompt"], "score", 2, resamples=1_000_000, reducers={"mean": np.mean, "max": np.max, "min": np.min})
    return b.select("data_source", "prompt", *(rounded(c).alias(c) for c in ("mean_mean", "mean_std", "max_mean", "max_std", "min_mean")))


@query(
    VAL + """, l AS (SELECT data_source, 'reward' AS variable, 'mean@' || count(*) AS metric, avg(score) AS value FROM s GROUP BY data_source, prompt
      UNION ALL SELECT data_source, 'acc', 'mean@' || count(*), avg(acc) FROM s GROUP BY data_source, prompt UNION ALL SELECT data_source, 'acc', 'std@' || count(*), stddev_pop(acc) FROM s GROUP BY data_source, prompt),
    m AS (SELECT data_source, variable, metric, avg(value) AS value FROM l GROUP BY ALL), n AS (SELECT data_source, max(regexp_extract(metric, '@(\\d+)', 1)::INT) AS n FROM m GROUP BY ALL)
    SELECT data_source, variable, metric, round(value, 6) AS value, CASE WHEN variable = 'acc' AND regexp_matches(metric, '^(mean|maj|best)') AND contains(metric, '@' || n) THEN 'val-core' ELSE 'val-aux' END AS section FROM m JOIN n USING (data_source)"""
)
def val_core_names(spark, folder):
    s, keys = samples(spark, folder), ["data_source", "prompt"]
    n = F.count("*").cast("string")
    one = lambda v, p, x: s.groupBy(*keys).agg(F.concat(F.lit(p + "@"), n).alias("metric"), x.alias("value")).select("data_source", F.lit(v).alias("variable"), "metric", "value")
    long = one("reward", "mean", F.avg("score")).union(one("acc", "mean", F.avg("acc"))).union(one("acc", "std", F.stddev_pop("acc")))
    m = long.groupBy("data_source", "variable", "metric").agg(rounded(F.avg("value")).alias("value"))
    return M.core_or_auxiliary(m, "variable", "metric")


@query(
    TOKENS + """, r AS (SELECT row_id, sum(reward * mask) AS reward, sum(value * mask) AS value, sum(mask) AS length FROM tok GROUP BY ALL)
    SELECT 'reward' AS name, round(avg(reward), 6) AS mean, round(max(reward), 6) AS max, round(min(reward), 6) AS min FROM r
    UNION ALL SELECT 'value', round(avg(value) + 3.14159e-8, 6), round(max(value) + 3.14159e-8, 6), round(min(value) + 3.14159e-8, 6) FROM r"""
)
def data_metrics(spark, folder):
    s = M.sequence_summary(tokens(spark, folder), ["reward", "value"])
    return s.select("name", *(rounded(c).alias(c) for c in ("mean", "max", "min")))


@query(TOKENS + "SELECT round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) AS explained_variance FROM tok WHERE mask = 1")
def explained_variance(spark, folder):
    return M.explained_variance(tokens(spark, folder), "reward", "value").select(rounded("explained_variance").alias("explained_variance"))


_TIMING = """WITH s AS (SELECT event_type AS section, sum(value) AS seconds FROM events GROUP BY ALL), n AS (SELECT event_type AS section, count(*) AS n_tokens FROM events WHERE event_type <> 'error' GROUP BY ALL)
"""


@query(_TIMING + "SELECT section, round(seconds, 6) AS seconds, round(seconds * 1000 / n_tokens, 6) AS ms_per_token FROM s LEFT JOIN n USING (section)")
def timing_metrics(spark, folder):
    e = table(spark, folder, "events").withColumnRenamed("event_type", "section")
    s = e.groupBy("section").agg(F.sum("value").alias("seconds"))
    n = e.where("section <> 'error'").groupBy("section").agg(F.count("*").alias("n_tokens"))
    return M.timing(s, n).select("section", rounded("seconds").alias("seconds"), rounded("ms_per_token").alias("ms_per_token"))


@query("SELECT user_id AS step, count(*) AS n_tokens, round(count(*) / (sum(value) * 8), 6) AS throughput FROM events GROUP BY ALL")
def throughput(spark, folder):
    s = table(spark, folder, "events").groupBy(F.col("user_id").alias("step")).agg(F.count("*").alias("n_tokens"), F.sum("value").alias("seconds"))
    return M.throughput(s, 8).select("step", "n_tokens", rounded("throughput").alias("throughput"))


@query(
    """WITH m AS (SELECT unnest(['max_', 'min_', 'mean_', 'minmax_']) || event_type AS name, value FROM events)
    SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY name"""
)
def reduce_metrics(spark, folder):
    e = table(spark, folder, "events").select(F.explode(F.array(*map(F.lit, ("max_", "min_", "mean_", "minmax_")))).alias("p"), "event_type", "value")
    return M.reduce_metrics(e.select(F.concat("p", "event_type").alias("name"), "value")).select("name", rounded("value").alias("value"))


@query(
    """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, coalesce(length(text), 0) AS n FROM documents), b AS (SELECT i // ((SELECT count(*) FROM d) // 8) AS b, sum(n) AS s FROM d GROUP BY ALL)
    SELECT min(s)::BIGINT AS least, max(s)::BIGINT AS most, (max(s) - min(s))::BIGINT AS gap, round(sum(s) / 8.0, 6) AS mean FROM b"""
)
def seqlen_unbalance(spark, folder):
    from quillon.operators.sampling import with_position

    d = with_position(table(spark, folder, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n")), ["doc_id"], "i")
    return M.length_imbalance(d, "i", "n", 8).withColumn("mean", rounded("mean"))


@query(TOKENS + ", g AS (SELECT abs(exp(logp) - exp(ref)) AS g FROM tok WHERE mask = 1) SELECT round(max(g), 6) AS gap_max, round(avg(g), 6) AS gap_mean, round(stddev_samp(g), 6) AS gap_std FROM g")
def rollout_prob_diff(spark, folder):
    return M.probability_gap(tokens(spark, folder), "logp", "ref").select(*(rounded(c).alias(c) for c in ("gap_max", "gap_mean", "gap_std")))


@query("SELECT round((6 * 7.0 * sum(length(text)::DOUBLE) + 12 * sum(length(text)::DOUBLE * length(text)) * 128 * 28 * 32 / 1e9) / 1e6, 3) AS flops FROM documents")
def flops_estimate(spark, folder):
    """In 1e15 of a model of 7e9 dense parameters, 32 layers, 28 heads of 128, over documents by characters."""
    d = table(spark, folder, "documents").select(F.length("text").alias("n"))
    f = M.transformer_flops(d, "n", dense=7e9, attention=32 * 28 * 128)
    return f.select(F.round(F.col("flops") / 1e15, 3).alias("flops"))


@query(
    "SELECT event_id, (event_id % 100)::DOUBLE AS coverage FROM events"
)
def coverage_extract(spark, folder):
    text = F.concat(F.lit("Name Stmts Miss Cover\na.py 10 2 80%\nTOTAL 40 "), F.col("user_id").cast("string"), F.lit(" "), (F.col("event_id") % 100).cast("string"), F.lit("%"))
    return table(spark, folder, "events").select("event_id", M.coverage_percent(text).alias("coverage"))


@query(
    """WITH s AS (SELECT user_id AS step, event_type AS name, avg(value) AS v FROM events GROUP BY ALL)
    SELECT step, 'step:' || step || ' - ' || string_agg(name || ':' || format('{:.3f}', v + 3.14159e-8), ' - ' ORDER BY name) AS line FROM s GROUP BY step"""
)
def metric_log_lines(spark, folder):
    s = table(spark, folder, "events").groupBy(F.col("user_id").alias("step"), F.col("event_type").alias("name")).agg((F.avg("value") + 3.14159e-8).alias("v"))
    return M.log_line(s, "step", "name", "v")


@query(
    """WITH m AS (SELECT sample_id, CASE WHEN messages IS NULL THEN 'missing: messages' WHEN len(messages) = 0 THEN 'empty: messages'
      WHEN len(list_filter(messages, lambda m: m.role = 'user')) = 0 THEN 'structure: no user' WHEN len(list_filter(messages, lambda m: m.role = 'assistant')) = 0 THEN 'structure: no assistant'
      WHEN len(list_filter(messages, lambda m: m.content IS NULL)) > 0 THEN 'content: null' WHEN gt_tests IS NULL THEN 'missing: tests' WHEN gt_tests = '' THEN 'empty: tests' END AS error FROM sft_train_codegen)
    SELECT trim(split_part(error, ':', 1)) AS kind, count(*) AS n FROM m WHERE error IS NOT NULL GROUP BY ALL"""
)
def error_histogram(spark, folder):
    from quillon.functions.chat import sample_error

    return M.error_histogram(table(spark, folder, "sft_train_codegen").select(sample_error("messages", "gt_tests").alias("error")), "error")
