"""KL, policy, value and preference losses over tokens (order lines) and rollouts (orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.columns import rounded
from quillon.operators import losses as L
from quillon.operators.sampling import with_position
from quillon.plans.tables import table
from quillon.queries.roles import ROLLOUTS, TOKENS, rollouts, tokens
from quillon.registry import query


@query(
    TOKENS + """SELECT row_id, t, round(logp - ref, 6) AS kl, round(abs(logp - ref), 6) AS abs, round(0.5 * power(logp - ref, 2), 6) AS mse,
    round(greatest(-10, least(10, exp(ref - logp) - (ref - logp) - 1)), 6) AS low_var_kl FROM tok"""
)
def kl_penalty_modes(spark, folder):
    p, r = F.col("logp"), F.col("ref")
    return tokens(spark, folder).select("row_id", "t", *(rounded(L.kl_penalty(p, r, m)).alias(m) for m in ("kl", "abs", "mse", "low_var_kl")))


@query(TOKENS + "SELECT row_id, t, round(reward - 0.2 * (logp - ref) * mask, 6) AS reward FROM tok")
def kl_rewards(spark, folder):
    c = F.col
    return tokens(spark, folder).select("row_id", "t", rounded(L.kl_reward(c("reward"), c("logp"), c("ref"), c("mask"), 0.2)).alias("reward"))


@query(
    TOKENS + """, s AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS step, avg(abs(logp - ref)) AS kl, count(DISTINCT row_id) AS n FROM tok JOIN orders ON o_orderkey = row_id GROUP BY ALL)
    SELECT step, n, round(0.1 * exp(sum(ln(1 + greatest(-0.2, least(0.2, kl / 0.04 - 1)) * n / 10000.0)) OVER (ORDER BY step)), 6) AS beta FROM s"""
)
def kl_controller(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("step"))
    s = tokens(spark, folder).join(o, "row_id").groupBy("step").agg(F.avg(F.abs(F.col("logp") - F.col("ref"))).alias("kl"), F.countDistinct("row_id").alias("n"))
    return L.adaptive_kl(s, "step", "kl", "n", 0.1, 0.04, 10_000.0).select("step", "n", rounded("beta").alias("beta"))


_POLICY = TOKENS.rstrip() + """, p AS (SELECT *, 5 * (logp - ref) AS d, 40 * (value - 0.04) AS adv FROM tok), q AS (SELECT *, exp(d) AS ratio FROM p),
  x AS (SELECT *, -adv * ratio AS a, -adv * greatest(0.8, least(1.2, ratio)) AS b FROM q), y AS (SELECT *, greatest(a, b) AS u, -adv * 3 AS f FROM x)
"""


@query(
    _POLICY + """SELECT row_id, t, round(CASE WHEN adv < 0 THEN least(f, u) ELSE u END, 6) AS loss, (b > a)::INT AS clipped, round(-d, 6) AS kl, (u > f AND adv < 0)::INT AS clipped_low FROM y"""
)
def policy_loss(spark, folder):
    t = tokens(spark, folder).withColumn("adv", 40 * (F.col("value") - 0.04))
    x = L.policy_loss(5 * (F.col("logp") - F.col("ref")), F.lit(0.0), F.col("adv"))
    return t.select("row_id", "t", rounded(x["loss"]).alias("loss"), x["clipped"].alias("clipped"), rounded(x["kl"]).alias("kl"), x["clipped_low"].alias("clipped_low"))


@query(
    TOKENS + """, p AS (SELECT row_id, t, power(reward * 10 - value, 2) AS a, power(greatest(least(reward * 10, value * 10 + 0.2), value * 10 - 0.2) - value, 2) AS b FROM tok)
    SELECT row_id, t, round(greatest(a, b), 6) AS loss, (b > a)::INT AS clipped FROM p"""
)
def value_loss(spark, folder):
    x = L.value_loss(F.col("reward") * 10, F.col("value") * 10, F.col("value"), 0.2)
    return tokens(spark, folder).select("row_id", "t", rounded(x["loss"]).alias("loss"), x["clipped"].alias("clipped"))


@query(
    TOKENS + """, r AS (SELECT row_id, sum(reward * mask) AS s, sum(mask) AS n, count(*) AS w FROM tok GROUP BY ALL)
    SELECT 'token-mean' AS mode, round(sum(reward * mask) / (sum(mask) + 1e-8), 6) AS loss FROM tok UNION ALL SELECT 'seq-mean-token-sum', round(avg(s) + 3.14159e-8, 6) FROM r
    UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / nullif(n, 0)) + 3.14159e-8, 6) FROM r UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / max(w) + 3.14159e-8, 6) FROM r"""
)
def agg_loss_modes(spark, folder):
    return L.aggregate_losses(tokens(spark, folder), "reward", "mask").select("mode", rounded("loss").alias("loss"))


@query(
    TOKENS + """, r AS (SELECT row_id, list(logp ORDER BY t) AS p, list(CASE WHEN mask = 1 THEN t ELSE -100 END ORDER BY t) AS y FROM tok GROUP BY ALL),
    x AS (SELECT row_id, unnest(p[:len(p) - 1]) AS p, unnest(y[2:]) AS y FROM r)
    SELECT row_id, round(coalesce(sum(x.p) FILTER (x.y <> -100), 0), 6) AS total, round(avg(x.p) FILTER (x.y <> -100), 6) AS mean FROM r LEFT JOIN x USING (row_id) GROUP BY ALL"""
)
def sequence_logps(spark, folder):
    t = tokens(spark, folder).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("t", "logp", "mask"))).alias("s"))
    p, y = F.transform("s", lambda x: x["logp"]), F.transform("s", lambda x: F.when(x["mask"] == 1, x["t"]).otherwise(-100))
    return t.select("row_id", rounded(L.sequence_logp(p, y)).alias("total"), rounded(L.sequence_logp(p, y, average=True)).alias("mean"))


_PAIRS = ROLLOUTS.rstrip() + """, k AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 2 AS pair_id FROM ro),
  c AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, row_id) = 1 AS chosen FROM k)
"""


def _pairs(spark, folder):
    """Orders in pairs by their place; an odd number of them is an error."""
    r = with_position(rollouts(spark, folder), ["row_id"], "_at").withColumn("pair_id", F.expr("_at div 2")).drop("_at")
    return L.preference_pairs(r, "pair_id", "row_id", "score")


@query(_PAIRS + "SELECT row_id, pair_id, chosen FROM c")
def dpo_pref_mask(spark, folder):
    return _pairs(spark, folder).select("row_id", "pair_id", "chosen")


@query(
    _PAIRS + """, p AS (SELECT pair_id, max(score) FILTER (chosen) AS a, max(score) FILTER (NOT chosen) AS b FROM c GROUP BY ALL), h AS (SELECT pair_id, (a - b) - 0.1 * (a + b) AS h FROM p)
    SELECT pair_id, round(-ln(1 / (1 + exp(-0.5 * h))) * 0.9 - ln(1 / (1 + exp(0.5 * h))) * 0.1, 6) AS sigmoid, round(power(h - 1, 2), 6) AS ipo FROM h"""
)
def online_dpo_loss(spark, folder):
    p = _pairs(spark, folder).groupBy("pair_id").agg(F.max(F.when(F.col("chosen"), F.col("score"))).alias("a"), F.max(F.when(~F.col("chosen"), F.col("score"))).alias("b"))
    a, b, z = F.col("a"), F.col("b"), F.lit(0.0)
    ref = 0.1 * (a + b)
    return p.select("pair_id", rounded(L.preference_loss(a, b, ref, z, 0.5, smoothing=0.1)).alias("sigmoid"), rounded(L.preference_loss(a, b, ref, z, 0.5, kind="ipo")).alias("ipo"))


@query(
    ROLLOUTS + """, x AS (SELECT *, (row_id % 3) / 2.0 AS acc FROM ro), p AS (SELECT a.uid, abs(a.acc - b.acc) AS w, CASE WHEN (a.score - b.score) * (a.acc - b.acc) > 0 THEN abs(a.acc - b.acc) ELSE 0 END AS g FROM x a JOIN x b ON a.uid = b.uid AND a.row_id < b.row_id),
    s AS (SELECT uid, sum(w) AS w, sum(g) AS g FROM p GROUP BY ALL)
    SELECT uid, round(coalesce(g / nullif(w, 0), 0.5)::DOUBLE, 6) AS accuracy FROM (SELECT DISTINCT uid FROM ro) u LEFT JOIN s USING (uid)"""
)
def dpo_accuracy(spark, folder):
    r = rollouts(spark, folder).withColumn("acc", (F.col("row_id") % 3) / 2.0)
    return L.pairwise_accuracy(r, "uid", "row_id", "score", "acc").withColumn("accuracy", rounded("accuracy"))


@query(
    ROLLOUTS + """, x AS (SELECT *, (row_id % 3) / 2.0 AS acc FROM ro)
    SELECT a.row_id, round(coalesce(avg(b.score), 0), 6) AS other_q FROM x a LEFT JOIN x b ON a.uid = b.uid AND CASE WHEN a.acc > 0 THEN b.acc < a.acc ELSE b.acc > a.acc END GROUP BY ALL"""
)
def dpo_other_mean(spark, folder):
    r = rollouts(spark, folder).withColumn("acc", (F.col("row_id") % 3) / 2.0)
    return L.other_mean(r, "uid", "score", "acc").select("row_id", rounded("other_q").alias("other_q"))


@query(ROLLOUTS + ", m AS (SELECT ln(avg(exp(0.7 * score))) / 0.7 AS s FROM ro) SELECT row_id, round(score - s, 6) AS advantage FROM ro, m")
def softmean_adv(spark, folder):
    r = rollouts(spark, folder)
    return r.crossJoin(F.broadcast(L.soft_mean(r, "score", 0.7))).select("row_id", rounded(F.col("score") - F.col("soft_mean")).alias("advantage"))


@query(
    TOKENS + """, r AS (SELECT row_id, sum(power(logp - ref - 0.5 * reward, 2) * mask) AS s, sum(mask) AS n FROM tok GROUP BY ALL)
    SELECT round(sum(s) / (sum(n) + 1e-8), 6) AS loss FROM r WHERE n > 0"""
)
def sppo_loss(spark, folder):
    x = tokens(spark, folder).withColumn("l", L.squared_preference(F.col("logp"), F.col("ref"), F.col("reward"), 0.5))
    return L.aggregate_loss(x, "l", "mask", "token-mean").select(rounded("loss").alias("loss"))


@query("SELECT request_id, max_response_len, round(least(-(coalesce(rollout_offset, 0) * 300 - (max_response_len - 1024)) / 1024.0, 0)::DOUBLE, 6) AS penalty FROM (SELECT DISTINCT request_id, max_response_len, rollout_offset FROM rollout_requests)")
def overlong_penalty(spark, folder):
    r = table(spark, folder, "rollout_requests").select("request_id", "max_response_len", "rollout_offset").distinct()
    length = F.coalesce("rollout_offset", F.lit(0)) * 300
    p = L.overlong_penalty(length, F.col("max_response_len"), 1024)
    return r.select("request_id", "max_response_len", rounded(p).alias("penalty"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS z, abs(vec_id) % 64 AS y FROM embeddings), s AS (SELECT *, list_sum(list_transform(z, lambda x: exp(x))) AS n FROM e)
    SELECT vec_id, round(ln(n) - list_sum(list_transform(z, lambda x: exp(x) * x)) / n, 6) AS entropy, round(z[y + 1] - ln(n), 6) AS logp FROM s"""
)
def entropy_from_logits(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    return e.select("vec_id", rounded(L.entropy(F.col("z"))).alias("entropy"), rounded(L.token_logp(F.col("z"), (F.abs("vec_id") % 64).cast("int"))).alias("logp"))


@query(
    ROLLOUTS + """, x AS (SELECT *, (row_id % 3) / 2.0 AS acc FROM ro), o AS (SELECT a.row_id, any_value(a.score) AS score, any_value(a.acc) AS acc, coalesce(avg(b.score), 0) AS other FROM x a LEFT JOIN x b ON a.uid = b.uid AND CASE WHEN a.acc > 0 THEN b.acc < a.acc ELSE b.acc > a.acc END GROUP BY a.row_id)
    SELECT row_id, round(ln(1 + exp(0.1 * score)) - 0.1 * score * acc, 6) AS ce, round(ln(1 + exp(-0.1 * (score - other) * CASE WHEN acc > 0 THEN 1 ELSE -1 END)), 6) AS detached FROM o"""
)
def reward_model_losses(spark, folder):
    r = L.other_mean(rollouts(spark, folder).withColumn("acc", (F.col("row_id") % 3) / 2.0), "uid", "score", "acc")
    q, acc = F.col("score"), F.col("acc")
    return r.select("row_id", rounded(L.reward_model_loss(q, acc, 0.1)).alias("ce"), rounded(L.detached_preference_loss(q, F.col("other_q"), acc, 0.1)).alias("detached"))
