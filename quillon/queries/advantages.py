"""Advantages over rollouts (orders) and tokens (order lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.columns import rounded
from quillon.operators import advantage as A
from quillon.queries.roles import ROLLOUTS, TOKENS, rollouts, sequences, tokens
from quillon.registry import query

_G = ROLLOUTS.rstrip() + ", g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s FROM ro WINDOW w AS (PARTITION BY uid))\n"


def _out(df, *keys, value="advantage"):
    return df.select(*keys, rounded(value).alias(value))


@query(_G + "SELECT row_id, uid, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (s + 1e-6) END, 6) AS advantage FROM g")
def adv_grpo(spark, folder):
    return _out(A.estimate("grpo", rollouts(spark, folder)), "row_id", "uid")


@query(_G + "SELECT row_id, uid, round(CASE WHEN n = 1 THEN score ELSE score - m END, 6) AS advantage FROM g")
def adv_drgrpo(spark, folder):
    return _out(A.grpo(rollouts(spark, folder), normalize=False), "row_id", "uid")


@query(_G + "SELECT row_id, uid, round(CASE WHEN n = 1 THEN score ELSE score * n / (n - 1) - m * n / (n - 1) END, 6) AS advantage FROM g")
def adv_rloo(spark, folder):
    return _out(A.rloo(rollouts(spark, folder)), "row_id", "uid")


@query(
    _G + """, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS k, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS second FROM g WHERE n >= 2)
    SELECT row_id, uid, round(CASE WHEN k = 1 THEN (score - second) / (s + 1e-6) ELSE 0 END, 6) AS advantage FROM r"""
)
def adv_passk(spark, folder):
    return _out(A.pass_at_k(rollouts(spark, folder)), "row_id", "uid")


@query(
    TOKENS + """, g AS (SELECT o_orderkey AS row_id, CASE WHEN count(*) OVER w = 1 THEN o_totalprice / 1e5 ELSE o_totalprice / 1e5 - avg(o_totalprice / 1e5) OVER w END AS a FROM orders WINDOW w AS (PARTITION BY o_custkey)),
    x AS MATERIALIZED (SELECT row_id, t, mask, a * mask AS a FROM tok JOIN g USING (row_id)), n AS MATERIALIZED (SELECT sum(mask)::DOUBLE AS n, sum(a * mask) / (sum(mask) + 1e-8) AS m FROM x),
    v AS MATERIALIZED (SELECT (SELECT m FROM n) AS m, sum(power(a - (SELECT m FROM n), 2) * mask) / ((SELECT n FROM n) + 1e-8) * (SELECT n FROM n) / ((SELECT n FROM n) - 1) AS v FROM x)
    SELECT row_id, t, round((a - m) / sqrt(v + 1e-8) * mask, 6) AS advantage FROM x, v"""
)
def adv_rfpp_baseline(spark, folder):
    g = A.baseline(rollouts(spark, folder)).select("row_id", "advantage")
    t = tokens(spark, folder).join(g, "row_id").withColumn("a", F.col("advantage") * F.col("mask"))
    w = A.whiten(t.select("row_id", "t", "mask", "a"), "a")
    return w.select("row_id", "t", rounded(F.col("whitened") * F.col("mask")).alias("advantage"))


@query(
    TOKENS + """, d AS (SELECT row_id, t, value, reward + 0.99 * coalesce(lead(value) OVER (PARTITION BY row_id ORDER BY t), 0) - value AS delta FROM tok)
    SELECT a.row_id, a.t, round(sum(power(0.99 * 0.95, b.t - a.t) * b.delta), 6) AS advantage, round(sum(power(0.99 * 0.95, b.t - a.t) * b.delta) + any_value(a.value), 6) AS returns
    FROM d a JOIN d b ON a.row_id = b.row_id AND b.t >= a.t GROUP BY ALL"""
)
def adv_gae(spark, folder):
    g = A.gae(sequences(spark, folder), gamma=0.99, lam=0.95)
    x = g.select("row_id", F.posexplode(F.arrays_zip("advantages", "returns")).alias("k", "x"))
    return x.select("row_id", (F.col("k") + 1).cast("bigint").alias("t"), rounded("x.advantages").alias("advantage"), rounded("x.returns").alias("returns"))


@query(
    TOKENS.replace("WITH tok", "WITH RECURSIVE tok") + """, last AS (SELECT row_id, max(t) AS n FROM tok GROUP BY ALL),
    r AS (SELECT row_id, t, reward AS ret, mask FROM tok JOIN last USING (row_id) WHERE t = n
      UNION ALL SELECT tok.row_id, tok.t, tok.reward + 0.9 * r.ret * r.mask, tok.mask FROM r JOIN tok ON tok.row_id = r.row_id AND tok.t = r.t - 1)
    SELECT row_id, t, round(ret, 6) AS returns FROM r"""
)
def adv_rfpp(spark, folder):
    g = A.reinforce_plus(sequences(spark, folder), gamma=0.9).select("row_id", F.posexplode("returns").alias("k", "r"))
    return g.select("row_id", (F.col("k") + 1).cast("bigint").alias("t"), rounded("r").alias("returns"))


@query(
    TOKENS + """, b AS (SELECT *, avg(reward) OVER (PARTITION BY row_id) AS base FROM tok),
    s AS (SELECT *, sum(reward * mask) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM b)
    SELECT row_id, t, round(ret, 6) AS returns, round(ret - base * mask, 6) AS advantage FROM s"""
)
def adv_remax(spark, folder):
    t = tokens(spark, folder)
    t = t.join(t.groupBy("row_id").agg(F.avg("reward").alias("baseline")), "row_id")
    return A.remax(t).select("row_id", "t", rounded("returns").alias("returns"), rounded("advantage").alias("advantage"))


@query(
    TOKENS + """, u AS (SELECT tok.*, o_custkey AS uid FROM tok JOIN orders ON o_orderkey = row_id), m AS (SELECT uid, row_id, sum(reward * mask) / nullif(sum(mask), 0) AS a, sum(value * mask) / nullif(sum(mask), 0) AS b FROM u GROUP BY ALL),
    g AS (SELECT uid, sum(a) AS sa, sum(b) AS sb, count(*) AS n FROM m GROUP BY ALL),
    x AS (SELECT u.*, mask * CASE WHEN n > 1 THEN (reward * n - sa) / (n - 1) ELSE reward END AS a, mask * CASE WHEN n > 1 THEN (value * n - sb) / (n - 1) ELSE value END AS b FROM u JOIN g USING (uid))
    SELECT row_id, t, round(sum(0.7 * a + 0.3 * b) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS returns FROM x"""
)
def adv_multi_source_rloo(spark, folder):
    t = tokens(spark, folder).join(rollouts(spark, folder).select("row_id", "uid"), "row_id")
    r = A.multi_source_rloo(t, {"reward": 0.7, "value": 0.3})
    return r.select("row_id", "t", rounded("returns").alias("returns"))


@query(TOKENS + "SELECT row_id, t, round(0.05 * (logp - ref), 6) AS r FROM tok")
def process_reward_direct(spark, folder):
    return _out(A.process_reward(tokens(spark, folder), "logp", "ref"), "row_id", "t", value="r")


@query(
    TOKENS + """, q AS (SELECT row_id, t, CASE WHEN t = max(t) OVER (PARTITION BY row_id) THEN 1.0 - coalesce(sum(logp - ref) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE logp - ref END AS q FROM tok)
    SELECT a.row_id, a.t, round(sum(power(0.5, b.t - a.t) * b.q), 6) AS r FROM q a JOIN q b ON a.row_id = b.row_id AND b.t >= a.t GROUP BY ALL"""
)
def process_reward_discounted(spark, folder):
    t = tokens(spark, folder).withColumn("acc", F.lit(1.0))
    return _out(A.process_reward(t, "logp", "ref", lam=0.5, acc="acc"), "row_id", "t", value="r")


@query(
    TOKENS + """, s AS (SELECT *, abs(sum(reward) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS c FROM tok)
    SELECT row_id, t, round(reward / ((SELECT max(c) FROM s) + 1e-6), 6) AS r FROM s"""
)
def process_reward_normed(spark, folder):
    return _out(A.batch_norm(tokens(spark, folder).select("row_id", "t", F.col("reward").alias("r"))), "row_id", "t", value="r")
