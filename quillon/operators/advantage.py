"""Group-relative and token-level advantages.

Responses: one row each, with the group uid and the score. Tokens: long form (row_id, t, …), one row per token, so that
responses of any length are spread over tasks; recursions from right to left are running sums over t.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.recursions import discounted
from quillon.functions.tokens import last_of

EPS = 1e-6  # of the group's deviation
MASK_EPS = 1e-8  # of masked means and variances


def group_stats(rows: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """rows with the columns n, mean and std (sample) of their group; groups of one get mean 0 and std 1.

    The statistics are an aggregate joined back rather than a window: the aggregate combines before the shuffle, and
    AQE can split a frequent group in the join.
    """
    g = rows.groupBy(uid).agg(F.count("*").alias("n"), F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    g = g.select(uid, "n", F.when(F.col("n") == 1, 0.0).otherwise(F.col("_m")).alias("mean"), F.when(F.col("n") == 1, 1.0).otherwise(F.col("_s")).alias("std"))
    return rows.join(g, uid)


def grpo(rows: DataFrame, uid: str = "uid", score: str = "score", normalize: bool = True) -> DataFrame:
    """advantage = (score - mean) / (std + 1e-6), or without the division."""
    centred = F.col(score) - F.col("mean")
    return group_stats(rows, uid, score).withColumn("advantage", centred / (F.col("std") + EPS) if normalize else centred)


def rloo(rows: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """Score against the mean of the group's other rows; a row alone in its group keeps its score."""
    n = F.col("n")
    other = (F.col(score) - F.col("mean")) * n / F.when(n > 1, n - 1)
    return group_stats(rows, uid, score).withColumn("advantage", F.when(n == 1, F.col(score)).otherwise(other))


def baseline(rows: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """score - mean; a row alone in its group keeps its score."""
    return group_stats(rows, uid, score).withColumn("advantage", F.col(score) - F.col("mean"))


def pass_at_k(rows: DataFrame, uid: str = "uid", score: str = "score", order: str = "row_id", normalize: bool = True, strict: bool = False) -> DataFrame:
    """Only the group's best row gets (best - second) [/ (std + 1e-6)]; the others get 0.

    Groups of fewer than two rows have no second: an error if strict, else they are left out.
    """
    top = rows.groupBy(uid).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))).alias("best"), F.count("*").alias("n"), F.stddev_samp(score).alias("std"))
    joined = rows.join(top, uid)
    is_best = (F.col(score) == F.col("best.s")) & (F.col(order) == -F.col("best.o"))
    second = joined.where(~is_best).groupBy(uid).agg(F.max(score).alias("second"))
    size = F.when(F.col("n") < 2, F.raise_error(F.lit("a group needs at least two rows"))).otherwise(F.lit(True)) if strict else F.col("n") >= 2
    gap = F.col("best.s") - F.col("second")
    value = gap / (F.col("std") + EPS) if normalize else gap
    return joined.where(size).join(second, uid, "left").withColumn("advantage", F.when(is_best, value).otherwise(0.0)).drop("best", "second", "std", "n")


def reverse_sum(value: Column, row: str = "row_id", t: str = "t") -> Column:
    """Sum over this token and all after it."""
    return F.sum(value).over(Window.partitionBy(row).orderBy(t).rowsBetween(Window.currentRow, Window.unboundedFollowing))


def masked_stats(tokens: DataFrame, value: str, mask: str = "mask") -> DataFrame:
    """One row (m_mean, m_var, m_n): mean and Bessel-corrected variance over masked tokens.

    As the mean's divisor has an epsilon, so has the deviation's centre. Raises with fewer than two masked tokens. The
    mask holds 0 and 1; one pass over the tokens.
    """
    n = F.sum(mask)
    x = F.when(F.col(mask) == 1, F.col(value))
    one = tokens.agg(n.cast("double").alias("m_n"), F.avg(x).alias("_a"), F.var_pop(x).alias("_v"), (F.sum(x) / (n + MASK_EPS)).alias("m_mean"))
    enough = F.when(F.col("m_n") < 2, F.raise_error(F.lit("the mask must select at least two tokens"))).otherwise(F.col("m_n"))
    spread = F.col("m_n") * (F.col("_v") + F.pow(F.col("_a") - F.col("m_mean"), 2)) / (F.col("m_n") + MASK_EPS)
    return one.select("m_mean", (spread * enough / (F.col("m_n") - 1)).alias("m_var"), "m_n")


def whiten(tokens: DataFrame, value: str, mask: str = "mask", out: str = "whitened") -> DataFrame:
    """tokens with (value - mean) / sqrt(var + 1e-8); the one row of statistics is broadcast, not a window of everything."""
    s = masked_stats(tokens, value, mask)
    return tokens.crossJoin(F.broadcast(s)).withColumn(out, (F.col(value) - F.col("m_mean")) / F.sqrt(F.col("m_var") + MASK_EPS)).drop("m_mean", "m_var", "m_n")


def gae(sequences: DataFrame, rewards: str = "rewards", values: str = "values", gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """sequences with arrays advantages and returns; the recursion ignores the mask.

    rewards and values are arrays of equal length, one sequence a row.
    """
    n = F.size(rewards)
    delta = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.element_at(rewards, i) + gamma * F.coalesce(F.get(values, i), F.lit(0.0)) - F.element_at(values, i)
    )
    delta = F.when(n > 0, delta).otherwise(F.array().cast("array<double>"))
    out = sequences.withColumn("advantages", discounted(delta, gamma * lam))
    return out.withColumn("returns", F.zip_with("advantages", values, lambda a, v: a + v))


def reinforce_plus(sequences: DataFrame, rewards: str = "rewards", mask: str = "mask", gamma: float = 1.0) -> DataFrame:
    """sequences with the array returns: R = r + gamma R, from right to left, back to 0 at masked-out tokens."""
    return sequences.withColumn("returns", discounted(F.col(rewards), gamma, F.col(mask)))


def whitened_tokens(sequences: DataFrame, value: str, mask: str = "mask", row: str = "row_id", masked: bool = True) -> DataFrame:
    """(row, t, mask, value, whitened): the arrays as tokens from t = 1 on, with the value whitened over all masked
    tokens of the batch, and 0 at the others if masked."""
    x = sequences.select(row, F.posexplode(F.arrays_zip(F.col(value).alias("v"), F.col(mask).alias("m"))).alias("t", "x"))
    x = x.select(row, (F.col("t") + 1).cast("long").alias("t"), F.col("x.m").alias("mask"), F.col("x.v").alias(value))
    w = whiten(x, value)
    return w.withColumn("whitened", F.col("whitened") * F.col("mask")) if masked else w


def remax(tokens: DataFrame, reward: str = "reward", base: str = "baseline", mask: str = "mask") -> DataFrame:
    """tokens with returns (sum of masked rewards from here on) and advantage = returns - baseline * mask."""
    t = tokens.withColumn("returns", reverse_sum(F.col(reward) * F.col(mask)))
    return t.withColumn("advantage", F.col("returns") - F.col(base) * F.col(mask))


def multi_source_rloo(tokens: DataFrame, sources: dict[str, float], uid: str = "uid", mask: str = "mask", whitening: bool = False) -> DataFrame:
    """tokens with returns: per source, each reward against the means of the group's other rows; weighted and summed
    from the right. A row alone in its group keeps its rewards. With whitening also advantage, the returns whitened over
    the masked tokens."""
    for name in sources:
        m = tokens.groupBy(uid, "row_id").agg(F.try_divide(F.sum(F.col(name) * F.col(mask)), F.sum(mask)).alias(f"_{name}"))
        total = m.groupBy(uid).agg(F.sum(f"_{name}").alias("_sum"), F.count("*").alias("_n"))
        n = F.col("_n")
        against = F.when(n > 1, F.col(name) * n / F.when(n > 1, n - 1) - F.col("_sum") / F.when(n > 1, n - 1)).otherwise(F.col(name))
        tokens = tokens.join(total, uid).withColumn(f"_{name}", against * F.col(mask)).drop("_sum", "_n")
    total = sum((w * F.col(f"_{name}") for name, w in sources.items()), F.lit(0.0))
    out = tokens.withColumn("returns", reverse_sum(total)).drop(*(f"_{n}" for n in sources))
    return whiten(out, "returns", mask, "advantage") if whitening else out


def process_reward(tokens: DataFrame, logp: str, ref: str, beta: float = 0.05, lam: float = 0.0, acc: str | None = None) -> DataFrame:
    """Implicit process reward r of valid tokens: beta q at lam 0, else q summed from the right with weight lam, the last
    token first replaced by acc minus the sum of the others."""
    q = F.col(logp) - F.col(ref)
    if lam == 0:
        return tokens.withColumn("r", beta * q)
    if acc:
        last = F.max("t").over(Window.partitionBy("row_id"))
        before = F.sum(q).over(Window.partitionBy("row_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
        tokens = tokens.withColumn("_q", F.when(F.col("t") == last, F.col(acc) - F.coalesce(before, F.lit(0.0))).otherwise(q))
    else:
        tokens = tokens.withColumn("_q", q)
    seq = tokens.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("t", "_q"))).alias("s"))
    pick = lambda f: F.transform("s", lambda x: x[f])
    r = seq.select("row_id", F.explode(F.arrays_zip(pick("t").alias("t"), discounted(pick("_q"), lam).alias("r"))).alias("x")).select("row_id", "x.t", "x.r")
    return tokens.drop("_q").join(r, ["row_id", "t"])


def batch_norm(tokens: DataFrame, reward: str = "r") -> DataFrame:
    """reward divided by the batch's greatest absolute sum from the right (+ 1e-6)."""
    sums = tokens.withColumn("_s", F.abs(reverse_sum(F.col(reward))))
    return tokens.crossJoin(F.broadcast(sums.agg(F.max("_s").alias("_m")))).withColumn(reward, F.col(reward) / (F.col("_m") + EPS)).drop("_m")


def token_advantages(rows: DataFrame, mask: str = "mask", advantage: str = "advantage") -> DataFrame:
    """rows with advantages: the row's advantage at each of its masked tokens, 0 at the others."""
    return rows.withColumn("advantages", F.transform(mask, lambda m: F.col(advantage) * m))


def reinforce_baseline(rows: DataFrame, uid: str = "uid", score: str = "score", mask: str = "mask", row: str = "row_id") -> DataFrame:
    """(row, t, mask, advantage): score - mean at the masked tokens, whitened over all of them, 0 at the others."""
    tiled = token_advantages(baseline(rows, uid, score), mask)
    return whitened_tokens(tiled, "advantages", mask, row).select(row, "t", "mask", F.col("whitened").alias("advantage"))


def gae_advantages(sequences: DataFrame, mask: str = "mask", row: str = "row_id", **options) -> DataFrame:
    """(row, t, mask, advantage, returns): gae with its advantages whitened over the masked tokens (not masked again)."""
    g = gae(sequences, **options).withColumn("_r", F.arrays_zip(F.col("advantages").alias("a"), F.col("returns").alias("r")))
    x = g.select(row, F.posexplode(F.arrays_zip(F.col("_r").alias("x"), F.col(mask).alias("m"))).alias("t", "y"))
    x = x.select(row, (F.col("t") + 1).cast("long").alias("t"), F.col("y.m").alias("mask"), F.col("y.x.a").alias("_a"), F.col("y.x.r").alias("returns"))
    return whiten(x, "_a", "mask", "advantage").drop("_a")


def reinforce_plus_advantages(sequences: DataFrame, mask: str = "mask", row: str = "row_id", **options) -> DataFrame:
    """(row, t, mask, advantage, returns): reinforce_plus with its returns whitened and masked as advantages."""
    w = whitened_tokens(reinforce_plus(sequences, mask=mask, **options), "returns", mask, row)
    return w.select(row, "t", "mask", F.col("whitened").alias("advantage"), "returns")


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "gae": gae, "grpo": grpo, "grpo_passk": pass_at_k, "rloo": rloo, "reinforce_plus_plus": reinforce_plus, "reinforce_plus_plus_baseline": baseline, "remax": remax,
}


#: Estimators over rows with a score, whose advantage is spread over the response's tokens.
OUTCOME = {"grpo", "grpo_passk", "rloo"}


def estimate(name: str, df: DataFrame, *, attention: str | None = None, response: int | None = None, loss_mask: str | None = None, **options) -> DataFrame:
    """The estimator of that name; an unknown one is an error.

    Where df has no column mask but an attention mask, the mask is its last `response` entries. An outcome estimator also
    gives advantages for the tokens where there is a mask: in conversations of several turns the part of loss_mask that
    belongs to the response takes its place (grpo only).
    """
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}: one of {sorted(ESTIMATORS)}")
    if attention and response and "mask" not in df.columns:
        df = df.withColumn("mask", last_of(F.col(attention), response))
    out = ESTIMATORS[name](df, **options)
    if name in OUTCOME and "mask" in df.columns and df.schema["mask"].dataType.typeName() == "array":
        own = last_of(F.col(loss_mask), response) if loss_mask and name == "grpo" else F.col("mask")
        out = token_advantages(out.withColumn("_own", own), "_own").drop("_own")
    return out
