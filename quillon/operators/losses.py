"""KL penalties, policy and value losses, preference losses and loss aggregation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import clip

# Epsilon of masked means; bounds of the low-variance penalty and of its exponent.
MASK_EPS = 1e-8
LOW_VAR_CLAMP = 10.0


def kl_penalty(logp: Column, ref: Column, mode: str) -> Column:
    """kl, abs, mse or low_var_kl of the log-probabilities; the full penalty needs whole distributions: an error."""
    d = logp - ref
    if mode == "kl":
        return d
    if mode == "abs":
        return F.abs(d)
    if mode == "mse":
        return 0.5 * d * d
    if mode == "low_var_kl":
        return clip(F.exp(-d) + d - 1, -LOW_VAR_CLAMP, LOW_VAR_CLAMP)
    raise NotImplementedError(f"KL penalty {mode!r}")


def kl_reward(score: Column, logp: Column, ref: Column, mask: Column, beta: float, mode: str = "kl") -> Column:
    """score - beta KL, on masked tokens."""
    return score - beta * kl_penalty(logp, ref, mode) * mask


def policy_loss(logp: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> dict[str, Column]:
    """Dual-clip terms for each token: loss, clipped (0/1), kl and clipped_low (0/1)."""
    ratio = F.exp(logp - old)
    plain, bounded = -advantage * ratio, -advantage * clip(ratio, 1 - low, 1 + high)
    upper = F.greatest(plain, bounded)
    floor = -advantage * c
    lower = F.least(floor, upper)
    return {
        "loss": F.when(advantage < 0, lower).otherwise(upper), "clipped": (bounded > plain).cast("int"), "kl": old - logp,
        "clipped_low": ((upper > floor) & (advantage < 0)).cast("int"),
    }


def value_loss(pred: Column, value: Column, ret: Column, bound: float = 0.5) -> dict[str, Column]:
    """Greater of the plain and the clipped squared error (no half), and whether the clipped one is greater."""
    near = F.greatest(F.least(pred, value + bound), value - bound)
    a, b = F.pow(pred - ret, 2), F.pow(near - ret, 2)
    return {"loss": F.greatest(a, b), "clipped": (b > a).cast("int")}


AGGREGATIONS = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def aggregate_loss(tokens: DataFrame, loss: str, mask: str, mode: str, row: str = "row_id") -> DataFrame:
    """One row (loss): the tokens' losses under one of AGGREGATIONS; the last divides by the greatest padded length."""
    if mode not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {mode!r}: one of {AGGREGATIONS}")
    x, m = F.col(loss) * F.col(mask), F.col(mask)
    if mode == "token-mean":
        return tokens.agg((F.sum(x) / (F.sum(m) + MASK_EPS)).alias("loss"))
    rows = tokens.groupBy(row).agg(F.sum(x).alias("s"), F.sum(m).alias("n"), F.count("*").alias("width"))
    if mode == "seq-mean-token-sum":
        return rows.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return rows.agg(F.avg(F.try_divide(F.col("s"), F.col("n"))).alias("loss"))
    return rows.agg((F.sum("s") / F.max("width")).alias("loss"))


def aggregate_losses(tokens: DataFrame, loss: str, mask: str, row: str = "row_id") -> DataFrame:
    """(mode, loss): the tokens' losses under all of AGGREGATIONS, in one pass."""
    x, m = F.col(loss) * F.col(mask), F.col(mask)
    rows = tokens.groupBy(row).agg(F.sum(x).alias("s"), F.sum(m).alias("n"), F.count("*").alias("width"))
    each = (F.sum("s") / (F.sum("n") + MASK_EPS), F.avg("s"), F.avg(F.try_divide(F.col("s"), F.col("n"))), F.sum("s") / F.max("width"))
    one = rows.agg(F.array(*(F.struct(F.lit(k).alias("mode"), v.alias("loss")) for k, v in zip(AGGREGATIONS, each))).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.mode", "x.loss")


def adaptive_kl(steps: DataFrame, step: str, kl: str, n: str, beta: float, target: float, horizon: float) -> DataFrame:
    """steps with beta after each: beta *= 1 + clip(kl / target - 1, ±0.2) n / horizon, in the order of step.

    The factors don't depend on beta, so the recursion is a running product; steps are few (one row a step).
    """
    factor = 1 + clip(F.col(kl) / target - 1, -0.2, 0.2) * F.col(n) / horizon
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("beta", beta * F.exp(F.sum(F.log(factor)).over(w)))


def sequence_logp(logps: Column, labels: Column, ignore: int = -100, average: bool = False) -> Column:
    """Sum or mean of the log-probabilities whose next label isn't ignored (labels are shifted by one)."""
    kept = F.zip_with(F.slice(logps, F.lit(1), F.greatest(F.size(logps) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, y: F.when(y != ignore, p))
    kept = F.filter(kept, lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(kept)) if average else total


def preference_pairs(rows: DataFrame, pair: str, order: str, score: str) -> DataFrame:
    """rows with chosen: of each pair the one with the higher score, the first at a tie. A pair of another size is an error."""
    g = rows.groupBy(pair).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))).alias("b"), F.count("*").alias("n"))
    ok = F.when(F.col("n") != 2, F.raise_error(F.lit("pairs must have two rows"))).otherwise(True)
    return rows.join(g, pair).where(ok).withColumn("chosen", F.col(order) == -F.col("b.o")).drop("b", "n")


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, kind: str = "sigmoid", smoothing: float = 0.0, reference_free: bool = False) -> Column:
    """Sigmoid loss with label smoothing, or the squared (ipo) one, of the log-ratio differences."""
    h = chosen - rejected - (F.lit(0.0) if reference_free else ref_chosen - ref_rejected)
    if kind == "ipo":
        return F.pow(h - 1 / (2 * beta), 2)
    if kind != "sigmoid":
        raise ValueError(f"unknown preference loss {kind!r}")
    log_sigmoid = lambda x: -F.log1p(F.exp(-F.abs(x))) + F.least(x, F.lit(0.0))
    return -log_sigmoid(beta * h) * (1 - smoothing) - log_sigmoid(-beta * h) * smoothing


def pairwise_accuracy(rows: DataFrame, group: str, order: str, q: str, acc: str) -> DataFrame:
    """(group, accuracy): agreement of the order by q with that by acc over the group's pairs, weighted by |Δacc|;
    0.5 where all acc are equal.

    No pairs are listed. Each row counts, for each lower acc of its group, the rows of that acc with a lower q, by a
    running count in the order of q; so the work grows with the rows times the distinct acc of a group.
    """
    r = rows.select(group, F.col(q).alias("_q"), F.col(acc).alias("_x"))
    per = r.groupBy(group, "_x").agg(F.count("*").alias("_n"))
    below = Window.partitionBy(group).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("_n") * (F.col("_x") * F.coalesce(F.sum("_n").over(below), F.lit(0)) - F.coalesce(F.sum(F.col("_n") * F.col("_x")).over(below), F.lit(0.0)))
    weight = per.withColumn("_w", part).groupBy(group).agg(F.sum("_w").alias("w"))
    levels = per.select(group, F.col("_x").alias("_v"))
    at = r.join(levels, group).where("_v <= _x")
    running = F.sum(F.when(F.col("_v") == F.col("_x"), 1).otherwise(0)).over(Window.partitionBy(group, "_v").orderBy("_q").rangeBetween(Window.unboundedPreceding, 0))
    here = F.sum(F.when(F.col("_v") == F.col("_x"), 1).otherwise(0)).over(Window.partitionBy(group, "_v", "_q"))
    agree = at.withColumn("_c", running - here).where("_v < _x").groupBy(group).agg(F.sum(F.col("_c") * (F.col("_x") - F.col("_v"))).alias("a"))
    share = F.try_divide(F.coalesce("a", F.lit(0.0)), F.when(F.col("w") > 0, F.col("w")))
    return weight.join(agree, group, "left").select(group, F.coalesce(share, F.lit(0.5)).alias("accuracy"))


def sign_accuracy(q: Column, acc: Column) -> Column:
    """1 where the sign of q says whether acc is positive, else 0."""
    return ((q > 0) == (acc > 0)).cast("double")


def soft_mean(rows: DataFrame, value: str, beta: float) -> DataFrame:
    """One row (soft_mean): (logsumexp(beta x) - ln n) / beta over the whole batch; the mean at beta 0."""
    if beta == 0:
        return rows.agg(F.avg(value).alias("soft_mean"))
    top = rows.agg(F.max(beta * F.col(value)).alias("_m"))
    s = rows.crossJoin(F.broadcast(top)).agg(F.first("_m").alias("m"), F.sum(F.exp(beta * F.col(value) - F.col("_m"))).alias("s"), F.count("*").alias("n"))
    return s.select(((F.col("m") + F.log("s") - F.log("n")) / beta).alias("soft_mean"))


def squared_preference(logp: Column, old: Column, reward: Column, eta: float) -> Column:
    """(Δlogp - eta reward)²."""
    return F.pow(logp - old - eta * reward, 2)


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to most - buffer tokens, then a linear penalty."""
    return F.least(-(length - (most - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def other_mean(rows: DataFrame, group: str, q: str, acc: str) -> DataFrame:
    """rows with other_q: mean q of the group's rows with lower acc (for acc > 0) or higher acc (else), 0 if none.

    Group members only differ by acc here, so means are taken per (group, acc) before they are joined.
    """
    per = rows.groupBy(group, F.col(acc).alias("_x")).agg(F.sum(q).alias("_s"), F.count("*").alias("_n"))
    pairs = per.toDF(group, "_y", "_s", "_n").join(per.select(group, F.col("_x")), group)
    side = F.when(F.col("_x") > 0, F.col("_y") < F.col("_x")).otherwise(F.col("_y") > F.col("_x"))
    m = pairs.where(side).groupBy(group, "_x").agg((F.sum("_s") / F.sum("_n")).alias("other_q"))
    return rows.join(m.withColumnRenamed("_x", acc), [group, acc], "left").withColumn("other_q", F.coalesce("other_q", F.lit(0.0)))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of an array of logits."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    weighted = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top) * x)
    return F.log(z) + top - weighted / z


def token_logp(logits: Column, label: Column) -> Column:
    """Log-probability of the label (0-based) under an array of logits."""
    top = F.array_max(logits)
    return F.get(logits, label) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def reward_model_loss(q: Column, acc: Column, beta: float) -> Column:
    """Binary cross-entropy of sigmoid(beta q) against acc, in the form that doesn't overflow."""
    z = beta * q
    return F.greatest(z, F.lit(0.0)) - z * acc + F.log1p(F.exp(-F.abs(z)))


def detached_preference_loss(q: Column, other: Column, acc: Column, beta: float) -> Column:
    """-log sigmoid(beta (q - other) ±1), the sign by whether acc is positive; other is the other side's mean."""
    z = beta * (q - other) * F.when(acc > 0, 1.0).otherwise(-1.0)
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))


def best_of_n_weights(rows: DataFrame, group: str, value: str, out: str = "weight") -> DataFrame:
    """rows with n P(value <= own)^(n - 1) inside their group of n: by value q or acc, the two kinds of weights."""
    per = rows.groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # over distinct values
    share = per.select(F.col(group).alias("_g"), "_v", F.sum("_c").over(up).alias("_le"), F.sum("_c").over(Window.partitionBy(group)).alias("_n"))
    joined = rows.join(share, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v")))
    return joined.withColumn(out, F.col("_n") * F.pow(F.col("_le") / F.col("_n"), F.col("_n") - 1)).drop("_g", "_v", "_le", "_n")
