"""Validation, training, timing and throughput metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Epsilon of the explained variance; resamples and seed of the bootstrap.
VAR_EPS = 1e-5
RESAMPLES, SEED = 1000, 42


def reduce_metrics(metrics: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, value): the maximum if the name holds "max", else the minimum if it holds "min", else the mean; NaN if
    there is no value."""
    low = F.col(name)  # the case counts
    agg = metrics.groupBy(name).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg(value).alias("mean"))
    pick = F.when(low.contains("max"), F.col("hi")).when(low.contains("min"), F.col("lo")).otherwise(F.col("mean"))
    return agg.select(name, F.coalesce(pick, F.lit(float("nan"))).alias(value))


def mean_std(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, std) with the population deviation."""
    return samples.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def subset_sizes(n: Column) -> Column:
    """Array of 2, 4, 8, … below n, and n itself; none for n < 2."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.shiftleft(F.lit(1).cast("bigint"), 1) * F.pow(F.lit(2.0), k - 1).cast("bigint")), lambda p: p < n)
    return F.when(n > 1, F.array_distinct(F.concat(powers, F.array(n.cast("bigint"))))).otherwise(F.array().cast("array<bigint>"))


def best_worst_at(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, k, best_mean, best_std, worst_mean, worst_std) over draws of k with replacement, exactly.

    With x sorted, the greatest of k draws is the i-th with probability (i/n)^k - ((i-1)/n)^k; no resampling.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    r = samples.withColumns({"_n": n, "_i": i}).withColumn("k", F.explode(subset_sizes(F.col("_n"))))
    cdf = lambda j: F.pow(j / F.col("_n"), F.col("k"))
    up = cdf(F.col("_i")) - cdf(F.col("_i") - 1)
    down = cdf(F.col("_n") - F.col("_i") + 1) - cdf(F.col("_n") - F.col("_i"))
    v = F.col(value)
    agg = r.groupBy(*keys, "k").agg(F.sum(v * up).alias("best_mean"), F.sum(v * v * up).alias("_b2"), F.sum(v * down).alias("worst_mean"), F.sum(v * v * down).alias("_w2"))
    dev = lambda m, m2: F.sqrt(F.greatest(F.col(m2) - F.col(m) * F.col(m), F.lit(0.0)))
    return agg.select(*keys, "k", "best_mean", dev("best_mean", "_b2").alias("best_std"), "worst_mean", dev("worst_mean", "_w2").alias("worst_std"))


def _draws(n: int, k: int, resamples: int, seed: int) -> np.ndarray:
    """Draws of k of n with replacement: all there are, if they are at most `resamples`, else so many, seeded."""
    if n**k <= resamples:
        return np.indices((n,) * k).reshape(k, -1).T
    return np.random.default_rng(seed).integers(0, n, (resamples, k))


def bootstrap(samples: DataFrame, keys: list[str], value: str, k: int, resamples: int = RESAMPLES, seed: int = SEED, reducers: dict[str, Callable] | None = None) -> DataFrame:
    """(keys, {name}_mean, {name}_std) over draws (see _draws), for each reducer: a function of an array and its axis.

    Without reducers they are mean and max; best_worst_at() gives the exact values of the greatest and least.
    """
    reducers = reducers or {"mean": np.mean, "max": np.max}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g[value].to_numpy(float)
        draws = x[_draws(len(x), k, resamples, seed)]
        found = [f(draws, axis=1) for f in reducers.values()]
        return pd.DataFrame([[*g[keys].iloc[0], *(v for d in found for v in (d.mean(), d.std()))]], columns=[*keys, *(f"{n}_{m}" for n in reducers for m in ("mean", "std"))])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keys).schema)
    return samples.select(*keys, value).groupBy(*keys).applyInPandas(run, kinds + "".join(f", {n}_{m} double" for n in reducers for m in ("mean", "std")))


def majority(samples: DataFrame, keys: list[str], vote: str, value: str, order: str) -> DataFrame:
    """(keys, vote, value): the most frequent vote, the first seen at a tie, with the value of its first occurrence."""
    v = samples.groupBy(*keys, vote).agg(F.count("*").alias("n"), F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("first"))
    best = v.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first.o")).alias("o"), F.col(vote).alias("vote"), F.col("first.v").alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.vote").alias(vote), F.col("b.v").alias(value))


def _majorities(g: pd.DataFrame, vote: str, value: str, order: str, sizes: list[int], resamples: int, seed: int) -> list[tuple[int, float, float]]:
    """(k, mean, std) of the value of the most frequent vote, the first drawn at a tie, over draws (see _draws)."""
    g = g.sort_values(order)
    codes, x = pd.factorize(g[vote], use_na_sentinel=False)[0], g[value].to_numpy(float)
    out = []
    for k in sizes:
        d = _draws(len(x), k, resamples, seed)
        c = codes[d]
        n = (c[:, :, None] == c[:, None, :]).sum(axis=2)  # how often each drawn vote was drawn
        first = n.argmax(axis=1)  # the earliest of the most frequent
        picked = x[d[np.arange(len(d)), first]]
        out.append((k, picked.mean(), picked.std()))
    return out


def majority_at(samples: DataFrame, keys: list[str], vote: str, value: str, order: str, k: int, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(keys, mean, std) of the majority's value over draws of k with replacement (see _draws)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*g[keys].iloc[0], *_majorities(g, vote, value, order, [k], resamples, seed)[0][1:]]], columns=[*keys, "mean", "std"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keys).schema)
    return samples.select(*keys, vote, value, order).groupBy(*keys).applyInPandas(run, f"{kinds}, mean double, std double")


def majorities_at(samples: DataFrame, keys: list[str], vote: str, value: str, order: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(keys, k, mean, std): majority_at for k = 2, 4, … and all of a group's rows; groups of one have none."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n = len(g)
        sizes = [2**j for j in range(1, n.bit_length() + 1) if 2**j < n] + [n] if n > 1 else []
        return pd.DataFrame([[*g[keys].iloc[0], *m] for m in _majorities(g, vote, value, order, sizes, resamples, seed)], columns=[*keys, "k", "mean", "std"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keys).schema)
    return samples.select(*keys, vote, value, order).groupBy(*keys).applyInPandas(run, f"{kinds}, k long, mean double, std double")


def core_or_auxiliary(metrics: DataFrame, variable: str, metric: str) -> DataFrame:
    """metrics with section: val-core for mean, maj or best at the greatest n of acc (or of reward without acc), else val-aux."""
    head = F.max(F.when(F.col(variable) == "acc", 1).otherwise(0))
    has_acc = metrics.groupBy("data_source").agg(head.alias("_acc"))
    most = metrics.groupBy("data_source").agg(F.max(F.regexp_extract(metric, r"@(\d+)", 1).try_cast("int")).alias("_n"))
    m = metrics.join(has_acc, "data_source").join(most, "data_source")
    core = (F.col(variable) == F.when(F.col("_acc") == 1, "acc").otherwise("reward")) & F.col(metric).rlike("^(mean|maj|best)") & F.col(metric).contains(F.concat(F.lit("@"), F.col("_n").cast("string")))
    return m.withColumn("section", F.when(core, "val-core").otherwise("val-aux")).drop("_acc", "_n")


def sequence_summary(tokens: DataFrame, columns: list[str], mask: str = "mask", row: str = "row_id") -> DataFrame:
    """(name, mean, max, min) of the row sums of each column over masked tokens."""
    sums = tokens.groupBy(row).agg(*(F.sum(F.col(c) * F.col(mask)).alias(c) for c in columns))
    agg = sums.agg(*(F.struct(F.avg(c).alias("mean"), F.max(c).alias("max"), F.min(c).alias("min")).alias(c) for c in columns))
    return agg.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("s")) for c in columns))).alias("x")).select("x.name", "x.s.*")


def explained_variance(tokens: DataFrame, returns: str, values: str, mask: str = "mask") -> DataFrame:
    """One row (explained_variance): 1 - var(returns - values) / (var(returns) + 1e-5) over masked tokens."""
    t = tokens.where(F.col(mask) == 1)
    return t.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + VAR_EPS)).alias("explained_variance"))


def timing(sections: DataFrame, tokens: DataFrame) -> DataFrame:
    """sections (section, seconds) with ms_per_token, by the tokens of the section (section, n_tokens); NULL if unknown."""
    return sections.join(F.broadcast(tokens), "section", "left").select("section", "seconds", F.try_divide(F.col("seconds") * 1000, F.col("n_tokens")).alias("ms_per_token"))


def throughput(steps: DataFrame, devices: int) -> DataFrame:
    """steps (step, n_tokens, seconds) with throughput = tokens / (seconds * devices)."""
    return steps.withColumn("throughput", F.try_divide(F.col("n_tokens"), F.col("seconds") * devices))


def length_imbalance(rows: DataFrame, index: str, length: str, k: int) -> DataFrame:
    """One row: least, greatest sum and their difference over contiguous blocks of len // k rows, and the mean total / k."""
    n = rows.agg(F.count("*").alias("_n"))
    b = rows.crossJoin(F.broadcast(n)).groupBy(F.floor(F.col(index) / F.floor(F.col("_n") / k)).alias("b")).agg(F.sum(length).alias("s"))
    return b.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("gap"), (F.sum("s") / k).alias("mean"))


def probability_gap(tokens: DataFrame, a: str, b: str, mask: str = "mask") -> DataFrame:
    """One row (gap_max, gap_mean, gap_std): |exp a - exp b| over masked tokens."""
    t = tokens.where(F.col(mask) == 1).select(F.abs(F.exp(a) - F.exp(b)).alias("g"))
    return t.agg(F.max("g").alias("gap_max"), F.avg("g").alias("gap_mean"), F.stddev_samp("g").alias("gap_std"))


def _attention(c: dict) -> tuple[int, int]:
    """(parameters of one layer's projections, heads times their width)."""
    width = c.get("head_dim") or c["hidden_size"] // c["num_attention_heads"]
    q, kv = c["num_attention_heads"] * width, c["num_key_value_heads"] * width
    return c["hidden_size"] * (2 * q + 2 * kv), q


def _dense(c: dict) -> tuple[float, float]:
    linear, q = _attention(c)
    return (c["hidden_size"] * c["intermediate_size"] * 3 + linear) * c["num_hidden_layers"] + 2 * c["vocab_size"] * c["hidden_size"], q * c["num_hidden_layers"]


def _experts(c: dict) -> tuple[float, float]:
    linear, q = _attention(c)
    mlp = c["hidden_size"] * (c["num_experts_per_tok"] * c["moe_intermediate_size"] * 3 + c["num_experts"])
    return (mlp + linear) * c["num_hidden_layers"] + 2 * c["vocab_size"] * c["hidden_size"], q * c["num_hidden_layers"]


def _latent(c: dict) -> tuple[float, float]:
    h, heads, layers, first = c["hidden_size"], c["num_attention_heads"], c["num_hidden_layers"], c["first_k_dense_replace"]
    rope, nope = c["qk_rope_head_dim"], c["qk_nope_head_dim"]
    q = heads * (rope + nope)
    linear = h * q if c.get("q_lora_rank") is None else (h + q) * c["q_lora_rank"]
    linear += h * (c["kv_lora_rank"] + rope) + heads * (nope + c["v_head_dim"]) * c["kv_lora_rank"] + heads * c["v_head_dim"] * h
    sparse = h * c["n_routed_experts"] + h * c["moe_intermediate_size"] * (c["num_experts_per_tok"] + c["n_shared_experts"]) * 3
    return (sparse + linear) * (layers - first) + (h * c["intermediate_size"] * 3 + linear) * first + 2 * c["vocab_size"] * h, q * layers


#: (parameters that each token passes, factor of the squared lengths) by the kind of model.
SHAPES = {"qwen2": _dense, "llama": _dense, "qwen3_moe": _experts, "deepseek_v3": _latent}


def transformer_flops(lengths: DataFrame, length: str, *, dense: float, attention: float) -> DataFrame:
    """One row (flops): six per dense parameter and token, twelve per squared length and attention factor."""
    x = F.col(length).cast("double")
    return lengths.agg((6 * dense * F.sum(x) + 12 * attention * F.sum(x * x)).alias("flops"))


def model_flops(lengths: DataFrame, length: str, kind: str, config: dict) -> DataFrame:
    """One row (flops) for a model of the kind; 0 for an unknown kind."""
    if kind not in SHAPES:
        return lengths.agg(F.lit(0.0).alias("flops"))
    dense, attention = SHAPES[kind](config)
    return transformer_flops(lengths, length, dense=dense, attention=attention)


def coverage_percent(report: Column) -> Column:
    """The last percentage of the first line with TOTAL or solution.py that has one; 0 without one."""
    lines = F.filter(F.split(report, "\n"), lambda x: (x.contains("TOTAL") | x.contains("solution.py")) & x.rlike(r"\d%(\s|$)"))
    found = F.regexp_extract_all(F.get(lines, F.lit(0)), F.lit(r"(?:^|\s)(\d+\.?\d*)%(?=\s|$)"), F.lit(1))
    return F.when(report.isNotNull(), F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("double"), F.lit(0.0)))


def mutation_score(report: Column) -> Column:
    """(100 - surviving %) / 100; 1 where nothing is reported."""
    survived = F.regexp_extract(report, r"surviving mutants: \d+ \((\d+\.?\d*)%\)", 1)
    return (100 - F.coalesce(survived.try_cast("double"), F.lit(0.0))) / 100


def error_histogram(rows: DataFrame, error: str) -> DataFrame:
    """(kind, n): errors by what stands before the first colon, most frequent first."""
    kind = F.trim(F.split_part(F.col(error), F.lit(":"), F.lit(1)))
    return rows.where(F.col(error).isNotNull()).groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def log_line(metrics: DataFrame, step: str, name: str, value: str) -> DataFrame:
    """(step, line): "step:N - a:1.000 - b:2.000", names in order, three decimals."""
    item = F.concat(F.col(name), F.lit(":"), F.format_string("%.3f", F.col(value)))
    g = metrics.groupBy(step).agg(F.sort_array(F.collect_list(F.struct(name, item.alias("i")))).alias("s"))
    return g.select(step, F.concat(F.lit("step:"), F.col(step).cast("string"), F.lit(" - "), F.array_join(F.transform("s", lambda x: x["i"]), " - ")).alias("line"))


def merged_average(metrics: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, value): the mean over the rows that have the metric."""
    return metrics.groupBy(name).agg(F.avg(value).alias(value)).where(F.col(value).isNotNull())


def numeric_only(samples: DataFrame, variables: list[str]) -> list[str]:
    """Those of the variables that hold numbers or truth values; texts have no metrics."""
    kinds = dict(samples.dtypes)
    return [v for v in variables if kinds[v] not in ("string", "binary") and not kinds[v].startswith(("array", "struct", "map"))]


def spread(df: DataFrame, value: str) -> DataFrame:
    """One row (n, mean, max, min, std) with the sample deviation; partial sums are combined by Spark."""
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))


def plain_masked_mean(tokens: DataFrame, value: str, mask: str = "mask") -> DataFrame:
    """One row (mean): sum over masked tokens by their number, without an epsilon; NULL without any."""
    return tokens.agg(F.try_divide(F.sum(F.col(value) * F.col(mask)), F.sum(mask)).alias("mean"))


def kl_summary(tokens: DataFrame, kl: str, mask: str = "mask", row: str = "row_id") -> DataFrame:
    """One row (kl): the mean over rows of the mean over a row's masked tokens."""
    rows = tokens.groupBy(row).agg((F.sum(F.col(kl) * F.col(mask)) / (F.sum(mask) + 1e-8)).alias("_k"))
    return rows.agg(F.avg("_k").alias("kl"))


def _three(name: str, x: Column) -> list[tuple[str, Column]]:
    return [(f"{name}/mean", F.avg(x)), (f"{name}/max", F.max(x).cast("double")), (f"{name}/min", F.min(x).cast("double"))]


def _long(df: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    one = df.agg(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in pairs)).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.name", "x.value")


def data_metrics(tokens: DataFrame, lengths: DataFrame, most_prompt: int, most_response: int, critic: bool = True, row: str = "row_id") -> DataFrame:
    """(name, value): metrics of a training batch.

    tokens (row, mask, token_score, token_reward, advantage, returns[, value]) has one row for each token, lengths (row,
    prompt_length, response_length) one for each response. Scores and rewards are sums of a row; the rest is over masked
    tokens.
    """
    rows = tokens.groupBy(row).agg(F.sum("token_score").alias("s"), F.sum("token_reward").alias("r"))
    masked = lambda c: F.when(F.col("mask") == 1, F.col(c))
    of_tokens = [*_three("critic/advantages", masked("advantage")), *_three("critic/returns", masked("returns"))]
    if critic:
        left = F.var_samp(masked("returns") - masked("value")) / (F.var_samp(masked("returns")) + VAR_EPS)
        of_tokens += [*_three("critic/values", masked("value")), ("critic/vf_explained_var", 1 - left)]
    of_lengths = []
    for kind, most in (("response", most_response), ("prompt", most_prompt)):
        n = F.col(f"{kind}_length")
        of_lengths += [*_three(f"{kind}_length", n), (f"{kind}_length/clip_ratio", F.avg((n == most).cast("double")))]
    return _long(rows, [*_three("critic/score", F.col("s")), *_three("critic/rewards", F.col("r"))]).union(_long(tokens, of_tokens)).union(_long(lengths, of_lengths))


def preference_metrics(rows: DataFrame, most_prompt: int | None = None, most_response: int | None = None) -> DataFrame:
    """(name, value) of a preference batch: those of score, reward, dpo_logits, chosen_logps, rejected_logps,
    response_length and prompt_length that rows has."""
    there = set(rows.columns)
    pairs = []
    for name, c in (("reward/score", "score"), ("reward/rewards", "reward")):
        pairs += _three(name, F.col(c)) if c in there else []
    pairs += [(f"actor/{c}", F.avg(c)) for c in ("dpo_logits", "chosen_logps", "rejected_logps") if c in there]
    for kind, most in (("response", most_response), ("prompt", most_prompt)):
        if f"{kind}_length" in there:
            n = F.col(f"{kind}_length")
            pairs += [*_three(f"{kind}_length", n), (f"{kind}_length/clip_ratio", F.avg((n == most).cast("double")))]
    return _long(rows, pairs)


def validation_metrics(samples: DataFrame, source: str, prompt: str, order: str, variables: list[str], vote: str | None = None, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(data_source, variable, metric, value): per prompt the mean, deviation, best and worst of k, and with votes the
    majority of k, for k = 2, 4, … and all responses; then the mean over the source's prompts.

    Variables that hold texts have no metrics. Best and worst are exact (see best_worst_at), majorities are drawn.
    """
    keys, out = [source, prompt], []
    for v in numeric_only(samples, variables):
        s = samples.select(*keys, order, *([vote] if vote else []), F.col(v).cast("double").alias("_x"))
        n = s.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"))
        tag = F.col("n").cast("string")
        flat = [n.select(*keys, F.concat(F.lit("mean@"), tag).alias("metric"), F.col("mean").alias("value")), n.where("n > 1").select(*keys, F.concat(F.lit("std@"), tag).alias("metric"), F.col("std").alias("value"))]
        at = best_worst_at(s, keys, "_x")
        kinds = F.array(*(F.struct(F.concat(F.lit(f"{a}@"), F.col("k").cast("string"), F.lit(f"/{b}")).alias("metric"), F.col(f"{a}_{b}").alias("value")) for a in ("best", "worst") for b in ("mean", "std")))
        flat.append(at.select(*keys, F.explode(kinds).alias("x")).select(*keys, "x.metric", "x.value"))
        if vote:
            m = majorities_at(s, keys, vote, "_x", order, resamples, seed)
            kinds = F.array(*(F.struct(F.concat(F.lit("maj@"), F.col("k").cast("string"), F.lit(f"/{b}")).alias("metric"), F.col(b).alias("value")) for b in ("mean", "std")))
            flat.append(m.select(*keys, F.explode(kinds).alias("x")).select(*keys, "x.metric", "x.value"))
        for f in flat:
            out.append(f.withColumn("variable", F.lit(v)))
    if not out:
        raise ValueError("no variable holds numbers")
    long = out[0]
    for f in out[1:]:
        long = long.unionByName(f)
    return long.groupBy(F.col(source).alias("data_source"), "variable", "metric").agg(F.avg("value").alias("value"))


def balanced_loss(tokens: DataFrame, loss: str, mask: str, ranks: int, rank: str | None = None) -> DataFrame:
    """([rank,] loss): the masked sum by the valid tokens of the whole batch, times the ranks; their mean over the ranks
    is the loss of all tokens."""
    n = tokens.agg(F.sum(mask).alias("_n"))
    part = tokens.groupBy(*([rank] if rank else [])).agg(F.sum(F.col(loss) * F.col(mask)).alias("_s"))
    return part.crossJoin(F.broadcast(n)).select(*([rank] if rank else []), (F.col("_s") / (F.col("_n") + 1e-8) * ranks).alias("loss"))
