"""Deterministic splits and samples, group filters and weighted resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.staging import stage


RANGE_ROWS = 1_000_000  # in one range of a sort
DRIVER_ROWS = 100_000  # that may be picked by a heap on the driver; more are picked by their positions


def ranges_for(df: DataFrame) -> int:
    """How many ranges a sort of df is cut into: as many as cores, and more as its rows ask. (Spark's estimates of sizes
    are off by orders of magnitude behind joins.)"""
    return max(2, df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RANGE_ROWS))


def ranged(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df as a staged table sorted in ranges, with _p and _i: the range of each row and its place there."""
    r = df.repartitionByRange(ranges_for(df), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # a table, since the ranges are drawn anew each time the plan runs
    return stage(r.withColumns({"_p": F.shiftright("_id", 33), "_i": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), name)


def before_each(per_range: DataFrame, value: str, out: str) -> DataFrame:
    """(_p, out): the sum of value over the ranges before each; per_range has one row for each range."""
    return per_range.select("_p", F.coalesce(F.sum(value).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(out))


def with_position(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """df with its rows' positions 0, 1, … in the given total order, without sorting everything in one task.

    Rows are range-partitioned and counted per range; a range's rows are numbered from the sum of the counts before it.
    """
    r = ranged(df, order, "positions")
    before = before_each(r.groupBy("_p").agg(F.count("*").alias("_n")), "_n", "_b")
    return r.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of a total order: from the driver's heap while n is small, else by position."""
    if n <= DRIVER_ROWS:
        return df.orderBy(*order).limit(n)
    return with_position(df, order, "_at").where(F.col("_at") < n).drop("_at")


def top_rows(df: DataFrame, group: str, order: list[Column | str], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their rank from 1; each task keeps k rows of a group before
    the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(out) <= k)


def ordered_within(df: DataFrame, key: str, order: list[str], out: str = "place") -> DataFrame:
    """df with each row's place 1, 2, … among the rows of its key, in a total order; a frequent key is spread over ranges."""
    p = with_position(df, [key, *order], "_at")
    first = p.groupBy(F.col(key).alias("_k")).agg(F.min("_at").alias("_first"))
    return p.join(first, F.col(key).eqNullSafe(F.col("_k"))).withColumn(out, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", "_k")


def running_sums(df: DataFrame, key: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """df with sums over the rows of its key up to each row, in a total order.

    Sums run inside ranges; where a key goes on over several ranges, the sums of its earlier ranges are added. Those are
    at most two keys for each range, so that neither a frequent key nor many keys burden one task.
    """
    r = ranged(df.withColumns({f"_v_{k}": v for k, v in values.items()}), [key, *order], "running")
    inside = Window.partitionBy("_p", key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    ends = r.groupBy("_p").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"))
    at = r.join(F.broadcast(ends), "_p")
    edge = at.where("_i = _lo or _i = _hi").select("_p", F.col(key).alias("__k")).distinct()
    several = edge.groupBy("__k").agg(F.count("*").alias("n")).where("n > 1").select("__k")
    total = r.join(F.broadcast(several), F.col(key).eqNullSafe(F.col("__k"))).groupBy("_p", "__k").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values))
    earlier = Window.partitionBy("__k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(F.col("_p").alias("__q"), "__k", *(F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_c_{k}") for k in values))
    out = r.withColumns({f"_w_{k}": F.sum(f"_v_{k}").over(inside) for k in values}).join(F.broadcast(carried), (F.col("_p") == F.col("__q")) & F.col(key).eqNullSafe(F.col("__k")), "left")
    out = out.withColumns({k: F.col(f"_w_{k}") + F.coalesce(f"_c_{k}", F.lit(0)) for k in values})
    return out.drop("_p", "_i", "__q", "__k", *(f"_{x}_{k}" for k in values for x in "vwc"))


def hash_order(key: Column | str, seed: int) -> Column:
    """A reproducible shuffle key that other engines can compute too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def exact_split(df: DataFrame, key: str, test_size: int, seed: int = 42) -> DataFrame:
    """df with split: exactly test_size rows are test, the rest train; the same rows for the same seed."""
    cut = first_rows(df.select(hash_order(key, seed).alias("h"), F.col(key).alias("_k")), ["h", "_k"], test_size)
    return df.join(cut.select(F.col("_k").alias(key), F.lit("test").alias("split")), key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def percent_slice(df: DataFrame, order: str, start: float, end: float) -> DataFrame:
    """Rows from start to end per cent of the order."""
    p = with_position(df, [order], "_pos")
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    return p.crossJoin(n).where((F.col("_pos") >= F.round(F.col("_n") * start / 100)) & (F.col("_pos") < F.round(F.col("_n") * end / 100))).drop("_pos", "_n")


def sample_elements(array: Column, key: Column, k: int, seed: int = 42) -> Column:
    """k elements of an array without replacement, in hash order; all if there are fewer."""
    keyed = F.transform(array, lambda x, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["x"])


def informative_groups(rows: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows of groups whose metric varies, and of groups of one."""
    g = rows.groupBy(group).agg((F.max(metric) > F.min(metric)).alias("v"), F.count("*").alias("n")).where("v or n = 1").select(group)
    return rows.join(g, group, "left_semi")


def banded_groups(rows: DataFrame, group: str, acc: str, length: str, low: float, high: float, most: int) -> DataFrame:
    """rows with kept: the group's mean acc lies in the band and no response reaches the length limit."""
    g = rows.groupBy(group).agg(F.avg(acc).alias("a"), F.max(length).alias("l"))
    return rows.join(g, group).withColumn("kept", (F.col("a") >= low) & (F.col("a") <= high) & (F.col("l") < most - 1)).drop("a", "l")


def downsample_groups(rows: DataFrame, group: str, kept: str, factor: float) -> DataFrame:
    """Whole groups, kept ones first, then by group, as many as groups // factor."""
    g = rows.groupBy(group).agg(F.bool_and(kept).alias("_k"))
    n = int(g.count() // factor)
    return rows.join(first_rows(g, [F.desc("_k"), group], n).select(group), group, "left_semi")


def accumulate_groups(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Rows of the first `size` groups by key; an error if there are fewer."""
    g = first_rows(rows.select(group).distinct(), [group], size)
    if (found := g.count()) < size:
        raise ValueError(f"{found} groups, {size} wanted")
    return rows.join(g, group, "left_semi")


def resampling_weights(rows: DataFrame, score: str, kind: str, power: float = 2.0, out: str = "weight") -> DataFrame:
    """rows with weight: |score|^power; 1 for the extremes (max_min), else 0; or 0.4 for them and 0.1 (max_random)."""
    if kind == "pow":
        return rows.withColumn(out, F.pow(F.abs(score), power))
    e = rows.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    top, low = F.col(score) == F.col("_hi"), F.col(score) == F.col("_lo")
    w = F.when(top | low, 1.0).otherwise(0.0) if kind == "max_min" else F.when(top, 0.4).otherwise(0.1) if kind == "max_random" else None
    if w is None:
        raise ValueError(f"unknown weights {kind!r}")
    return rows.crossJoin(F.broadcast(e)).withColumn(out, w).drop("_hi", "_lo")


def resample(rows: DataFrame, key: str, weight: str, seed: int = 42) -> DataFrame:
    """(draw, key): as many draws with replacement as rows, by the inverse of the cumulative weights (+ 1e-8).

    Rows begin where the weights before them end. Beginnings and draws are sorted together in ranges, and each draw gets
    the last row that begins at or before it, from its own range or the last of the ranges before. Keys must be unique.
    """
    w = running_sums(rows.select(F.col(key).alias("_k"), (F.col(weight) + 1e-8).alias("_w"), F.lit(0).alias("_g")), "_g", ["_k"], {"_end": F.col("_w")})
    w = stage(w.select("_k", (F.col("_end") - F.col("_w")).alias("_x"), "_end"), "cumulative")
    whole = F.broadcast(w.agg(F.max("_end").alias("_all")))
    u = F.conv(F.left(hash_order(key, seed), F.lit(12)), 16, 10).cast("bigint") / F.lit(float(16**12))
    draws = rows.select(F.col(key).alias("_draw"), u.alias("_u")).crossJoin(whole).select((F.col("_u") * F.col("_all")).alias("_x"), F.lit(1).alias("_kind"), "_draw", F.lit(None).cast(w.schema["_k"].dataType).alias("_k"))
    both = w.select("_x", F.lit(0).alias("_kind"), F.lit(None).cast(draws.schema["_draw"].dataType).alias("_draw"), "_k").unionByName(draws)
    r = ranged(both, ["_x", "_kind", "_k", "_draw"], "draws")
    last = r.where("_kind = 0").groupBy("_p").agg(F.max_by("_k", "_i").alias("_last"))
    parts = r.select("_p").distinct().join(last, "_p", "left")
    carried = parts.select("_p", F.last("_last", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.last(F.when(F.col("_kind") == 0, F.col("_k")), ignorenulls=True).over(Window.partitionBy("_p").orderBy("_i"))
    found = r.withColumn("_own", inside).where("_kind = 1").join(F.broadcast(carried), "_p")
    return found.select(F.col("_draw").alias("draw"), F.coalesce("_own", "_before").alias(key))


def distributed_sampler(df: DataFrame, key: str, ranks: int, seed: int = 42, epoch: int = 0, shuffle: bool = True, drop_last: bool = False) -> DataFrame:
    """(rank, place, key): each rank's rows of an epoch, as many for each: the order is dealt out in turn, filled up from
    its own start (or, with drop_last, cut) to a multiple of the ranks."""
    p = with_position(df.select(key, hash_order(key, seed + epoch).alias("_h")), ["_h", key] if shuffle else [key], "_at").drop("_h")
    n = p.count()
    total = n // ranks * ranks if drop_last else -(-n // ranks) * ranks
    if n == 0:
        return p.select(F.lit(0).alias("rank"), F.lit(0).cast("long").alias("place"), key).limit(0)
    times = -(-total // n)
    dealt = p.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("_at", F.col("_at") + F.col("_k") * n).where(F.col("_at") < total)
    return dealt.select((F.col("_at") % ranks).cast("int").alias("rank"), F.expr(f"_at div {ranks}").alias("place"), key)


def batch_numbers(df: DataFrame, key: str, size: int, seed: int = 42, drop_last: bool = True, epoch: int = 0, shuffle: bool = True, divide: bool = False) -> DataFrame:
    """df with batch: consecutive batches of `size` rows, in a shuffled order or that of the key; an incomplete last one
    is dropped or, if the rows must divide, an error."""
    if divide and (n := df.count()) % size:
        raise ValueError(f"{n} rows don't divide into batches of {size}")
    p = with_position(df.withColumn("_h", hash_order(key, seed + epoch)), ["_h", key] if shuffle else [key], "_pos").drop("_h").withColumn("batch", F.floor(F.col("_pos") / size))
    if drop_last:
        p = p.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n")))).where(F.col("batch") < F.floor(F.col("_n") / size)).drop("_n")
    return p.drop("_pos")
