"""Rate limits, running metrics and keyed state, on streams and on tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.sampling import ranged, running_sums, with_position


def trailing_counts(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """events with n_trailing: how many of the key's events lie in the last `seconds` up to each.

    An event exactly that old is out; the frame ends a microsecond before. Each stretch of `seconds` of a key is counted
    apart, with the times of the stretch before it, so that a frequent key is spread over tasks. Events without a time
    count those of their key without one; a missing key is a key.
    """
    width = seconds * 1_000_000
    own = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumns({"_b": F.floor(F.col("_t") / width).cast("long"), "_own": F.lit(1)})
    times = own.where(F.col("_t").isNotNull()).select(key, "_t", (F.col("_b") + 1).alias("_b"), F.lit(0).alias("_own"))
    w = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-(width - 1), 0)
    both = own.unionByName(times, allowMissingColumns=True).withColumn("n_trailing", F.count("*").over(w))
    return both.where("_own = 1").drop("_t", "_b", "_own")


def running_mean(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """rows with the mean of value up to each row of its key; missing values don't count."""
    r = running_sums(rows, key, order, {"_sum": F.coalesce(F.col(value), F.lit(0.0)), "_n": F.when(F.col(value).isNull(), 0).otherwise(1)})
    return r.withColumn("running", F.try_divide("_sum", "_n")).drop("_sum", "_n")


def session_penalties(rows: DataFrame, key: str, order: list[str], value: str, penalty: float = -0.05) -> DataFrame:
    """rows with penalty: for each call of a session that doesn't improve on the session's best value before it.

    The table form of tool_penalties: a call improves if it is the first of its value among those that reach it, so the
    greatest value before it is found by ranges, with the greatest of the ranges before.
    """
    r = ranged(rows, [key, *order], "sessions")
    inside = F.max(value).over(Window.partitionBy("_p", key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    top = r.groupBy("_p", F.col(key).alias("_k")).agg(F.max(value).alias("_top"))
    several = top.groupBy(F.col("_k").alias("_s")).agg(F.count("*").alias("n")).where("n > 1").select("_s")
    carried = top.join(several, F.col("_k").eqNullSafe(F.col("_s"))).select(F.col("_p").alias("_q"), F.col("_k"), F.max("_top").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    r = r.withColumn("_best", inside).join(F.broadcast(carried), (F.col("_p") == F.col("_q")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    best = F.coalesce(F.greatest("_best", "_before"), F.lit(float("-inf")))
    return r.withColumn("penalty", F.when(F.col(value) > best, 0.0).otherwise(penalty)).drop("_p", "_i", "_best", "_q", "_k", "_before")


def windowed_means(stream: DataFrame, ts: str, key: str, value: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Tumbling windows of a stream (or a table): (start, key, n, mean); events later than `late` are dropped."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width), key)
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def _tool_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get[0] if state.exists else float("-inf")
    calls = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one session's calls of one micro-batch
    out = []
    for e, v in zip(calls["event_id"], calls["value"]):
        out.append((key[0], e, 0.0 if v > best else -0.05))
        best = max(best, v)
    yield pd.DataFrame(out, columns=["key", "event_id", "penalty"])
    state.update((best,))


def tool_penalties(stream: DataFrame, key: str) -> DataFrame:
    """(key, event_id, penalty): -0.05 for each call of a session that doesn't improve on its best value so far.

    The calls of a session in one micro-batch are taken in the order of ts and event_id.
    """
    rows = stream.select(F.col(key).alias("key"), "event_id", "ts", "value")
    return rows.groupBy("key").applyInPandasWithState(_tool_state, "key long, event_id long, penalty double", "best double", "append", GroupStateTimeout.NoTimeout)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def accumulate_until_full(stream: DataFrame, path: str, group: str, size: int, checkpoint: str):
    """Write batches of `size` distinct groups below path as the stream delivers them; the rest waits for more.

    Each micro-batch is kept under its own number and writes all batches that are full by then, the groups that came
    first before others, as full/step=<its number> with the batch's number in the column part. A group's rows up to the
    step that delivers it are delivered with it, once; later rows of it wait as a group of their own. What waits is
    told by earlier steps alone, so that a micro-batch run twice after a failure overwrites itself.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/pending/batch={number}")
        key = batch.schema[group].dataType.simpleString()
        waiting = spark.read.parquet(f"{path}/pending").where(F.col("batch") <= number)
        if _exists(spark, f"{path}/full"):
            full = spark.read.schema(f"`{group}` {key}, step long").parquet(f"{path}/full").where(F.col("step") < number)
            last = full.groupBy(F.col(group).alias("_g")).agg(F.max("step").alias("_step"))
            waiting = waiting.join(last, F.col(group).eqNullSafe(F.col("_g")) & (F.col("batch") <= F.col("_step")), "left_anti")
        groups = waiting.groupBy(F.col(group).alias("_g")).agg(F.min("batch").alias("_first"))
        n = groups.count() // size
        if n or _exists(spark, f"{path}/full/step={number}"):
            placed = with_position(groups, ["_first", "_g"], "_at").where(F.col("_at") < n * size)
            chosen = placed.select("_g", F.floor(F.col("_at") / size).alias("part"))
            waiting.join(chosen, F.col(group).eqNullSafe(F.col("_g"))).drop("batch", "_g").write.mode("overwrite").parquet(f"{path}/full/step={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
