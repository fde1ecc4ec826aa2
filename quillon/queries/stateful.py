"""Time windows and ordered state over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.columns import rounded
from quillon.plans.tables import table
from quillon.registry import query
from quillon.streaming import windows as S


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999' SECOND PRECEDING AND CURRENT ROW) AS n_trailing FROM events")
def rate_limit_window(spark, folder):
    return S.trailing_counts(table(spark, folder, "events"), "user_id", "ts").select("event_id", "n_trailing")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def running_metric(spark, folder):
    return S.running_mean(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", rounded("running").alias("running"))


@query("SELECT epoch(time_bucket(INTERVAL '5 minutes', ts::TIMESTAMP))::BIGINT AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def tumbling_windows(spark, folder):
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed_means(e, "ts", "event_type", "value").select(F.unix_seconds("start").alias("start"), "event_type", "n", rounded("mean").alias("mean"))


_SESSIONS = """SELECT event_id, (CASE WHEN value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) THEN 0.0 ELSE -0.05 END)::DOUBLE AS penalty FROM events"""


@query(_SESSIONS)
def tool_session_penalty(spark, folder):
    """The table form of the keyed session state."""
    return S.session_penalties(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "penalty")


@query(_SESSIONS)
def tool_session_stream(spark, folder):
    """The same on a stream of the table, with state kept by user."""
    import uuid

    from quillon.plans.staging import shared_folder

    source = f"{folder}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{folder}/events.parque[t]")
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    q = S.tool_penalties(stream, "user_id").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "penalty")
