"""Splits, samples, group filters, resampling and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.columns import rounded
from quillon.operators import balance as B
from quillon.operators import sampling as S
from quillon.plans.tables import table
from quillon.queries.roles import ROLLOUTS, rollouts
from quillon.registry import query


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= 100 THEN 'test' ELSE 'train' END AS split FROM documents")
def exact_split(spark, folder):
    return S.exact_split(table(spark, folder, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) WHERE p >= round(n * 0.75)")
def percent_split(spark, folder):
    return S.percent_slice(table(spark, folder, "documents").select("doc_id"), "doc_id", 75, 100)


@query(
    """WITH t AS (SELECT task_id, unnest(range(json_array_length(solutions)::BIGINT)) AS i, solutions FROM tasks WHERE json_valid(solutions)),
    r AS (SELECT task_id, json_extract_string(solutions, '$[' || i || ']') AS s, row_number() OVER (PARTITION BY task_id ORDER BY md5(concat_ws(':', '42', task_id::VARCHAR, i::VARCHAR))) AS k FROM t)
    SELECT task_id, list(s ORDER BY k) AS picked FROM r WHERE k <= 2 GROUP BY task_id"""
)
def seeded_sample(spark, folder):
    """Up to two solutions of each task."""
    t = table(spark, folder, "tasks").select("task_id", F.from_json("solutions", "array<string>").alias("s")).where("size(s) > 0")
    return t.select("task_id", S.sample_elements(F.col("s"), F.col("task_id"), 2).alias("picked"))


@query(ROLLOUTS + "SELECT row_id, uid, round(score, 6) AS score FROM ro QUALIFY max(score) OVER (PARTITION BY uid) > min(score) OVER (PARTITION BY uid) OR count(*) OVER (PARTITION BY uid) = 1")
def group_filter_dapo(spark, folder):
    r = S.informative_groups(rollouts(spark, folder), "uid", "score")
    return r.select("row_id", "uid", rounded("score").alias("score"))


_BAND = ROLLOUTS.rstrip() + """, x AS (SELECT *, (row_id % 3) / 2.0 AS acc, row_id % 500 AS len FROM ro), k AS (SELECT *, avg(acc) OVER w BETWEEN 0.2 AND 0.8 AND max(len) OVER w < 499 AS kept FROM x WINDOW w AS (PARTITION BY uid))
"""


@query(_BAND + "SELECT row_id, uid, kept FROM k")
def band_filter_prime(spark, folder):
    r = rollouts(spark, folder).withColumns({"acc": (F.col("row_id") % 3) / 2.0, "len": F.col("row_id") % 500})
    return S.banded_groups(r, "uid", "acc", "len", 0.2, 0.8, 500).select("row_id", "uid", "kept")


@query(_BAND + ", g AS (SELECT uid, bool_and(kept) AS k FROM k GROUP BY ALL), t AS (SELECT uid FROM g ORDER BY k DESC, uid LIMIT (SELECT count(*) // 2 FROM g)) SELECT row_id, uid, kept FROM k WHERE uid IN (FROM t)")
def downsample_prime(spark, folder):
    return S.downsample_groups(band_filter_prime(spark, folder), "uid", "kept", 2)


@query(ROLLOUTS + "SELECT row_id, uid FROM ro WHERE uid IN (SELECT DISTINCT uid FROM ro ORDER BY uid LIMIT 64)")
def accumulate_groups(spark, folder):
    return S.accumulate_groups(rollouts(spark, folder).select("row_id", "uid"), "uid", 64)


@query(ROLLOUTS + "SELECT row_id, round(score * score, 6) AS by_power, CASE WHEN score = (SELECT max(score) FROM ro) OR score = (SELECT min(score) FROM ro) THEN 1.0 ELSE 0.0 END::DOUBLE AS max_min, CASE WHEN score = (SELECT max(score) FROM ro) THEN 0.4 ELSE 0.1 END::DOUBLE AS max_random FROM ro")
def pfppo_weights(spark, folder):
    r = S.resampling_weights(rollouts(spark, folder), "score", "pow", out="by_power")
    r = S.resampling_weights(S.resampling_weights(r, "score", "max_min", out="max_min"), "score", "max_random", out="max_random")
    return r.select("row_id", rounded("by_power").alias("by_power"), "max_min", "max_random")


@query(
    ROLLOUTS.rstrip() + """, w AS (SELECT row_id, score * score + 1e-8 AS w, sum(score * score + 1e-8) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS hi FROM ro), e AS (SELECT row_id, hi - w AS lo FROM w),
    d AS (SELECT row_id AS draw, ('0x' || left(md5('42:' || row_id), 12))::BIGINT / power(16, 12) * (SELECT max(hi) FROM w) AS x FROM ro)
    SELECT draw, e.row_id FROM d ASOF JOIN e ON d.x >= e.lo"""
)
def pfppo_resample(spark, folder):
    return S.resample(S.resampling_weights(rollouts(spark, folder), "score", "pow"), "row_id", "weight")


@query("SELECT p_partkey, (row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1) // 128 AS batch FROM part QUALIFY (row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1) // 128 < count(*) OVER () // 128")
def shuffled_batches(spark, folder):
    return S.batch_numbers(table(spark, folder, "part").select("p_partkey"), "p_partkey", 128)


@query("SELECT coalesce(source, '') AS source, least(count(*), ceil(sum(coalesce(length(text), 0)) / 4096.0))::BIGINT AS n FROM documents GROUP BY ALL")
def microbatch_count(spark, folder):
    d = table(spark, folder, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    return B.micro_batch_counts(d, "source", "n_chars", 4096)


@query(
    """WITH o AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders)
    SELECT batch, count(*) AS n_rows, least(8, count(*))::BIGINT AS n_parts, CASE WHEN count(*) = 64 THEN 8 END::BIGINT AS in_each FROM o GROUP BY ALL"""
)
def kk_partitions(spark, folder):
    """Batches of 64 orders in 8 parts of similar price, of equal size but in an incomplete last batch: what comes out."""
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("bigint").alias("len"))
    o = S.with_position(o, ["o_orderkey"], "_at").withColumn("batch", F.expr("_at div 64")).drop("_at")
    n = o.count()
    parts = B.balanced(o.where(F.col("batch") < n // 64), "batch", "o_orderkey", "len", 8, equal_size=True)
    if n % 64:
        parts = parts.union(B.balanced(o.where(F.col("batch") == n // 64), "batch", "o_orderkey", "len", min(8, n % 64)))
    sizes = parts.groupBy("batch", "part").agg(F.countDistinct("o_orderkey").alias("n"))
    each = F.when((F.sum("n") == 64) & (F.min("n") == F.max("n")), F.min("n"))
    return sizes.groupBy("batch").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_parts"), each.alias("in_each"))


@query("SELECT DISTINCT request_id, batch_data_id FROM rollout_requests WHERE request_id NOT IN (SELECT request_id FROM messages WHERE lower(trim(role)) = 'assistant' AND request_id IS NOT NULL)")
def uncached_requests(spark, folder):
    """Requests without a recorded response."""
    from quillon.functions.columns import stripped
    from quillon.sources.io import missing

    requests = table(spark, folder, "rollout_requests").select("request_id", "batch_data_id").distinct()
    return missing(requests, table(spark, folder, "messages").where(F.lower(stripped("role")) == "assistant").select("request_id"), "request_id")


@query("SELECT request_id, rollout_offset, batch_data_id, row_number() OVER (PARTITION BY batch_data_id ORDER BY rollout_offset, request_id) AS place FROM (SELECT DISTINCT request_id, rollout_offset, batch_data_id FROM rollout_requests)")
def restore_order(spark, folder):
    """Finished requests back in the order of their batch."""
    r = table(spark, folder, "rollout_requests").select("request_id", "rollout_offset", "batch_data_id").distinct()
    return S.ordered_within(r, "batch_data_id", ["rollout_offset", "request_id"])
