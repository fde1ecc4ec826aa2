"""Token arrays of orders: ids are part keys modulo 100, masks the return flag."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import tokens as T
from quillon.functions.columns import rounded
from quillon.plans.tables import table
from quillon.registry import query

SEQ = """WITH x AS (SELECT l_orderkey AS row_id, l_partkey % 100 AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS t, l_quantity FROM lineitem),
s AS (SELECT row_id, list(id ORDER BY t) AS ids, list((t <= 3)::INT ORDER BY t) AS mask, sum(l_quantity) AS score FROM x GROUP BY row_id)
"""


def seqs(spark, folder):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    x = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("row_id"), (F.col("l_partkey") % 100).alias("id"), F.row_number().over(w).alias("t"), "l_quantity")
    g = x.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("s"), F.sum("l_quantity").alias("score"))
    return g.select("row_id", F.transform("s", lambda y: y["id"]).alias("ids"), F.transform("s", lambda y: (y["t"] <= 3).cast("int")).alias("mask"), "score")


@query(SEQ + ", p AS (SELECT *, list_position(list_transform(ids, lambda v: v IN (7, 13, 50)), true) AS first FROM s) SELECT row_id, list_transform(ids, lambda v, i: CASE WHEN first IS NULL OR first = 0 OR i <= first THEN 1 ELSE 0 END) AS mask FROM p")
def response_mask(spark, folder):
    return seqs(spark, folder).select("row_id", T.response_mask(F.col("ids"), [7, 13, 50]).alias("mask"))


@query(SEQ + "SELECT row_id, list_transform(mask, lambda m, i: greatest(list_sum(mask[:i]) - 1, 0)::INT) AS positions, mask[-3:] AS tail FROM s")
def position_ids(spark, folder):
    return seqs(spark, folder).select("row_id", T.position_ids(F.col("mask")).alias("positions"), T.last_of(F.col("mask"), 3).alias("tail"))


@query(
    SEQ + """SELECT row_id, CASE WHEN len(ids) > 4 THEN ids[-4:] ELSE ids END AS cut_left, CASE WHEN len(ids) > 4 THEN ids[:4] ELSE ids END AS cut_right,
    CASE WHEN len(ids) > 5 THEN list_concat(ids[:2], ids[-3:]) ELSE ids END AS cut_middle,
    list_concat(list_transform(range(greatest(6 - len(ids), 0)::BIGINT), lambda i: 0), ids) AS padded_left, list_concat(ids, list_transform(range(greatest(6 - len(ids), 0)::BIGINT), lambda i: 0)) AS padded_right FROM s"""
)
def pad_truncate_modes(spark, folder):
    i = F.col("ids")
    zero = lambda left: T.padded(i, 6, 0, left).cast("array<bigint>")
    return seqs(spark, folder).select(
        "row_id", T.truncated(i, 4, "left").alias("cut_left"), T.truncated(i, 4, "right").alias("cut_right"), T.truncated(i, 5, "middle").alias("cut_middle"), zero(True).alias("padded_left"), zero(False).alias("padded_right")
    )


@query(SEQ + "SELECT row_id, list_transform(mask, lambda m, i: CASE WHEN i - 1 < least(2, len(mask)) - 1 OR i = least(list_sum(mask), len(mask)) THEN 0 ELSE m END) AS loss_mask FROM s")
def sft_loss_mask(spark, folder):
    return seqs(spark, folder).select("row_id", T.training_mask(F.col("mask"), F.lit(2)).alias("loss_mask"))


@query(SEQ + "SELECT row_id, list_transform(mask, lambda m, i: round(CASE WHEN i = list_sum(mask) THEN score ELSE 0 END + 3.14159e-8, 6)) AS rewards FROM s")
def scatter_reward(spark, folder):
    r = T.scattered(F.col("score"), F.col("mask"))
    return seqs(spark, folder).select("row_id", F.transform(r, lambda x: rounded(x)).alias("rewards"))


@query(
    SEQ + """, p AS (SELECT row_id, ids, mask, list_concat([0, 0], ids) AS q FROM s)
    SELECT row_id, q[coalesce(list_position(list_transform(q, lambda v: v <> 0), true), len(q) + 1):] AS stripped, ids[len(ids) - list_sum(mask)::BIGINT + 1:] AS valid,
    (list_sum(mask) - list_sum(mask[-2:]))::INT AS n_prompt, list_sum(mask[-2:])::INT AS n_response FROM p WHERE len(list_filter(q, lambda v: v <> 0)) > 0"""
)
def unpadded(spark, folder):
    s = seqs(spark, folder).withColumn("q", F.concat(F.array(F.lit(0), F.lit(0)), F.col("ids"))).where(F.size(F.filter("q", lambda v: v != 0)) > 0)
    a, b = T.prompt_response_lengths(F.col("mask"), 2)
    return s.select("row_id", T.without_left_pad(F.col("q"), 0).alias("stripped"), T.without_masked_left(F.col("ids"), F.col("mask")).alias("valid"), a.alias("n_prompt"), b.alias("n_response"))
