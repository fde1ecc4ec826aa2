"""Driver tables in the roles of rollouts and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.tables import table

TOKENS = """WITH tok AS (SELECT l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS t,
  l_discount AS reward, l_tax AS value, l_discount - 0.05 AS logp, l_tax - 0.04 AS ref, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS mask FROM lineitem)
"""
ROLLOUTS = "WITH ro AS (SELECT o_orderkey AS row_id, o_custkey AS uid, o_totalprice / 1e5 AS score FROM orders)\n"


def rollouts(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, uid, score): an order is a response, its customer the prompt."""
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), (F.col("o_totalprice") / 1e5).alias("score"))


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, t, reward, value, logp, ref, mask): an order line is a token."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.row_number().over(w).cast("bigint").alias("t"), F.col("l_discount").alias("reward"), F.col("l_tax").alias("value"),
        (F.col("l_discount") - 0.05).alias("logp"), (F.col("l_tax") - 0.04).alias("ref"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("mask"),
    )


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays rewards, values, mask of each order, in token order."""
    t = tokens(spark, folder).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("t", "reward", "value", "mask"))).alias("s"))
    pick = lambda f: F.transform("s", lambda x: x[f])
    return t.select("row_id", pick("reward").alias("rewards"), pick("value").alias("values"), pick("mask").alias("mask"))
