"""Batch algebra over part and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators.batch import Batch, inverse
from quillon.operators.sampling import with_position
from quillon.plans.tables import table
from quillon.registry import query

PARTS = "WITH b AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, p_partkey, p_brand, p_size FROM part)"


def parts(spark, folder) -> Batch:
    return Batch(with_position(table(spark, folder, "part").select("p_partkey", "p_brand", "p_size"), ["p_partkey"], "row_id"))


@query(PARTS + "SELECT (row_id * 3 + k)::BIGINT AS row_id, p_partkey, p_brand, p_size FROM b, range(3) t(k)")
def batch_repeat_interleave(spark, folder):
    return parts(spark, folder).repeat(3).df


@query(PARTS + "SELECT (k * (SELECT count(*) FROM b) + row_id)::BIGINT AS row_id, p_partkey, p_brand, p_size FROM b, range(3) t(k)")
def batch_repeat_stacked(spark, folder):
    return parts(spark, folder).repeat(3, interleave=False).df


@query(PARTS + ", r AS (SELECT *, p_size % 4 AS n FROM b), e AS (SELECT *, unnest(range(n::BIGINT)) AS k FROM r) SELECT row_number() OVER (ORDER BY row_id, k) - 1 AS row_id, p_partkey, p_brand, p_size, n FROM e")
def sample_level_repeat(spark, folder):
    b = parts(spark, folder)
    return Batch(b.df.withColumn("n", F.col("p_size") % 4)).repeat_each("n").df


@query(PARTS + "SELECT ((row_id - 5) // 7)::BIGINT AS row_id, p_partkey, p_brand, p_size FROM b WHERE row_id >= 5 AND row_id < 905 AND (row_id - 5) % 7 = 0")
def slice_step(spark, folder):
    return parts(spark, folder).slice(5, 905, 7).df


@query(PARTS + "SELECT row_id % (SELECT count(*) // 4 FROM b) AS row_id, p_partkey, p_brand, p_size, row_id // (SELECT count(*) // 4 FROM b) AS chunk FROM b")
def chunk(spark, folder):
    out = None
    for k, c in enumerate(parts(spark, folder).chunk(4)):
        one = c.df.withColumn("chunk", F.lit(k).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


@query(PARTS + "SELECT row_id // 4 AS row_id, list(p_partkey ORDER BY row_id) AS p_partkey, list(p_brand ORDER BY row_id) AS p_brand, list(p_size ORDER BY row_id) AS p_size FROM b GROUP BY ALL")
def fold(spark, folder):
    return parts(spark, folder).fold(4).df


@query(PARTS + "SELECT row_id, p_partkey, p_brand, p_size FROM b")
def unfold_of_fold(spark, folder):
    return parts(spark, folder).fold(4).unfold(4).df


@query(
    "WITH b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, vec_id, embedding FROM embeddings) SELECT (row_id * 4 + k)::BIGINT AS row_id, vec_id, embedding[(k * 16 + 1):(k * 16 + 16)] AS embedding FROM b, range(4) t(k)"
)
def unfold_column_chunks(spark, folder):
    b = Batch(with_position(table(spark, folder, "embeddings").select("vec_id", "embedding"), ["vec_id"], "row_id"))
    return b.unfold_column(["embedding"], 4).df


@query(PARTS + ", n AS (SELECT count(*) AS n FROM b) SELECT row_id, p_partkey, p_brand, p_size FROM b UNION ALL SELECT row_id + n, p_partkey, p_brand, p_size FROM b, n WHERE row_id < (7 - n % 7) % 7")
def pad_to_multiple(spark, folder):
    return parts(spark, folder).pad_to_multiple(7)[0].df


@query(PARTS + "SELECT row_id, p_partkey, p_brand, p_size FROM b")
def pad_unpad(spark, folder):
    b, pad = parts(spark, folder).pad_to_multiple(7)
    return b.unpad(pad).df


@query(PARTS + "SELECT row_id, p_partkey, p_brand, p_size FROM b")
def reorder_inverse(spark, folder):
    """A permutation and its inverse give the batch back."""
    b = parts(spark, folder)
    order = b.df.select(((F.col("row_id") * 7 + 3) % b.df.count()).alias("position"), "row_id")
    return b.reorder(order).reorder(inverse(order)).df


@query(PARTS + "SELECT (row_id * 7 + 3) % (SELECT count(*) FROM b) AS row_id, p_partkey, p_brand, p_size FROM b")
def reorder(spark, folder):
    b = parts(spark, folder)
    return b.reorder(b.df.select(((F.col("row_id") * 7 + 3) % b.df.count()).alias("position"), "row_id")).df


@query(PARTS + "SELECT row_id, p_partkey, p_brand, p_size, p_size * 2 AS doubled FROM b")
def union_checked(spark, folder):
    b = parts(spark, folder)
    return b.union(Batch(b.df.select("row_id", "p_brand", (F.col("p_size") * 2).alias("doubled")))).df


@query(PARTS + ", n AS (SELECT count(*) AS n FROM b) SELECT row_id, p_partkey, p_brand, p_size FROM b UNION ALL SELECT row_id + n, p_partkey, p_brand, p_size FROM b, n")
def concat(spark, folder):
    b = parts(spark, folder)
    return b.concat(b).df


@query(PARTS + "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, p_partkey, p_brand, p_size FROM b WHERE p_size > 25")
def select_by_mask(spark, folder):
    return parts(spark, folder).where("p_size > 25").df


@query(PARTS + "SELECT row_id, p_brand AS brand FROM b")
def select_pop_rename(spark, folder):
    return parts(spark, folder).pop(["p_brand"])[0].rename(["p_brand"], ["brand"]).df
