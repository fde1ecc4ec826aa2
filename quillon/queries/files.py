"""Reading, writing, copying and tracking, user functions, and what else works beside the rows of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import extension as X
from quillon.functions import tokens as T
from quillon.operators import balance as B
from quillon.operators import sampling as S
from quillon.plans.tables import table
from quillon.queries.batches import PARTS, parts
from quillon.queries.rounds import folder_for
from quillon.registry import query
from quillon.sources import io


@query(PARTS + " SELECT row_id, p_size FROM b UNION ALL SELECT (SELECT count(*) FROM b) + k, (SELECT p_size FROM b WHERE row_id = 0) FROM range(3) t(k)")
def batch_select_and_fill(spark, folder):
    """Some columns of a batch, filled up with its first row."""
    return parts(spark, folder).select(["p_size"]).pad_with(3, "first").df


@query("SELECT n_nationkey, n_name FROM nation")
def split_with_fallback(spark, folder):
    """The split test of a folder that only has train files."""
    path = folder_for(spark)
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    n.coalesce(1).write.parquet(f"{path}/all")
    io.make_directories(spark, f"{path}/split")
    files = spark.read.parquet(f"{path}/all").select(F.input_file_name().alias("f")).distinct().collect()  # of one small table
    for k, r in enumerate(files):
        io.copy(spark, r.f, f"{path}/split/train-{k}.parquet")
    return io.read_split(spark, f"{path}/split", "test")


@query("SELECT n_nationkey, n_name, 'answer of ' || n_name AS response FROM nation")
def responses_by_position(spark, folder):
    """A JSON array of responses, put to the tasks by their place."""
    path, n = folder_for(spark), table(spark, folder, "nation").select("n_nationkey", "n_name")
    answers = n.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("answer of "), x["n_name"]))).alias("value"))  # 25 nations
    answers.coalesce(1).write.text(path)
    tasks = S.with_position(n, ["n_nationkey"], "position")
    return io.attach(tasks, io.read_json_list(spark, path).withColumn("position", F.col("position").cast("long")), "position").drop("position")


@query("SELECT event_id AS example_id, event_type AS prediction, value AS metric FROM events")
def result_files(spark, folder):
    """A validation's results, read back."""
    path, e = folder_for(spark), table(spark, folder, "events")
    metrics = e.groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    io.write_results(metrics, e.select(F.col("event_id").alias("example_id"), F.col("event_type").alias("prediction"), F.col("value").alias("metric")), path, 4)
    return spark.read.schema("example_id long, prediction string, metric double").json(f"{path}/validation_epoch_4/results")


@query("SELECT n_nationkey, n_name FROM nation")
def cached_files(spark, folder):
    """A copy in a cache, made once and again found."""
    path = folder_for(spark)
    table(spark, folder, "nation").select("n_nationkey", "n_name").write.parquet(f"{path}/in")
    a, b = (io.cached_copy(spark, f"{path}/in", f"{path}/cache") for _ in range(2))
    if a != b or not io.same_files(spark, f"{path}/in", a):
        raise ValueError("the copy differs")
    return spark.read.parquet(a)


@query("SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name ORDER BY md5('42:' || p_name), p_name LIMIT 20")
def shown_samples(spark, folder):
    """Twenty rows in a reproducible random order of their text."""
    p = table(spark, folder, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return io.validation_samples(p, "p_name", 20).select("p_partkey", "p_name")


@query("""SELECT p_partkey AS id, p_name AS "info/name", p_size AS "info/box/size" FROM part""")
def flattened_columns(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size")).alias("box")).alias("info"))
    return io.flattened(p)


@query("SELECT p_partkey, (CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 0 END)::DOUBLE AS by_row, length(p_name)::DOUBLE AS by_batch, p_size * 2.0::DOUBLE AS by_sql FROM part")
def user_scores(spark, folder):
    """Scores by a function of a row, by one of lists, and by one that SQL calls."""
    X.register(spark, "quillon_twice", lambda x: 2.0 * x)
    row, batch = X.row_scorer(lambda s, r, t: float(r == t)), X.batch_scorer(lambda s, r, t: [float(len(x)) for x in s])
    p = table(spark, folder, "part")
    return p.select("p_partkey", row(F.col("p_name"), F.col("p_brand"), F.lit("Brand#11")).alias("by_row"), batch(F.col("p_name"), F.col("p_brand"), F.col("p_brand")).alias("by_batch"), F.expr("quillon_twice(cast(p_size as double))").alias("by_sql"))


@query("SELECT o_orderkey // 64 AS batch, count(*) AS n_rows, least(4, count(*))::BIGINT AS n_parts FROM orders GROUP BY ALL HAVING count(*) >= 4")
def greedy_partitions(spark, folder):
    """Batches in four parts, each order into the lightest part."""
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("bigint").alias("len"), F.expr("o_orderkey div 64").alias("batch"))
    full = o.groupBy("batch").agg(F.count("*").alias("n")).where("n >= 4").select("batch")
    b = B.balanced(o.join(full, "batch", "left_semi"), "batch", "o_orderkey", "len", 4, method="greedy")
    return b.groupBy("batch").agg(F.countDistinct("o_orderkey").alias("n_rows"), F.countDistinct("part").alias("n_parts"))


@query("SELECT p_partkey, [0, 0, 1, 2, 3, 4] AS positions FROM part")
def continued_positions(spark, folder):
    """Positions of a prompt padded on the left, counted on for its response."""
    first = T.position_ids(F.array(F.lit(0), F.lit(1), F.lit(1)))
    return table(spark, folder, "part").select("p_partkey", T.continued_positions(first, 3).alias("positions"))


@query("SELECT 5 AS step, 'loss' AS name, 0.5::DOUBLE AS value UNION ALL SELECT 5, 'n', 2.0")
def tracked_steps(spark, folder):
    """Metrics of three steps in a table, and those of the last finished one."""
    path = folder_for(spark)
    tracking = io.Tracking(table=io.table_sink(spark, f"{path}/metrics"))
    for k in (1, 3, 5):
        tracking.log({"loss": 1 - k / 10, "n": 2, "note": "text"}, k)
        io.mark_step(spark, f"{path}/steps", k)
    last = io.last_step(spark, f"{path}/steps")
    return spark.read.parquet(f"{path}/metrics").where(F.col("step") == last).select(F.col("step").cast("int").alias("step"), "name", F.round("value", 6).alias("value"))
