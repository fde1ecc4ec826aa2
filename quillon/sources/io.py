"""Reading and writing tables, response lists, generations and results."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches the path (with wildcards) on whichever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def read_split(spark: SparkSession, folder: str, split: str, fallback: str = "train") -> DataFrame:
    """{split}-*.parquet of a folder, or {fallback}-*.parquet where there is none."""
    for name in (split, fallback):
        if exists(spark, f"{folder}/{name}-*.parquet"):
            return spark.read.option("pathGlobFilter", f"{name}-*.parquet").parquet(folder)
    raise FileNotFoundError(f"neither {split} nor {fallback} in {folder}")


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of several files; all must have the same columns."""
    frames = [spark.read.parquet(p) for p in paths]
    if len({frozenset(f.columns) for f in frames}) > 1:
        raise ValueError("files with different columns")
    return reduce(DataFrame.unionByName, frames)


def debug_sample(df: DataFrame, n: int | None) -> DataFrame:
    """n rows for a trial run of a pipeline; all of them where n is None or 0."""
    return df.limit(n) if n else df


def read_columns(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Columns by paths such as extra_info.answer; an array of one element stands for the element."""
    kinds = df.select(*(F.col(p).alias(n) for n, p in keys.items())).dtypes
    return df.select(*((F.col(keys[n])[0] if t.startswith("array") else F.col(keys[n])).alias(n) for n, t in kinds))


def read_json_list(spark: SparkSession, path: str, name: str = "response", item: str = "string") -> DataFrame:
    """(position, name): the elements of a file that is one JSON array."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<{item}>")).alias("position", name))


def attach(tasks: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """tasks with their responses by key; both sides must have exactly the same keys."""
    joined = tasks.withColumn("_a", F.lit(1)).join(responses.withColumn("_b", F.lit(1)), key, "full_outer")
    ok = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("tasks and responses differ"))).otherwise(F.lit(True))
    return joined.where(ok).drop("_a", "_b")


def missing(requests: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Requests without a cached response."""
    return requests.join(cached, key, "left_anti")


def write_splits(df: DataFrame, folder: str, split: str = "split") -> None:
    """One directory for each split; rows of a split are spread over files by Spark, not gathered in one."""
    df.write.mode("overwrite").partitionBy(split).parquet(folder)


def write_generations(df: DataFrame, folder: str, step: int, n_rows: int | None = None, extra: dict[str, DataFrame] | None = None, key: str = "row_id") -> None:
    """JSON lines of a step, in a directory of its own that a second run overwrites.

    extra are further columns, each a table (key, value); a column that doesn't have a value for every row is left out.
    """
    out = df.withColumn("step", F.lit(step))
    n = (n_rows if n_rows is not None else df.count()) if extra else 0
    for name, values in (extra or {}).items():
        if values.select(key).distinct().join(df.select(key), key, "left_semi").count() == n:
            out = out.join(values.select(key, F.col(values.columns[-1]).alias(name)), key)
    out.write.mode("overwrite").json(f"{folder}/step={step}")


def append_log(df: DataFrame, folder: str, batch: int) -> None:
    """One batch of a growing log, under its own number; a second run of the batch overwrites it alone."""
    df.write.mode("overwrite").json(f"{folder}/batch={batch}")


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches of a log, with their number in the column batch; empty where there is none."""
    if not exists(spark, f"{folder}/batch=*"):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").json(folder)


def write_results(metrics: DataFrame, results: DataFrame, folder: str, epoch: int) -> None:
    """A validation's results: one document with the epoch and its metrics, the predictions with their metrics
    (example_id, prediction, metric), and the bare predictions. The epoch -1 is called initial."""
    name = "initial" if epoch < 0 else str(epoch)
    made = result_document(metrics, epoch).select("document", F.current_timestamp().alias("written_at"))
    made.write.mode("overwrite").json(f"{folder}/validation_epoch_{name}/summary")
    results.write.mode("overwrite").json(f"{folder}/validation_epoch_{name}/results")
    results.select("prediction").write.mode("overwrite").json(f"{folder}/predictions_epoch_{name}")


def result_document(metrics: DataFrame, epoch: int) -> DataFrame:
    """One row (document): {"epoch": …, "metrics": {name: value}} as JSON."""
    m = metrics.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metrics"))
    return m.select(F.to_json(F.struct(F.lit(epoch).alias("epoch"), "metrics")).alias("document"))


def validation_samples(df: DataFrame, text: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in a reproducible random order of their text."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(text))), text).limit(n)


def flattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns named by their path."""

    def walk(schema, path: list[str]) -> list[tuple[list[str], object]]:
        out = []
        for f in schema.fields:
            here = [*path, f.name]
            out += walk(f.dataType, here) if f.dataType.typeName() == "struct" else [(here, f)]
        return out

    def at(path: list[str]) -> Column:
        return reduce(lambda c, n: c.getField(n), path[1:], F.col(f"`{path[0]}`"))

    return df.select(*(at(p).alias(sep.join(p)) for p, _ in walk(df.schema, [])))


def responded(df: DataFrame, responder: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, tries: int = 3, wait: float = 1.0, again: Callable[[Exception], bool] | None = None, failed: Callable[[pd.DataFrame, Exception], pd.DataFrame] | None = None) -> DataFrame:
    """df through an outside responder, a batch at a time: the place for model servers and sandboxes.

    A failing batch is tried again up to `tries` times, after 1, 2, … times `wait` seconds, if again(error) says so
    (always, without it); what remains goes to failed(batch, error), or fails the task. Recorded responses need none of
    this: join their table instead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(1, tries + 1):
                try:
                    yield responder(batch)
                    break
                except Exception as e:  # noqa: BLE001
                    if k < tries and (again is None or again(e)):
                        time.sleep(wait * k)
                        continue
                    if failed is None:
                        raise
                    yield failed(batch, e)
                    break

    return df.mapInPandas(run, schema)


def generation_options(n: int) -> dict[str, float]:
    """How to sample: greedily for one response, else at temperature 1."""
    return {"n": n, "temperature": 1.0 if n > 1 else 0.0}


def read_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The splits of a folder: its directories split=…, or else the file names before the first dash or dot."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found: dict[str, list[str]] = {}
    for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root):
        name = f.getPath().getName()
        if not name.startswith(("_", ".")):
            split = name.removeprefix("split=") if name.startswith("split=") else name.split("-")[0].split(".")[0]
            found.setdefault(split, []).append(f.getPath().toString())
    return {k: spark.read.parquet(*sorted(v)) for k, v in sorted(found.items())}


def read_preferences(spark: SparkSession, paths: list[str], prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(prompt, chosen, rejected) of several files, as texts; the first element where a column holds lists."""
    return read_columns(read_many(spark, paths), {"prompt": prompt, "chosen": chosen, "rejected": rejected})


def read_conversations(spark: SparkSession, paths: list[str], messages: str = "messages") -> DataFrame:
    """(messages) of several files: lists of (role, content), also where they are wrapped in a list or written as JSON."""
    df = read_many(spark, paths)
    kind = df.select(messages).dtypes[0][1]
    c = F.col(messages)
    if kind == "string":
        c = F.from_json(c, "array<struct<role:string,content:string>>")
    elif kind.startswith("array<array"):
        c = F.get(c, F.lit(0))
    return df.select(c.alias("messages"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def make_directories(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.mkdirs(p)


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = True) -> bool:
    """Copies a file or directory between any two file systems that Spark knows."""
    a, fa = _fs(spark, source)
    b, fb = _fs(spark, target)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, overwrite, spark._jsc.hadoopConfiguration())


def same_files(spark: SparkSession, source: str, target: str) -> bool:
    """Whether target holds every file below source, in the same size."""

    def sizes(path: str) -> dict[str, int]:
        p, fs = _fs(spark, path)
        if not fs.exists(p):
            return {}
        base, out = fs.getFileStatus(p).getPath().toString(), {}
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().endswith(".crc"):
                out[f.getPath().toString().removeprefix(base)] = f.getLen()
        return out

    a, b = sizes(source), sizes(target)
    return all(b.get(k) == n for k, n in a.items()) and bool(a)


def cached_copy(spark: SparkSession, source: str, cache: str) -> str:
    """The path of a copy of source below cache, in a directory named by the source's MD5; made once, and made anew where
    files are missing or of another size. Spark reads remote paths itself: this is for what runs beside it."""
    target = f"{cache}/{hashlib.md5(source.encode()).hexdigest()}/{source.rstrip('/').rsplit('/', 1)[-1]}"
    if not same_files(spark, source, target):
        make_directories(spark, target.rsplit("/", 1)[0])
        p, fs = _fs(spark, target)
        fs.delete(p, True)
        copy(spark, source, target)
    return target


class Tracking:
    """Metrics of a step to several sinks at once: functions (metrics, step). Numbers only, as a step's line shows them."""

    def __init__(self, **sinks: Callable[[dict[str, float], int], None]):
        self.sinks = sinks

    def log(self, metrics: dict[str, object], step: int, only: str | None = None) -> None:
        numbers = {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        for name, sink in self.sinks.items():
            if only is None or name == only:
                sink(numbers, step)


def console_sink(write: Callable[[str], object] = print) -> Callable[[dict[str, float], int], None]:
    """step:N - a:1.000 - b:2.000"""
    return lambda metrics, step: write(" - ".join([f"step:{step}", *(f"{k}:{v:.3f}" for k, v in metrics.items())]))


def table_sink(spark: SparkSession, folder: str) -> Callable[[dict[str, float], int], None]:
    """Rows (name, value) of each step, in a directory of its own."""

    def write(metrics: dict[str, float], step: int) -> None:
        spark.createDataFrame(sorted(metrics.items()), "name string, value double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/step={step}")

    return write


def mark_step(spark: SparkSession, folder: str, step: int) -> None:
    """Notes the last finished step: written beside and renamed, so that a reader sees the old or the new one."""
    new, fs = _fs(spark, f"{folder}/latest.{step}")
    at, _ = _fs(spark, f"{folder}/latest")
    out = fs.create(new, True)
    out.writeBytes(str(step))
    out.close()
    if not fs.rename(new, at):
        fs.delete(at, False)
        fs.rename(new, at)


def last_step(spark: SparkSession, folder: str) -> int | None:
    """The last finished step, or None; after a loss between the two renames, the greatest that was written."""
    if exists(spark, f"{folder}/latest"):
        return int(spark.read.text(f"{folder}/latest").first()[0])
    p, fs = _fs(spark, f"{folder}/latest.*")
    found = fs.globStatus(p)
    return max((int(f.getPath().getName().split(".")[-1]) for f in found), default=None) if found else None
