"""Batches: data frames with an explicit row id, and the algebra on them.

The reference aligns by position; here every operation names the id, and order is a column. Frames keep their other
columns, so any column set works; ids must be unique.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.sampling import with_position


def _field(array: str, name: str):
    return F.transform(array, lambda x: x[name])


@dataclass
class Batch:
    """A frame whose column id numbers its rows 0, 1, …, and what holds for the whole of it."""

    df: DataFrame
    id: str = "row_id"
    meta: dict = field(default_factory=dict)

    def _with(self, df: DataFrame, meta: dict | None = None) -> Batch:
        return Batch(df, self.id, dict(self.meta if meta is None else meta))

    def select(self, columns: list[str] | None = None, meta: list[str] | None = None) -> Batch:
        df = self.df if columns is None else self.df.select(self.id, *columns)
        return self._with(df, self.meta if meta is None else {k: self.meta[k] for k in meta})

    def pop(self, columns: list[str]) -> tuple[Batch, Batch]:
        """(the columns, the rest); a missing column is an error."""
        if missing := set(columns) - set(self.df.columns):
            raise KeyError(f"no columns {sorted(missing)}")
        return self._with(self.df.select(self.id, *columns)), self._with(self.df.drop(*columns))

    def rename(self, old: list[str], new: list[str]) -> Batch:
        if len(old) != len(new):
            raise ValueError("as many new names as old ones")
        return self._with(self.df.withColumnsRenamed(dict(zip(old, new))))

    def union(self, other: Batch) -> Batch:
        """Columns side by side by id; columns that both have must be equal in every row, and the ids the same."""
        both = [c for c in other.df.columns if c in self.df.columns and c != self.id]
        right = other.df.withColumnsRenamed({c: f"_o_{c}" for c in both}).withColumn("_there", F.lit(True))
        joined = self.df.withColumn("_here", F.lit(True)).join(right, self.id, "full_outer")
        fine = F.col("_here").isNotNull() & F.col("_there").isNotNull()
        for c in both:
            fine = fine & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        ok = F.when(~fine, F.raise_error(F.lit("batches differ in ids or in common columns"))).otherwise(F.lit(True))
        if clash := [k for k in self.meta if k in other.meta and self.meta[k] != other.meta[k]]:
            raise ValueError(f"meta differs in {clash}")
        return self._with(joined.where(ok).drop("_here", "_there", *(f"_o_{c}" for c in both)), self.meta | other.meta)

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> Batch:
        """Python's slice of the rows; ids are numbered anew."""
        n = self.df.count()
        a, b, s = slice(start, stop, step).indices(n)
        i = F.col(self.id)
        inside = (i >= a) & (i < b) & ((i - a) % s == 0) if s > 0 else (i <= a) & (i > b) & ((F.lit(a) - i) % -s == 0)
        return self._with(self.df.where(inside).withColumn(self.id, F.expr(f"cast(({self.id} - ({a})) div ({s}) as bigint)")))

    def where(self, mask: str) -> Batch:
        kept = with_position(self.df.where(mask).withColumnRenamed(self.id, "_old"), ["_old"], self.id)
        return self._with(kept.drop("_old"))

    def reorder(self, order: DataFrame) -> Batch:
        """order: (position, id); the row with that id goes to that position."""
        o = order.toDF("_to", self.id)
        return self._with(self.df.join(o, self.id).drop(self.id).withColumnRenamed("_to", self.id))

    def concat(self, *others: Batch) -> Batch:
        """Rows below each other, ids numbered on; the column sets must match; meta of the first."""
        df, at = self.df, self.df.count()
        for o in others:
            if set(o.df.columns) != set(self.df.columns):
                raise ValueError("column sets differ")
            df = df.unionByName(o.df.withColumn(self.id, F.col(self.id) + at))
            at += o.df.count()
        return self._with(df)

    def chunk(self, k: int, padded: bool = False) -> list[Batch]:
        """k equal contiguous parts; unless padded, the rows must divide."""
        n = self.df.count()
        if n % k and not padded:
            raise ValueError(f"{n} rows don't divide into {k}")
        size = -(-n // k)
        return [self._with(self.df.where(F.col(self.id).between(j * size, (j + 1) * size - 1)).withColumn(self.id, F.col(self.id) - j * size)) for j in range(k)]

    def repeat(self, times: int, interleave: bool = True) -> Batch:
        """aabb if interleaved, else abab."""
        r = self.df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        at = F.col(self.id) * times + F.col("_k") if interleave else F.col("_k") * F.lit(self.df.count()) + F.col(self.id)
        return self._with(r.withColumn(self.id, at.cast("bigint")).drop("_k"))

    def repeat_each(self, times: str) -> Batch:
        """Each row as often as its column says; 0 drops it."""
        w = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        b = self.df.withColumn("_bucket", F.expr(f"{self.id} div 100000"))
        totals = b.groupBy("_bucket").agg(F.sum(times).alias("_t")).withColumn("_s", F.coalesce(F.sum("_t").over(w), F.lit(0))).drop("_t")
        inside = F.coalesce(F.sum(times).over(Window.partitionBy("_bucket").orderBy(self.id).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        r = b.withColumn("_i", inside).join(F.broadcast(totals), "_bucket").where(F.col(times) > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)))
        return self._with(r.withColumn(self.id, (F.col("_s") + F.col("_i") + F.col("_k")).cast("bigint")).drop("_bucket", "_i", "_s", "_k"))

    def unfold_column(self, columns: list[str], parts: int) -> Batch:
        """Array columns cut into parts, one row each; the other columns are repeated."""
        piece = lambda c: F.slice(c, F.col("_k") * (F.size(c) / parts).cast("int") + 1, (F.size(c) / parts).cast("int"))
        r = self.df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        r = r.withColumns({c: piece(c) for c in columns} | {self.id: (F.col(self.id) * parts + F.col("_k")).cast("bigint")})
        return self._with(r.drop("_k"))

    def fold(self, size: int) -> Batch:
        """Each run of `size` rows becomes one row of arrays."""
        rest = [c for c in self.df.columns if c != self.id]
        g = self.df.groupBy(F.expr(f"{self.id} div {size}").alias("_g")).agg(F.sort_array(F.collect_list(F.struct(self.id, *rest))).alias("_s"))
        return self._with(g.select(F.col("_g").alias(self.id), *(_field("_s", c).alias(c) for c in rest)))

    def unfold(self, size: int) -> Batch:
        """The opposite of fold: all columns are arrays of that size."""
        rest = [c for c in self.df.columns if c != self.id]
        x = self.df.select(self.id, F.posexplode(F.arrays_zip(*rest)).alias("_k", "_x"))
        return self._with(x.select((F.col(self.id) * size + F.col("_k")).cast("bigint").alias(self.id), *(F.col(f"_x.{c}").alias(c) for c in rest)))

    def pad_to_multiple(self, k: int) -> tuple[Batch, int]:
        """Rows repeated from the head, round and round, until k divides their number; and how many were added."""
        n = self.df.count()
        pad = -n % k if n else 0
        times = -(-pad // n) if n else 0
        extra = self.df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(max(1, times))))).withColumn(self.id, F.col(self.id) + F.col("_k") * n).drop("_k")
        return self._with(self.df.unionByName(extra.where(F.col(self.id) < n + pad)) if pad else self.df), pad

    def unpad(self, pad: int) -> Batch:
        n = self.df.count()
        return self._with(self.df.where(F.col(self.id) < n - pad))

    def pad_with(self, size: int, which: str = "last") -> Batch:
        """`size` more rows like the first or the last one."""
        n = self.df.count()
        row = self.df.where(F.col(self.id) == (0 if which == "first" else n - 1))
        extra = row.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(self.id, F.lit(n) + F.col("_k")).drop("_k") if size else row.limit(0)
        return self._with(self.df.unionByName(extra.withColumn(self.id, F.col(self.id).cast("bigint"))))

    def save(self, path: str) -> None:
        """Rows as parquet below path, and what holds for the whole as JSON beside them."""
        self.df.write.mode("overwrite").parquet(f"{path}/rows")
        meta = self.df.sparkSession.createDataFrame([(self.id, json.dumps(self.meta))], "id string, meta string")
        meta.write.mode("overwrite").json(f"{path}/meta")


def load(spark, path: str) -> Batch:
    """The batch that save() wrote; meta comes back as JSON holds it."""
    m = spark.read.schema("id string, meta string").json(f"{path}/meta").first()
    return Batch(spark.read.parquet(f"{path}/rows"), m.id, json.loads(m.meta))


def appended(into: dict[str, list], more: dict) -> dict[str, list]:
    """into with each value of more appended to the list of its key; keys that are new begin a list."""
    return into | {k: [*into.get(k, []), v] for k, v in more.items()}


def joined(a: dict, b: dict) -> dict:
    """Both dictionaries; a key with two values is an error."""
    if clash := [k for k in a if k in b and a[k] != b[k]]:
        raise ValueError(f"values differ for {clash}")
    return a | b


def as_rows(batch: Batch, columns: list[str] | None = None) -> DataFrame:
    """(id, row): the columns of each row as one struct; the opposite is select("id", "row.*")."""
    return batch.df.select(batch.id, F.struct(*(columns or [c for c in batch.df.columns if c != batch.id])).alias("row"))


def from_columns(spark, columns: dict[str, list], schema: str, id: str = "row_id", **meta) -> Batch:
    """A batch of literal columns; they must be of the same length."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns of different lengths")
    rows = [(k, *v) for k, v in enumerate(zip(*columns.values()))]
    return Batch(spark.createDataFrame(rows, f"{id} bigint, {schema}"), id, meta)


def inverse(order: DataFrame) -> DataFrame:
    """(position, id) of the permutation that undoes (position, id)."""
    a, b = order.columns
    return order.select(F.col(b).alias(a), F.col(a).alias(b))
