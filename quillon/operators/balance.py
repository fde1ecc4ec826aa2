"""Balancing sequences over partitions by their lengths."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Indices of lengths in k sets of similar sums, by largest differencing; of equal sizes if asked."""
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} items don't divide into {k}")
    states = []
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size:
        for at in range(0, len(order), k):
            sets = [(lengths[i], (i,)) for i in order[at : at + k]]
            states.append(sets)
    else:
        states = [[(0, ())] * (k - 1) + [(lengths[i], (i,))] for i in order]
    heap = []
    for n, sets in enumerate(states):
        sets = sorted(sets, reverse=True)
        heapq.heappush(heap, (-(sets[0][0] - sets[-1][0]), n, sets))
    at = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), reverse=True)
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), at, merged))
        at += 1
    return [sorted(s[1]) for s in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """In the given order, each into the set with the least sum; with equal sizes a bias keeps the counts level."""
    bias = sum(lengths) + 1 if equal_size else 0
    sums, sets = [0] * k, [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        j = min(range(k), key=lambda s: (sums[s], s))
        sets[j].append(i)
        sums[j] += n + bias
    return sets


def balanced(rows: DataFrame, group: str, id: str, length: str, k: int, equal_size: bool = False, method: str = "differencing") -> DataFrame:
    """(group, id, part): each group's rows in k parts of similar total length.

    A group is one training batch: the recursion is sequential in it, and only ids and lengths go through Python. Empty
    parts are an error.
    """
    split = differencing if method == "differencing" else greedy

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(id)
        sets = split(g[length].astype(int).tolist(), k, equal_size)
        if any(not s for s in sets):
            raise ValueError(f"fewer rows than {k} parts")
        part = pd.Series(0, index=range(len(g)))
        for p, s in enumerate(sets):
            part[s] = p
        return pd.DataFrame({group: g[group].to_numpy(), id: g[id].to_numpy(), "part": part.to_numpy()})

    f = {c: t for c, t in rows.dtypes}
    return rows.select(group, id, length).groupBy(group).applyInPandas(run, f"`{group}` {f[group]}, `{id}` {f[id]}, part long")


def micro_batch_counts(rows: DataFrame, group: str, length: str, most: int) -> DataFrame:
    """(group, n): micro-batches of at most `most` tokens that a batch needs: min(rows, ceil(total / most))."""
    return rows.groupBy(group).agg(F.least(F.count("*"), F.ceil(F.sum(length) / F.lit(float(most)))).alias("n"))


def micro_batches(
    rows: DataFrame, group: str, id: str, length: str, most: int, *, padded: int | None = None, at_least: int | None = None, divisor: int | None = None, same_for_all: bool = False
) -> DataFrame:
    """(group, id, part): each group's rows in micro-batches of at most about `most` tokens, of similar totals.

    Their number is that of micro_batch_counts, one at least or at_least so many, with same_for_all the greatest of all groups, rounded up
    to a multiple of the divisor. An error if a group has fewer rows, or if a padded row alone is over `most`.
    """
    if padded is not None and most < padded:
        raise ValueError(f"{most} tokens are less than a row's {padded}")
    n = micro_batch_counts(rows, group, length, most).select(group, F.greatest(F.lit(at_least or 1), F.col("n")).alias("_parts"))
    if same_for_all:
        n = n.crossJoin(F.broadcast(n.agg(F.max("_parts").alias("_m")))).select(group, F.col("_m").alias("_parts"))
    if divisor:
        n = n.withColumn("_parts", F.expr(f"(_parts + {divisor} - 1) div {divisor} * {divisor}"))
    kinds = dict(rows.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(id)
        k = int(g["_parts"].iloc[0])
        if k > len(g):
            raise ValueError(f"{len(g)} rows for {k} micro-batches")
        part = pd.Series(0, index=range(len(g)))
        for p, s in enumerate(differencing(g[length].astype(int).tolist(), k)):
            part[s] = p
        return pd.DataFrame({group: g[group].to_numpy(), id: g[id].to_numpy(), "part": part.to_numpy()})

    return rows.select(group, id, length).join(n, group).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{id}` {kinds[id]}, part long")


def balanced_order(rows: DataFrame, group: str, id: str, length: str, ranks: int) -> DataFrame:
    """(group, id, rank, place): the rows of a batch in an order in which each rank's contiguous share, of equal size,
    has a similar number of tokens."""
    b = balanced(rows, group, id, length, ranks, equal_size=True)
    w = Window.partitionBy(group).orderBy("part", id)  # a batch fits a task: it was balanced in one
    return b.select(group, id, F.col("part").alias("rank"), (F.row_number().over(w) - 1).cast("long").alias("place"))


def unpadded_offsets(lengths: list[int]) -> tuple[list[int], int]:
    """Start offsets of packed sequences with the total at the end, and the greatest length."""
    out = [0]
    for n in lengths:
        out.append(out[-1] + n)
    return out, max(lengths, default=0)


def least_parts(total: int, most: int) -> int:
    return math.ceil(total / most)
