"""A bound on the similarity of sets by their first members in one global order.

If two sets reach the similarity t, they share t of each one's n members at least, so the first n - ceil(t n) + 1 members
of both, in any order that is the same for all sets, have one in common. The order taken puts rare members first, by how
many members of all sets fall into the same of BUCKETS buckets: a table of a fixed size, whatever the number of members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillon.llm.words import mix

BUCKETS, BLOCK = 1 << 18, 1 << 12  # of the counts, and of those in one row


def bucket(s: np.ndarray) -> np.ndarray:
    return (mix(s) >> np.uint64(20)).astype(np.int64) % BUCKETS


def _summed(blocks: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.int64) for x in blocks["counts"]], axis=0)
    return pd.DataFrame({"block": blocks["block"].iloc[:1], "counts": [total.tobytes()]})


def member_counts(rows: DataFrame, sets: Callable[[pd.DataFrame], Iterator[np.ndarray]]) -> np.ndarray:
    """How many members of the sets that `sets` gets from each batch of rows fall into each bucket."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for s in sets(batch):
                np.add.at(n, bucket(s), 1)
        blocks = n.reshape(-1, BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"block": at.astype(np.int32), "counts": [blocks[k].tobytes() for k in at]})

    n = np.zeros((BUCKETS // BLOCK, BLOCK), np.int64)
    for r in rows.mapInPandas(counted, "block int, counts binary").groupBy("block").applyInPandas(_summed, "block int, counts binary").collect():
        n[r.block] = np.frombuffer(r.counts, np.int64)
    return n.ravel()


def first_members(s: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """Where in s the members stand of which a set similar to s at the threshold has one among its own, in their order."""
    n = len(s) - max(1, math.ceil(threshold * len(s) - 1e-6)) + 1
    return np.lexsort((s, counts[bucket(s)]))[:n]
