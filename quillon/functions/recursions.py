"""Recursions along arrays, one sequence a row. Each step is taken for all sequences of an Arrow batch at once, on the flat
values and their offsets: linear in the tokens, without an object for a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def _flat(values: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists in order, length of each list); a missing list has none."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(kind), pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(flat: np.ndarray, lengths: np.ndarray, like: pa.Array, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    missing = pc.is_null(like) if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind), mask=missing)


def _from_right(values: pa.Array, gates: pa.Array | None, decay: float) -> pa.Array:
    x, lengths = _flat(values, np.float64)
    g, n = (None, lengths) if gates is None else _flat(gates, np.float64)
    if not (n == lengths).all():
        raise ValueError("arrays of different lengths")
    order = np.argsort(-lengths, kind="stable")  # at each step those that are long enough are the first
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    out, run = np.empty_like(x), np.zeros(len(order))
    there = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # sequences longer than t
    for t in range(len(there) - 1, -1, -1):
        at = starts[: there[t]] + t
        now = x[at] + decay * run[: there[t]]
        out[at] = now
        run[: there[t]] = now if g is None else now * g[at]
    return _lists(out, lengths, values, pa.float64())


def discounted(values: Column, decay: float, gates: Column | None = None) -> Column:
    """Array of y[t] = x[t] + decay y[t+1] g[t+1], from the right; without gates g is 1. NULL arrays stay NULL."""
    if gates is None:

        @F.arrow_udf(ArrayType(DoubleType()))
        def plain(x: pa.Array) -> pa.Array:
            return _from_right(x, None, decay)

        return plain(values)

    @F.arrow_udf(ArrayType(DoubleType()))
    def gated(x: pa.Array, g: pa.Array) -> pa.Array:
        return _from_right(x, g, decay)

    return gated(values, gates.cast("array<double>"))


@F.arrow_udf(ArrayType(IntegerType()))
def counted_positions(mask: pa.Array) -> pa.Array:
    """Running count of a mask minus one, at least 0."""
    m, lengths = _flat(mask, np.int64)
    total = np.cumsum(m)
    before = np.concatenate([[0], total])[np.cumsum(lengths) - lengths]
    return _lists(np.maximum(total - np.repeat(before, lengths) - 1, 0).astype(np.int32), lengths, mask, pa.int32())
