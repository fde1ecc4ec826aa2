"""Token arrays: masks, positions, padding, truncation, scattering. Expressions over arrays, one sequence a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.recursions import counted_positions

CUTS = ("left", "right", "middle", "error")


def response_mask(ids: Column, eos: list[int]) -> Column:
    """1 up to and with the first end token, then 0; all 1 without one."""
    first = F.array_position(F.transform(ids, lambda x: x.isin(*eos)), True)
    return F.transform(ids, lambda x, i: F.when((first == 0) | (i < first), 1).otherwise(0))


def last_of(mask: Column, n: int) -> Column:
    """The last n entries; all of them if there are fewer."""
    return F.slice(mask, F.greatest(F.size(mask) - n + 1, F.lit(1)), F.lit(n))


def position_ids(mask: Column) -> Column:
    """Running count of mask minus one, at least 0."""
    return counted_positions(mask)


def truncated(ids: Column, most: int, cut: str) -> Column:
    """At most `most` tokens, cut left, right, in the middle (the right half gets the odd one) or with an error."""
    if cut not in CUTS:
        raise ValueError(f"unknown cut {cut!r}: one of {CUTS}")
    n = F.size(ids)
    keep = {"left": F.slice(ids, n - most + 1, F.lit(most)), "right": F.slice(ids, F.lit(1), F.lit(most)), "middle": F.concat(F.slice(ids, F.lit(1), F.lit(most // 2)), F.slice(ids, n - (most - most // 2) + 1, F.lit(most - most // 2)))}
    if cut == "error":
        return F.when(n > most, F.raise_error(F.lit("sequence too long"))).otherwise(ids)
    return F.when(n > most, keep[cut]).otherwise(ids)


def padded(ids: Column, to: int, pad, left: bool = True) -> Column:
    """Filled up to `to` entries on one side; longer arrays stay."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(to) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def without_left_pad(ids: Column, pad: int) -> Column:
    """From the first entry that isn't pad; empty if all are."""
    first = F.array_position(F.transform(ids, lambda x: x != pad), True)
    return F.when(first > 0, F.slice(ids, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(ids), F.lit(1)))).otherwise(F.slice(ids, 1, 0))


def without_masked_left(ids: Column, mask: Column) -> Column:
    """The last sum(mask) entries."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.slice(ids, F.size(ids) - n + 1, n)


def training_mask(mask: Column, prompt_length: Column) -> Column:
    """mask with zeros for all prompt tokens but the last and for the last position of the response."""
    last = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    drop = F.least(prompt_length, F.size(mask)) - 1
    return F.transform(mask, lambda m, i: F.when((i < drop) | (i == F.least(last, F.size(mask)) - 1), 0).otherwise(m))


def scattered(score: Column, mask: Column) -> Column:
    """Zeros, with the score at the last valid token; all zeros without a valid token."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.transform(mask, lambda m, i: F.when(i == n - 1, score).otherwise(F.lit(0.0)))


def continued_positions(positions: Column, more: int) -> Column:
    """positions with `more` entries counting on from the last."""
    last = F.coalesce(F.try_element_at(positions, F.lit(-1)), F.lit(-1))
    return F.concat(positions, F.sequence(last + 1, last + more)) if more > 0 else positions


def prompt_response_lengths(mask: Column, response: int) -> tuple[Column, Column]:
    """Valid tokens before and in the last `response` entries."""
    total = lambda m: F.aggregate(m, F.lit(0), lambda a, x: a + x.cast("int"))
    return total(mask) - total(last_of(mask, response)), total(last_of(mask, response))


def unpadded(ids: Column, mask: Column) -> Column:
    """The entries whose mask is 1."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("x"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["x"])


def pair_stack(chosen: Column, rejected: Column, to: int, pad, cut: str = "right") -> Column:
    """Array of the two sequences of a preference pair, cut and filled on the right to the same length."""
    return F.array(*(padded(truncated(x, to, cut), to, pad, left=False) for x in (chosen, rejected)))


def joined_response(prompt: Column, response: Column) -> Column:
    """Ids, masks or positions of the prompt followed by those of the response."""
    return F.concat(prompt, response)


def limited_request(prompt: Column, response: Column, most_response: int, most: int) -> Column:
    """The response cut to its own limit and to what the prompt leaves of the whole."""
    return F.slice(response, F.lit(1), F.least(F.lit(most_response), F.greatest(F.lit(most) - F.size(prompt), F.lit(0))))
