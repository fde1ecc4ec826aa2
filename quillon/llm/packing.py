"""Packing texts into sequences of a fixed number of tokens, shortest pack first over the histogram of lengths.

Only the histogram goes to the driver: at most `capacity` numbers for each container, however many texts there are.
Lengths are placed longest first, each into the packs with the most room left; new packs are opened only where no pack
has room. Packs of the same pattern are one group, a range of sequence numbers with a common free room; placing k texts
of one length into a group of n packs moves k of its sequences to the longer pattern. Each placing is a row (container,
length, first rank, last rank, first sequence, start), and texts are joined back to these rows by their rank among the
texts of their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quillon.functions.tokenizing import TOKENIZER, encoder
from quillon.plans.staging import stage

BROADCAST_ROWS = 1_000_000  # of 44 bytes
RANKS = 1 << 20  # of one length in one block of the join that takes the place of a larger broadcast


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of each row whose text isn't null or blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t and not t.isspace() else 0 for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_tokens": np.array(n, np.int64)})

    kind = df.select(id_col).dtypes[0][1]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(run, f"id {kind}, n_tokens long").where("n_tokens > 0")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first sequence, start) and the number of sequences.

    histogram: how many items have each length of 1..capacity.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, number of sequences)
    rooms: list[int] = []  # heap of -room, once for each room in groups
    placed, opened = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room <= 0:
            return
        if room not in groups:
            groups[room] = []
            heapq.heappush(rooms, -room)
        groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                first, n = groups[room].pop()
                k = min(n, left)
                if k < n:
                    groups[room].append((first + k, n - k))
                if not groups[room]:
                    del groups[room]
                    heapq.heappop(rooms)
            else:
                room, first, k = capacity, opened, left
                opened += k
            placed.append((length, rank, rank + k, first, capacity - room))
            add(room - length, first, k)
            rank, left = rank + k, left - k
    return placed, opened


def pack(
    df: DataFrame, id_col: str, text_col: str, containers: DataFrame, name_col: str, capacity_col: str, *, tokenizer: str = TOKENIZER, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(container, id, piece, n_pieces, n_tokens, sequence, start): where each text goes in each container's sequences.

    A text of more tokens than the capacity is split into pieces of exactly the capacity and one last piece; no other
    text is split. Every row of df is a text of its own, also if it is repeated or its id is null; null and blank texts
    are left out. Containers without a positive capacity are ignored, as are other columns; empty tables give an empty
    result. Ids keep their type. Placings are broadcast up to broadcast_rows, and joined beyond.
    """
    spark = df.sparkSession
    # numbered once and for all, so that ranks don't depend on ids, which may be null or repeated
    sizes = stage(token_counts(df, id_col, text_col, tokenizer).withColumn("row", F.monotonically_increasing_id()), "sizes")
    kept = containers.select(F.col(name_col).alias("container"), F.col(capacity_col).cast("long").alias("capacity")).distinct()
    kept = [r for r in kept.collect() if r.container is not None and (r.capacity or 0) > 0]
    bins = F.array(*(F.struct(F.lit(r.container).alias("container"), F.lit(r.capacity).cast("long").alias("capacity")) for r in kept))
    shape = f"container string, id {sizes.dtypes[0][1]}, piece long, n_pieces long, n_tokens long, sequence long, start long"
    if not kept:
        return spark.createDataFrame([], shape)
    whole = sizes.select("id", "row", "n_tokens", F.explode(bins).alias("bin")).select("id", "row", "n_tokens", "bin.*")
    whole = whole.withColumn("n_pieces", F.expr("(n_tokens + capacity - 1) div capacity"))
    items = whole.select("container", "capacity", "id", "row", "n_pieces", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_pieces").cast("int") - 1)).alias("piece"))
    items = items.select(
        "container", "id", "row", F.col("piece").cast("long").alias("piece"), "n_pieces", F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("length")
    )
    # ranks inside shares of a length, so that no length goes to one task however many texts have it
    shares = max(8, -(-sizes.count() // 200_000))
    items = items.withColumn("share", F.pmod(F.xxhash64("row", "piece"), F.lit(shares)))
    counts = stage(items.groupBy("container", "length", "share").agg(F.count("*").alias("n")), "length-counts")
    histogram: dict[str, dict[int, int]] = {r.container: {} for r in kept}
    for r in counts.groupBy("container", "length").agg(F.sum("n").alias("n")).collect():  # bounded by the capacities
        histogram[r.container][r.length] = r.n
    rows = [(r.container, *x) for r in kept for x in shortest_pack_first(histogram[r.container], r.capacity)[0]]
    before = W.Window.partitionBy("container", "length").orderBy("share").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select("container", "length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.Window.partitionBy("container", "length", "share").orderBy("row", "piece")
    ranked = items.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["container", "length", "share"])
    ranked = ranked.select("container", "id", "piece", "n_pieces", "length", (F.col("rank") + F.col("before")).alias("rank"))
    table = pd.DataFrame(rows, columns=["container", "length", "low", "high", "first", "start"])
    if len(table) > broadcast_rows:
        block = lambda c: F.floor(F.col(c) / RANKS).cast("long")
        t = spark.createDataFrame(table).withColumn("block", F.explode(F.sequence(block("low"), F.floor((F.col("high") - 1) / RANKS).cast("long"))))
        joined = ranked.withColumn("block", block("rank")).join(t, ["container", "length", "block"]).where("rank >= low and rank < high")
        return joined.select("container", "id", "piece", "n_pieces", F.col("length").alias("n_tokens"), (F.col("first") + F.col("rank") - F.col("low")).alias("sequence"), "start")
    sent = spark.sparkContext.broadcast({c: g.sort_values(["length", "low"]).drop(columns="container") for c, g in table.groupby("container")})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {c: {k: g[k].to_numpy() for k in g} for c, g in sent.value.items()}
        span = 1 << 40
        keys = {c: g["length"] * span + g["low"] for c, g in at.items()}
        for batch in batches:
            for c, b in batch.groupby("container"):
                k = np.searchsorted(keys[c], b["length"].to_numpy() * span + b["rank"].to_numpy(), "right") - 1
                g = at[c]
                yield pd.DataFrame(
                    {"container": c, "id": b["id"], "piece": b["piece"], "n_pieces": b["n_pieces"], "n_tokens": b["length"], "sequence": g["first"][k] + b["rank"].to_numpy() - g["low"][k], "start": g["start"][k]}
                )

    return ranked.mapInPandas(place, shape)


def packed_room(packed: DataFrame, containers: DataFrame, name_col: str, capacity_col: str) -> DataFrame:
    """(container, n_sequences, n_tokens, unused, least_sequences): how well the sequences are filled."""
    c = containers.select(F.col(name_col).alias("container"), F.col(capacity_col).cast("long").alias("capacity")).distinct()
    total = packed.groupBy("container").agg((F.max("sequence") + 1).alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"))
    return total.join(c, "container").select(
        "container", "n_sequences", "n_tokens", (F.col("n_sequences") * F.col("capacity") - F.col("n_tokens")).alias("unused"), F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_sequences")
    )
