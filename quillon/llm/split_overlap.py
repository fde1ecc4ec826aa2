"""Records of evaluation splits that also occur, exactly or almost, in the training split.

A record's fields become sequences of tokens: the words of its user message, and its distinct tests. Equal sequences are
one node, whose set holds its distinct runs of `width` words, or its tests.

The sequences' suffixes are sorted in one array that is partitioned by ranges of (first `width` tokens, tokens after
them). Suffixes with the same first tokens form a run; where neighbours in the array come from different splits, the run
holds a shared span, and all other runs are dropped. A run may be longer than a partition: partitions are cut anywhere,
and the suffixes at their ends are compared once more.

Not all suffixes are needed. A similarity of sets doesn't ask for one long shared span (reordered items of a frame share
only short ones), but it does ask for shared members: all members have one global order, and if two sets reach the
similarity t, the first n - ceil(t n) + 1 members of both have one in common. So the array holds the suffixes that start
at these members, and no pair at the threshold is lost, for any width, threshold, order or repetition. Any order is
right; the one taken puts rare members first (see prefix), so that the phrases of a repeated frame are looked at only
where a text has nothing rarer.

The suffixes of a shared run are then held against each other across the splits. The key of that join also holds a band
of sizes, and its condition two upper bounds of the similarity, none of which drops a pair that reaches the threshold at
its first common member: what can still be shared from the two places in the order on, and 256-bit parity maps of the
sets, whose differing bits are at most the differing members. What passes is verified exactly. The spans that a
verified pair shares are merged, over all partners, into the coverage of the evaluation record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.prefix import first_members, member_counts
from quillon.llm.words import Hashes, hashed, jaccard, mix, shingles, words
from quillon.plans.staging import stage

LINE = re.compile(r"\r\n|\r|\n")
LONG, SHORT = 9, 5  # words of a span that counts as shared in the coverage
LONG_FROM = 29  # words of a text whose spans are LONG
MAP_BITS = 256
TAIL = 4  # tokens after the first ones by which the suffixes of a run are sorted, by 16 bits of each one's hash
RANGE_ROWS = 2_000_000  # suffixes in one range of the array
TRAIN, HELD, BOTH = 1, 2, 3
LEAST_TESTS = 3


def test_text(x) -> str:
    """A test's input or output: its lines, trimmed, without outer blank lines."""
    if isinstance(x, list):
        x = "\n".join("" if y is None else y if isinstance(y, str) else json.dumps(y) for y in x)
    elif not isinstance(x, str):
        x = "" if x is None else json.dumps(x)
    return re.sub(r"\A\n+|\n+\Z", "", "\n".join(line.strip() for line in LINE.split(x)))


def tests_of(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct tests; empty if the JSON is missing or unreadable."""
    try:
        found = json.loads(text)
        pairs = list(zip(found["inputs"], found["outputs"]))
    except (TypeError, ValueError, KeyError, RecursionError):
        return np.empty(0, np.uint64)
    return np.array(sorted({xxhash.xxh3_64_intdigest(json.dumps([test_text(a), test_text(b)])) for a, b in pairs}), np.uint64)


def _sequences(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            out = []
            for i, text, tests in zip(batch["id"], batch["text"], batch["tests"]):
                for field, seq, least in (("user", hashed(words(text), cache), width), ("tests", tests_of(tests), LEAST_TESTS)):
                    if len(seq) >= least:
                        x = xxhash.xxh3_128_intdigest(seq.tobytes())
                        out.append((i, field, x & (2**64 - 1), x >> 64, seq.tobytes()))
            frame = pd.DataFrame(out, columns=["id", "field", "h0", "h1", "seq"])
            for h in ("h0", "h1"):
                frame[h] = frame[h].to_numpy(np.uint64).view(np.int64)
            yield frame

    return run


def _set(field: str, seq: np.ndarray, width: int) -> np.ndarray:
    return np.unique(shingles(seq, width)) if field == "user" else seq


def parity(s: np.ndarray) -> np.ndarray:
    """Four 64-bit words; each bit is the parity of the members that hash to it."""
    bits = np.bincount((mix(s) >> np.uint64(8)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _suffixes(width: int, near: dict[str, float], counts):
    """The suffixes that start at the first members of each set: their first tokens' hash, the tokens after them, the
    place in the global order, and what bounds the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for node, field, side, seq in zip(batch["node"], batch["field"], batch["side"], batch["seq"]):
                seq = np.frombuffer(seq, np.uint64)
                after = width if field == "user" else 1
                s, start = np.unique(shingles(seq, width), return_index=True) if field == "user" else (seq, np.arange(len(seq)))
                first = first_members(s, counts.value, near[field])
                short = np.concatenate([seq >> np.uint64(64 - 64 // TAIL), np.zeros(after + TAIL, np.uint64)])
                at, tail = start[first] + after, np.zeros(len(first), np.uint64)
                for k in range(TAIL):
                    tail = (tail << np.uint64(64 // TAIL)) | short[at + k]
                parts.append((node, side, field == "user", len(s), parity(s), s[first].view(np.int64), tail.view(np.int64)))
            if parts:
                n = [len(p[5]) for p in parts]
                each = lambda k, kind: np.repeat(np.array([p[k] for p in parts], kind), n)
                yield pd.DataFrame(
                    {"key": np.concatenate([p[5] for p in parts]), "tail": np.concatenate([p[6] for p in parts]), "side": each(1, np.int8), "text": each(2, bool), "node": each(0, np.int64)}
                    | {"place": np.concatenate([np.arange(k, dtype=np.int32) for k in n]), "size": each(3, np.int32)}
                    | {f"m{k}": np.repeat([p[4][k] for p in parts], n) for k in range(4)}
                )

    return run


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of runs in which neighbours come from different splits; the partition's first and last suffix."""
    part = TaskContext.get().partitionId()
    row = lambda end, key, side: pd.DataFrame({"part": [part], "end": [end], "key": [key], "side": [side]})
    last = None
    for batch in batches:
        key, side = batch["key"].to_numpy(), batch["side"].to_numpy()
        if not len(key):
            continue
        if last is None:
            yield row(0, key[0], side[0])
        else:
            key, side = np.append(last[0], key), np.append(last[1], side)
        met = key[1:][(key[1:] == key[:-1]) & (side[1:] != side[:-1])]
        met = np.unique(np.append(met, key[side == BOTH]))
        yield pd.DataFrame({"part": part, "end": -1, "key": met, "side": BOTH})
        last = key[-1], side[-1]
    if last is not None:
        yield row(1, *last)


def shared_runs(suffixes: DataFrame) -> DataFrame:
    """(key): first tokens of the runs of the sorted array (key, tail, side) that hold suffixes of both splits."""
    rows = suffixes.select("key", "tail", "side")
    n = max(suffixes.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    order = ["key", "tail", "side"]
    # a random last key lets a range end inside suffixes that are all alike
    array = rows.withColumn("salt", F.rand(11)).repartitionByRange(n, *order, "salt").sortWithinPartitions(*order)
    found = stage(array.select(*order).mapInPandas(_meetings, "part int, end int, key long, side int"), "suffix-runs")
    # one row for each end of a range: where a run goes on in the next range, its ends are neighbours too
    at = Window.orderBy("part", "end")
    ends = found.where("end >= 0").select("part", "end", "key", "side", F.lag("key").over(at).alias("k"), F.lag("side").over(at).alias("s"))
    cut = ends.where("end = 0 and k = key and s <> side").select("key")
    return found.where("end < 0").select("key").union(cut).distinct()


def spans(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Start and end of the maximal stretches of b that are covered by runs of at least n tokens that a has too."""
    x, y = shingles(a, n), shingles(b, n)
    if not len(y):
        return [(0, len(b))] if len(a) == len(b) and bool((a == b).all()) else []
    hit = np.zeros(len(b) + 1, np.int64)
    at = np.flatnonzero(np.isin(y, x))
    np.add.at(hit, at, 1)
    np.add.at(hit, at + n, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(hit)[:-1] > 0).astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _verify(width: int, near: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, field, x, y in zip(batch["a"], batch["b"], batch["field"], batch["seq_a"], batch["seq_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                j = jaccard(_set(field, x, width), _set(field, y, width))
                if j >= near[field] - 1e-12:
                    n = 1 if field == "tests" else LONG if len(y) >= LONG_FROM else SHORT
                    out.append((a, b, field, j, len(y), [{"start": p, "end": q} for p, q in spans(x, y, n)]))
            yield pd.DataFrame(out, columns=["a", "b", "field", "similarity", "n", "spans"]).astype({"a": "int64", "b": "int64", "field": "object", "similarity": "float64", "n": "int32", "spans": "object"})

    return run


class SplitOverlap:
    """Overlaps of the rows of df with trained true and those with trained false.

    id_col must hold integers. text_col is a text or null; tests_col a JSON object of `inputs` and `outputs` or null;
    trained_col is a boolean, null rows are left out, as are null ids. Texts are close at a similarity of their runs of
    `width` words of text_threshold; tests count for rows of at least 3 distinct ones, at tests_threshold. A row whose
    one field is missing, unreadable or of fewer than 3 words or tests takes part with the other. Repeated rows,
    other columns and empty tables do no harm; a row with the same id on both sides isn't paired with itself.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, tests_col: str, trained_col: str, *, width: int = 5, text_threshold: float = 0.8, tests_threshold: float = 0.8):
        near = {"user": text_threshold, "tests": tests_threshold}
        rows = df.select(
            F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(tests_col).alias("tests"), F.col(trained_col).alias("trained")
        ).where("id is not null and trained is not null")
        sides = rows.select("id", "trained").distinct()
        seqs = stage(rows.select("id", "text", "tests").mapInPandas(_sequences(width), "id long, field string, h0 long, h1 long, seq binary").join(sides, "id"), "sequences")
        nodes = seqs.groupBy("field", "h0", "h1").agg(
            (F.max(F.col("trained").cast("int")) + 2 * F.max((~F.col("trained")).cast("int"))).cast("byte").alias("side"), F.first("seq").alias("seq")
        )
        nodes = stage(nodes.withColumn("node", F.xxhash64("field", "h0", "h1")), "sequence-nodes")
        self.members = seqs.select("id", "trained", F.xxhash64("field", "h0", "h1").alias("node")).distinct()
        shape = "key long, tail long, side byte, text boolean, node long, place int, size int, m0 long, m1 long, m2 long, m3 long"

        def sets(batch: pd.DataFrame) -> Iterator[np.ndarray]:
            return (_set(f, np.frombuffer(x, np.uint64), width) for f, x in zip(batch["field"], batch["seq"]))

        counts = df.sparkSession.sparkContext.broadcast(member_counts(nodes.select("field", "seq"), sets))
        suffixes = stage(nodes.select("node", "field", "side", "seq").mapInPandas(_suffixes(width, near, counts), shape), "suffixes")
        live = suffixes.join(shared_runs(suffixes), "key", "left_semi")

        t = F.when(F.col("text"), F.lit(text_threshold)).otherwise(F.lit(tests_threshold))
        # sizes of a pair at the threshold differ by a factor of 1 / t at most: their bands are the same or next to it
        band = F.floor(F.log("size") / F.greatest(-F.log(t), F.lit(1e-9))).cast("long")
        carried = ("node", "place", "size", "m0", "m1", "m2", "m3")
        side = lambda of, end, b: live.where(F.col("side").isin(of, BOTH)).select("key", "text", b.alias("band"), *(F.col(c).alias(c + end) for c in carried))
        a, b = side(TRAIN, "_a", band), side(HELD, "_b", F.explode(F.array(band - 1, band, band + 1)))
        differing = sum((F.bit_count(F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b"))) for k in range(4)), F.lit(0))
        total = F.col("size_a") + F.col("size_b")
        left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
        may_reach = (left >= total * t / (1 + t) - 1e-6) & (differing <= total * (1 - t) / (1 + t) + 1e-6)
        pairs = (
            a.join(b, ["key", "text", "band"])
            .where((F.col("node_a") != F.col("node_b")) & may_reach)
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
            .distinct()
        )
        pairs = stage(pairs, "overlap-pairs")
        known = nodes.select("node", "field", "seq")
        both = pairs.join(known.toDF("a", "field", "seq_a"), "a").join(known.select("node", "seq").toDF("b", "seq_b"), "b")
        links = both.mapInPandas(_verify(width, near), "a long, b long, field string, similarity double, n int, spans array<struct<start:int,end:int>>")
        n = (F.length("seq") / 8).cast("int")
        whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
        same = nodes.where(F.col("side") == BOTH).select(F.col("node").alias("a"), F.col("node").alias("b"), "field", F.lit(1.0).alias("similarity"), n.alias("n"), whole.alias("spans"))
        self.links = stage(links.unionByName(same), "overlap-links")

    def pairs(self) -> DataFrame:
        """(a, b): every pair of a training and a held-out row, smaller id first."""
        m = self.members
        left = m.where("trained").select(F.col("node").alias("a"), F.col("id").alias("x"))
        right = m.where("not trained").select(F.col("node").alias("b"), F.col("id").alias("y"))
        found = self.links.select("a", "b").join(left, "a").join(right, "b").where("x <> y")
        return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def overlapping(self) -> DataFrame:
        """(id, by_text, by_tests, coverage): held-out rows with a partner, without listing the partners.

        coverage is the share of the row's words, or of its tests if that is more, inside spans that it shares with the
        rows it overlaps with, merged over all of them.
        """
        found = self.links.groupBy("b", "field", "n").agg(F.count("*").alias("n_links"))
        pieces = self.links.select("b", F.explode("spans").alias("s")).select("b", "s.start", "s.end").distinct()
        before = F.max("end").over(Window.partitionBy("b").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
        fresh = pieces.select("b", (F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("new")).groupBy("b").agg(F.sum(F.greatest("new", F.lit(0))).alias("covered"))
        best = found.join(fresh, "b", "left").select("b", "field", (F.coalesce("covered", F.lit(0)) / F.col("n")).alias("coverage"))
        held = self.members.where("not trained").select("id", F.col("node").alias("b"))
        return held.join(best, "b").groupBy("id").agg(
            F.bool_or(F.col("field") == "user").alias("by_text"), F.bool_or(F.col("field") == "tests").alias("by_tests"), F.max("coverage").alias("coverage")
        )
