"""Groups of near-duplicate texts by multi-index hashing.

A text's fingerprint is a word over an alphabet of 16-bit symbols: symbol k is the hash of the text's least shingle under
the k-th random order, so two texts differ in a symbol with probability 1 - similarity, and their Hamming distance
estimates their similarity. (Fingerprints of single bits would need balls of radius 4 in segments of 16 bits to reach
similarity 0.7: a twentieth of the table for each probe.)

The fingerprint is cut into segments of five symbols, one table each. The ball of radius 1 round a segment is enumerated
by the five words that leave out one symbol: two segments within distance 1 share at least one of them. By the
pigeonhole principle every pair within a complete distance of 2 * segments - 1 is fetched; the number of segments is
chosen so that a pair exactly at the threshold is missed with a probability of at most `miss`, also beyond that
distance. Fetched pairs are verified by the complete distance and then exactly, on the texts.

No bucket is expanded into all its pairs. Texts with equal sets of shingles are first merged into one node. Then each
member of a bucket is verified against the bucket's least node only; the links found merge nodes into components; and
what is left to verify are the pairs of a bucket's members that lie in different components. A bucket's largest component
is held against the others, never against itself. Buckets of more than CROWDED nodes are split by further symbols, rare
ones: a node's first shingles in a global order with the rare ones first (see prefix), of which two similar texts share one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.prefix import first_members, member_counts
from quillon.llm.words import Hashes, hashed, jaccard, mix, shingles, words
from quillon.operators.components import connected_components
from quillon.plans.staging import stage

SYMBOLS = 5  # of a segment
KEPT = SYMBOLS - 1  # of them in each word of its ball
CROWDED = 256  # nodes of a bucket that is split further


def segments_for(threshold: float, miss: float) -> int:
    """Segments so that a pair at the threshold has none within distance 1 with probability miss at most."""
    hit = threshold**SYMBOLS + SYMBOLS * threshold**KEPT * (1 - threshold)
    return 1 if hit >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - hit)))


def _signed(width: int, least_words: int, segments: int):
    n = segments * SYMBOLS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(20240501)
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, n, dtype=np.uint64)
        cache = Hashes()
        for batch in batches:
            ids, lo, hi, sigs = [], [], [], []
            for i, text in zip(batch["id"], batch["text"]):
                w = words(text)
                if len(w) < max(least_words, width):
                    continue
                s = np.unique(shingles(hashed(w, cache), width))
                least = np.full(n, 2**64 - 1, np.uint64)
                for at in range(0, len(s), 4096):  # bounded memory for very long texts
                    np.minimum(least, (s[at : at + 4096, None] * a + b).min(axis=0), out=least)
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                ids.append(i)
                lo.append(np.int64(np.uint64(whole & (2**64 - 1)).astype(np.int64)))
                hi.append(np.int64(np.uint64(whole >> 64).astype(np.int64)))
                sigs.append((mix(least) >> np.uint64(48)).astype(">u2").tobytes())
            yield pd.DataFrame({"id": np.array(ids, np.int64), "h0": np.array(lo, np.int64), "h1": np.array(hi, np.int64), "sig": sigs})

    return run


def _balls(segments: int):
    """(key, id): the words of the balls of radius 1 round each segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch["sig"]), ">u2").astype(np.uint64).reshape(len(batch), segments, SYMBOLS)
            ids = batch["id"].to_numpy()
            for out in range(SYMBOLS):
                key = np.zeros(sig.shape[:2], np.uint64)
                for k in range(SYMBOLS):
                    if k != out:
                        key = (key << np.uint64(16)) | sig[:, :, k]
                key = mix(key + np.arange(segments, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(out))
                yield pd.DataFrame({"key": key.ravel().view(np.int64), "id": np.repeat(ids, segments)})

    return run


def _verified(width: int, threshold: float, limit: int):
    """Pairs whose complete distance is within the limit and whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, sets = Hashes(), {}

        def of(i: int, text: str) -> np.ndarray:
            if i not in sets:
                if len(sets) > 2000:
                    sets.clear()
                sets[i] = np.unique(shingles(hashed(words(text), cache), width))
            return sets[i]

        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch["sig_a"]), np.uint16).reshape(len(batch), -1)
            y = np.frombuffer(b"".join(batch["sig_b"]), np.uint16).reshape(len(batch), -1)
            near = batch[(x != y).sum(axis=1) <= limit]
            keep = [
                jaccard(of(a, s), of(b, t)) >= threshold - 1e-12
                for a, b, s, t in zip(near["a"], near["b"], near["text_a"], near["text_b"])
            ]
            yield near.loc[keep, ["a", "b"]] if len(near) else near[["a", "b"]]

    return run


def _apart(placed: DataFrame) -> DataFrame:
    """(a, b), the smaller first: pairs of ids of one key (key, id, part) that lie in different parts. A key's most
    frequent part is only held against the others, so that a hot part isn't paired with itself."""
    n = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    top = n.groupBy("key").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("m.part").alias("top"))
    rows = placed.join(top, "key")
    minor = rows.where("part <> top").select("key", F.col("id").alias("x"), F.col("part").alias("px"))
    pairs = minor.join(rows.select("key", F.col("id").alias("y"), F.col("part").alias("py")), "key").where("px <> py")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _split(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """(key, id, part) of rows (id, part, text): the first shingles of each text, rare ones first."""
    spark = rows.sparkSession

    def sets(batch: pd.DataFrame) -> Iterator[np.ndarray]:
        cache = Hashes()
        return (np.unique(shingles(hashed(words(t), cache), width)) for t in batch["text"])

    counts = spark.sparkContext.broadcast(member_counts(rows.select("text"), sets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            firsts = [s[first_members(s, counts.value, threshold)] for s in sets(batch)]
            n = [len(f) for f in firsts]
            if n:
                yield pd.DataFrame({"key": np.concatenate(firsts).view(np.int64), "id": np.repeat(batch["id"].to_numpy(), n), "part": np.repeat(batch["part"].to_numpy(), n)})

    return rows.mapInPandas(run, "key long, id long, part long")


def near_duplicate_groups(
    df: DataFrame, id_col: str, text_col: str, *, width: int = 5, threshold: float = 0.8, least_words: int = 1, miss: float = 1e-3, crowd: int = CROWDED, exact: bool = False
) -> DataFrame:
    """(id, class_id, group_id, n_links): one row for each text of at least least_words (and width) words.

    Texts with the same set of shingles share class_id, the least id of them; classes linked by a similarity of at least
    threshold, directly or through others, share group_id, the least id of the group; n_links counts the verified links
    of the class with other classes that were needed to find the group (every linked pair is connected by them, not
    every one is listed). Buckets of more than `crowd` nodes are split further, without a loss. With exact no link is
    missed at all: what the tables leave apart is compared by rare shingles too. id_col must hold integers; rows with a null id or text, and shorter texts, are left out; a row
    repeated with the same id and text counts once. Other columns are ignored. An empty input gives an empty result.
    """
    segments = segments_for(threshold, miss)
    n = segments * SYMBOLS
    limit = min(n, math.ceil(n * (1 - threshold) + 4.2 * math.sqrt(n * threshold * (1 - threshold))))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    signed = stage(texts.mapInPandas(_signed(width, least_words, segments), "id long, h0 long, h1 long, sig binary"), "signed")
    nodes = stage(signed.groupBy("h0", "h1").agg(F.min("id").alias("id"), F.min_by("sig", "id").alias("sig")), "nodes")
    keys = nodes.select("id", "sig").mapInPandas(_balls(segments), "key long, id long")

    buckets = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least")
    shared = stage(keys.join(buckets, "key"), "buckets")

    def verify(pairs: DataFrame, name: str, within: int = limit) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "sig"), "id")
        rows = stage(ends.join(texts, "id").dropDuplicates(["id"]), f"{name}-texts")
        both = pairs.join(rows.toDF("a", "sig_a", "text_a"), "a").join(rows.toDF("b", "sig_b", "text_b"), "b")
        return stage(both.mapInPandas(_verified(width, threshold, within), "a long, b long"), name)

    tried = stage(shared.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
    stars = verify(tried, "stars")
    parts = connected_components(stars)
    placed = shared.select("key", "id").join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    placed = stage(placed, "placed")
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key", "n")
    mixed = stage(placed.join(mixed, "key"), "mixed")  # buckets of one component are done
    apart = _apart(mixed.where(F.col("n") <= crowd).drop("n")).join(tried, ["a", "b"], "left_anti")
    if exact:
        dense = nodes.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("part"))
    else:
        dense = mixed.where(F.col("n") > crowd).select("id", "part").distinct()
    dense = dense.join(texts.dropDuplicates(["id"]), "id")
    split = _apart(stage(_split(stage(dense, "crowded"), width, threshold), "split-buckets")).join(tried, ["a", "b"], "left_anti")
    across = verify(stage(apart, "rest-pairs"), "across").union(verify(stage(split, "split-pairs"), "split", n))
    links = stage(stars.union(across).distinct(), "links")
    groups = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    classes = (
        nodes.join(groups, "id", "left")
        .join(degree, "id", "left")
        .select("h0", "h1", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return signed.select("id", "h0", "h1").distinct().join(classes, ["h0", "h1"]).select("id", "class_id", "group_id", "n_links")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(a, b): every pair of different ids of one group, smaller id first."""
    g = groups.select("group_id", "id").distinct()
    several = g.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    g = g.join(several, "group_id", "left_semi")
    return g.toDF("group_id", "a").join(g.toDF("group_id", "b"), "group_id").where("a < b").select("a", "b").distinct()
