"""Passages of held-out items inside a corpus.

Every run of `passage` consecutive words of an item is one passage, and every run of as many words of a document one
window. Both get a 64-bit SimHash of their words, weighted by their counts. The fingerprints are cut into radius + 1
blocks: two fingerprints within the radius agree in at least one block, so looking up each block in its table fetches
every passage within the radius of a window. Fetched passages are verified by the complete distance, then by the exact
similarity of the window's and the passage's shingles, weighted by their counts (sum of least counts over sum of greatest
counts). At a required similarity of 1 the words are then compared one by one, since different orders of repeated words
may have the same shingles.

Documents are only scanned and never shuffled; what is shuffled are the pairs found. The items are the stated query set:
they are taken in blocks of a bounded number of passages, and each block is held against all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import WORD, Hashes, hashed, mix, shingles
from quillon.plans.staging import stage

# Characters that a reader doesn't see (soft hyphen, joiners, zero-width and bidirectional marks,
# variation selectors, byte order mark).
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")

BITS = 64
CHUNK = 1 << 14  # words whose fingerprints are computed at once


def as_read(text: str | None) -> list[str]:
    """The words as a reader sees them: compatibility forms, case and invisible characters make no difference."""
    if not text:
        return []
    if text.isascii():
        return WORD.findall(text.lower())
    return WORD.findall(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold()))


def simhashes(h: np.ndarray, passage: int) -> np.ndarray:
    """The fingerprint of each run of passage words, given the words' hashes."""
    n = len(h) - passage + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, CHUNK):
        part = h[at : min(at + CHUNK, n) + passage - 1]
        bits = np.unpackbits(part.view(np.uint8)).reshape(len(part), BITS)
        total = np.zeros((len(part) + 1, BITS), np.int16)
        np.cumsum(bits, axis=0, dtype=np.int16, out=total[1:])
        ones = total[passage:] - total[:-passage]
        out[at : at + len(ones)] = np.packbits(ones * 2 > passage, axis=1).view(np.uint64).ravel()
    return out


def _cuts(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that make up the fingerprint."""
    edges = [round(BITS * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _passages(passage: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"]):
                h = mix(hashed(as_read(text), cache))
                fp = simhashes(h, passage)
                if len(fp):
                    runs = np.lib.stride_tricks.sliding_window_view(h, passage)
                    yield pd.DataFrame({"item": item, "fp": fp.view(np.int64), "words": [r.tobytes() for r in runs]}).drop_duplicates()

    return run


class _Index:
    """Tables from each block of the fingerprint to the passages that have it."""

    def __init__(self, rows: pd.DataFrame, passage: int, radius: int):
        self.item = rows["item"].to_numpy(np.int64)
        self.fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        self.words = np.frombuffer(b"".join(rows["words"]), np.uint64).reshape(-1, passage)
        self.radius, self.tables = radius, []
        for shift, width in _cuts(radius):
            block = (self.fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            order = np.argsort(block, kind="stable")
            low = np.uint64(min(width, 22))
            there = np.zeros(1 << int(low), bool)
            there[block & ((np.uint64(1) << low) - np.uint64(1))] = True
            self.tables.append((np.uint64(shift), np.uint64((1 << width) - 1), (np.uint64(1) << low) - np.uint64(1), there, block[order], order))

    def fetch(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, passage) pairs within the radius."""
        at, to = [], []
        for shift, mask, low, there, keys, order in self.tables:
            block = (fp >> shift) & mask
            maybe = np.flatnonzero(there[block & low])
            first = np.searchsorted(keys, block[maybe], "left")
            n = np.searchsorted(keys, block[maybe], "right") - first
            w = np.repeat(maybe, n)
            p = order[np.repeat(first, n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)]
            near = np.bitwise_count(fp[w] ^ self.fp[p]) <= self.radius
            at.append(w[near])
            to.append(p[near])
        return np.concatenate(at), np.concatenate(to)


def _numbered(x: np.ndarray) -> np.ndarray:
    """For each value of each row, how many equal values stand before it in the row."""
    k = x.shape[1]
    return ((x[:, :, None] == x[:, None, :]) & np.tri(k, k, -1, bool)).sum(axis=2)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: the sum of least counts over the sum of greatest counts of the row's values in a and in b."""
    if not len(a):
        return np.empty(0)
    n, m = _numbered(a), _numbered(b)
    both = ((a[:, :, None] == b[:, None, :]) & (n[:, :, None] == m[:, None, :])).any(axis=2).sum(axis=1)
    return both / (a.shape[1] + b.shape[1] - both)


def _shingled(words: np.ndarray, width: int) -> np.ndarray:
    """The hashes of the shingles of each row of words."""
    n = words.shape[1] - width + 1
    flat = shingles(words.ravel(), width)
    return np.lib.stride_tricks.sliding_window_view(flat, n)[:: words.shape[1]] if len(flat) else np.empty((0, n), np.uint64)


def _search(index, passage: int, similarity: float, shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, ix = Hashes(), index.value
        for batch in batches:
            docs, lists = [], []
            for doc, text in zip(batch["doc"], batch["text"]):
                w = as_read(text)
                if len(w) >= passage:
                    docs.append(doc)
                    lists.append(hashed(w, cache))
            if not docs:
                continue
            h = mix(np.concatenate(lists))
            length = np.array([len(x) for x in lists])
            start = np.cumsum(length) - length
            w, p = ix.fetch(simhashes(h, passage))
            of = np.searchsorted(start, w, "right") - 1
            inside = w + passage <= (start + length)[of]  # a window lies in one document
            w, p, of = w[inside], p[inside], of[inside]
            good = np.zeros(len(w), bool)
            for k in range(0, len(w), CHUNK):
                mine, theirs = h[w[k : k + CHUNK, None] + np.arange(passage)], ix.words[p[k : k + CHUNK]]
                near = weighted_similarity(_shingled(mine, shingle), _shingled(theirs, shingle)) >= similarity - 1e-12
                good[k : k + CHUNK] = near & (mine == theirs).all(axis=1) if similarity >= 1 else near
            hit = pd.DataFrame({"doc": np.array(docs)[of[good]], "item": ix.item[p[good]], "word": w[good] - start[of[good]]}).drop_duplicates()
            yield hit.groupby(["doc", "item"], as_index=False).agg(n_passages=("word", "size"), first_word=("word", "min"), last_word=("word", "max"))

    return run


def leaked_passages(
    docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, *, passage: int = 12, radius: int = 2, similarity: float = 1.0, shingle: int = 5, block: int = 400_000
) -> DataFrame:
    """(doc, item, n_passages, first_word, last_word): documents that contain passages of items.

    With similarity 1, n_passages counts the places at which passage consecutive words of the item stand in the document
    as consecutive words (see as_read); first_word and last_word are the first and last of these places. With less,
    windows within radius count too whose shingles (runs of `shingle` words, at most passage) reach that weighted similarity. Ids must be integers; rows with a null id or
    text, and items or documents of fewer than passage words, can't match. Repeated rows give one row. Other columns are
    ignored; empty tables give an empty result. block is the number of passages held in memory at once; more are taken
    in several passes over the documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    passages = stage(wanted.mapInPandas(_passages(passage), "item long, fp long, words binary").distinct(), "passages")
    found = spark.createDataFrame([], "doc long, item long, n_passages long, first_word long, last_word long")
    n = passages.count()
    blocks = max(1, -(-n // block))
    share = F.pmod(F.xxhash64("fp", "item"), F.lit(blocks))
    for k in range(blocks if n else 0):
        # at most about `block` rows of the query set, whatever the size of the corpus
        index = spark.sparkContext.broadcast(_Index(passages.where(share == k).toPandas(), passage, radius))
        found = found.union(texts.mapInPandas(_search(index, passage, similarity, min(shingle, passage)), found.schema))
    return found.groupBy("doc", "item").agg(
        F.sum("n_passages").alias("n_passages"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")
    )
