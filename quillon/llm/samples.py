"""Bounded samples of labelled texts, on which models are fitted; nothing else is ever computed on them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = re.compile(r"[^\n.!?。！？]*(?:[.!?。！？]+|\n|$)\s*")
HASHES = 2**63 - 1  # the greatest hash without its sign: fine enough for a few texts of any number
PASSAGE = 1000  # characters of a passage of the sample; longer ones are cut into several


def passages(text: str, most: int | None = None) -> list[str]:
    """Sentences or lines of at most PASSAGE characters, in order; if there are more than `most`, those of the least hashes."""
    cut = [s[k : k + PASSAGE] for s in SEGMENT.findall(text) for k in range(0, len(s), PASSAGE)]
    if most is None or len(cut) <= most:
        return cut
    order = sorted(range(len(cut)), key=lambda k: xxhash.xxh3_64_intdigest(cut[k].encode("utf-8", "surrogatepass")))
    return [cut[k] for k in sorted(order[:most])]


def labelled_sample(df: DataFrame, text_col: str, lang_col: str, per_language: int, per_text: int, languages: int) -> list[tuple[str, list[str]]]:
    """(label, passages of a text): the label is the first two letters of lang_col, in lower case.

    For each of the `languages` most frequent labels about per_language distinct texts are drawn by their hashes, and of
    each at most per_text passages; all other labels are drawn from together, as one (""). Copies of a text count once.
    """
    lang = F.substring(F.lower(F.trim(F.col(lang_col))), 1, 2)
    rows = df.select(F.xxhash64(text_col).alias("h"), lang.alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and lang <> 'un'")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    frequent = {r.lang: r.n for r in sizes.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not frequent:
        return []
    rare = sizes.where(~F.col("lang").isin(*frequent)).agg(F.sum("n").alias("n")).first().n
    share = lambda n: min(HASHES, HASHES * per_language // max(1, n))
    known = F.create_map(*(F.lit(x) for k, n in frequent.items() for x in (k, share(n))))
    rows = rows.withColumn("share", F.coalesce(known[F.col("lang")], F.lit(share(rare or 0))))
    rows = rows.withColumn("lang", F.when(F.col("lang").isin(*frequent), F.col("lang")).otherwise(""))
    sample = rows.where(F.col("h").bitwiseAND(F.lit(HASHES)) <= F.col("share")).dropDuplicates(["lang", "h"]).select("lang", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "passages": [passages(t, per_text) for t in b["text"]]})

    return [(r.lang, r.passages) for r in sample.mapInPandas(cut, "lang string, passages array<string>").toLocalIterator()]
