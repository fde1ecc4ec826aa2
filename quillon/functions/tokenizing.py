"""Token counts by the ranks of a public byte-level vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies cut a text before pairs are merged.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """How many tokens a text has; 0 for a missing one."""

    @F.pandas_udf(LongType())
    def count(t: pd.Series) -> pd.Series:
        encode = encoder(tokenizer).encode_ordinary
        return pd.Series(np.array([len(encode(x)) if x else 0 for x in t], np.int64))

    return count(text)


def without_overlong(df: DataFrame, text: Column, most: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """The rows whose text has at most `most` tokens."""
    return df.withColumn("_n", n_tokens(text, tokenizer)).where(F.col("_n") <= most).drop("_n")
