"""Token counts of texts by a public tokenizer's vocabulary file.

The file's path is a parameter; the vocabulary is read once per Python worker and never copied.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split of a text into words before merging that the vocabulary was made with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(vocabulary: str = DEFAULT_VOCABULARY):
    """The encoder of a rank file (base64 token, rank per line)."""
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """`keep` columns and the token count of `text`; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    counter = F.pandas_udf(count, "long")
    return df.select(*keep, counter(F.col(text)).alias(out))
