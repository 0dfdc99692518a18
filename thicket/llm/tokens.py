"""Sizes in tokens of a public byte-level BPE vocabulary, read from a path that every executor can see."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the rank file. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Tokens of a text; null and empty texts have none. Strings of special tokens count as ordinary text."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([len(x) for x in enc.encode_ordinary_batch([t or "" for t in s], num_threads=1)], dtype="int64")

    return count(text)


def sized(df: DataFrame, key: str, text: str, *others: str, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, others...) of the rows with a text; rows of no tokens drop out, as they take no room."""
    base = spread(df.select(key, text, *others).where(F.col(f"`{text}`").isNotNull()))
    return base.select(F.col(f"`{key}`").alias("doc_id"), token_count(F.col(f"`{text}`"), path).alias("tokens"), *others).where("tokens > 0")
