"""Token counts of texts under a public tokenizer, inside Spark tasks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary: byte-level BPE ranks with 50,256 ids. A parameter everywhere; never copied here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns `keep` of df and `tokens` (long): the number of tokens of `text`; 0 for null, texts read whole."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            t = b.pop("_text")
            b["tokens"] = pd.Series([len(enc.encode_ordinary(x)) if isinstance(x, str) else 0 for x in t], index=b.index, dtype="int64")
            yield b

    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(run, schema)
