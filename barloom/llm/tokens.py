"""Token counts of texts under a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how the byte-level tokenizers cut a text before they merge bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoder(name: str, folder: str):
    """The tokenizer whose ranks lie in the folder; special tokens' strings are ordinary text."""
    import tiktoken

    with open(Path(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, name: str = "byte_bpe_50k", folder: str = "/opt/tokenizers") -> Column:
    """Tokens of each whole text; 0 for a null one."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(name, folder)
        for texts in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")(text)
