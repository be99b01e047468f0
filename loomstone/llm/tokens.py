"""Sizes of texts in tokens of a public tokenizer; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rank file of a byte-level BPE for many languages.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = VOCABULARY) -> Callable[[str], list[int]]:
    """Text to token ids; the vocabulary is loaded once per process."""
    import tiktoken

    loaded = tiktoken.__dict__.setdefault("_loaded_vocabularies", {})
    if path not in loaded:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return loaded[path].encode_ordinary


def count(text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens of a whole text; 0 for null and empty texts."""

    def sizes(texts: pd.Series) -> pd.Series:
        encode = encoder(path)
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return F.pandas_udf(sizes, "long")(text)
