"""Sizes of texts in tokens of a public tokenizer, given by its file of ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the public vocabularies lie; every executor must see them. A parameter of all that count tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str = TOKENIZER):
    """The tokenizer of a file of ranks; built once per Python process."""
    import tiktoken
    from tiktoken import registry

    name = f"earshot:{path}"
    if name not in registry.ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return registry.ENCODINGS[name]


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """The number of tokens of a text; 0 for null or empty ones. The strings of special tokens are ordinary text."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for part in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in part], dtype="int64")

    return count(text)
