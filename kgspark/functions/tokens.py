"""Tokenizers: a lossless pattern by default, BPE when its file is at hand."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A token is a word with the white space before it; trailing space is one token.
TOKEN_PATTERN = r"\s*\S+|\s+$"


def _pattern_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


_TOKENIZERS: dict[str, Callable[[Column], Column]] = {"pattern": _pattern_tokens}


def register(name: str, tokenize: Callable[[Column], Column]) -> None:
    """Add a tokenizer: text column in, array of token texts out, joined again losslessly."""
    _TOKENIZERS[name] = tokenize


def register_bpe(encoding: str = "cl100k_base") -> None:
    """Add a BPE tokenizer; needs the encoding's file on every executor."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def bpe(texts: pd.Series) -> pd.Series:
        import tiktoken

        enc = tiktoken.get_encoding(encoding)
        # bytes as latin-1 text, since a token may end inside a character
        return texts.map(
            lambda t: None
            if t is None
            else [b.decode("latin-1") for b in enc.decode_tokens_bytes(enc.encode(t, disallowed_special=()))]
        )

    register(encoding, bpe)


def tokens(text: Column, tokenizer: str = "pattern") -> Column:
    return _TOKENIZERS[tokenizer](text)


def count(text: Column, tokenizer: str = "pattern") -> Column:
    return F.coalesce(F.size(tokens(text, tokenizer)), F.lit(0)) if tokenizer != "pattern" else F.coalesce(
        F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0)
    )


def join(parts: Column) -> Column:
    return F.array_join(parts, "")
