"""Caption tokens: cleaned text to the ids of a word-ending BPE vocabulary, in a fixed window."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonlake.functions.text import clean_caption


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def body_ids(text: str, path: str) -> list[int]:
    return _tokenizer(path).encode(clean_caption(text), add_special_tokens=False).ids


def window_ids(text: str, path: str, window: int = 77, start: int = 49406, end: int = 49407) -> list[int]:
    """Start, as much of the text as fits, end, and zeros."""
    row = [start, *body_ids(text, path)[: window - 2], end]
    return row + [0] * (window - len(row))


def caption_ids(text: Column, path: str, window: int = 77) -> Column:
    """Token window of every text; null stays null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else window_ids(t, path, window))

    return encode(text)
