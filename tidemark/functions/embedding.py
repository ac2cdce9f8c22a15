"""Embedding as an extension point (E1): any function from texts to vectors, applied in Arrow batches;
the default is a deterministic hash embedder for tests and offline use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384


def hash_embed(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """A vector of -1..1 from a linear congruential generator seeded by a rolling hash of the text."""
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    state, out = (2**32 - h if h >= 2**31 else h) & 0x7FFFFFFF, []
    for _ in range(dimensions):
        state = (state * 1103515245 + 12345) & 0x7FFFFFFF
        out.append(2 * state / 0x7FFFFFFF - 1)
    return out


def embedded(df: DataFrame, text: Column, embed: Callable[[list[str]], list[list[float]]] | None = None, into: str = "embedding") -> DataFrame:
    """df with vectors of a text column. embed takes a batch of texts; it runs on the executors."""
    work = embed or (lambda texts: [hash_embed(t) for t in texts])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.asarray(v, float) for v in work(list(texts.fillna("")))])

    return df.withColumn(into, apply(text))
