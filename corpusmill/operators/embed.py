"""Embedding of text through a provider; the built-in one hashes tokens and needs no network."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import tokenize
from corpusmill.runtime import ship


class HashingProvider:
    """Signed counts of hashed tokens, of length 1; text without tokens is the zero vector."""

    def __init__(self, dimension: int = 128):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for t in tokenize(text or ""):
                h = zlib.crc32(t.encode())
                row[h % self.dimension] += 1.0 if (h >> 16) & 1 else -1.0
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out.tolist()


#: Makers of providers by name. A provider has ``embed(texts) -> list of vectors`` and ``dimension``; see :func:`register`.
PROVIDERS: dict[str, Callable[..., object]] = {"hashing": lambda dimension, **_: HashingProvider(dimension)}
#: Names whose maker must be given a key.
_KEYED: set[str] = set()


def register(name: str, make: Callable[..., object], needs_key: bool = False) -> None:
    """Make a provider known: ``make(dimension=, model=, host=, api_key=)`` is called once per worker batch.

    It travels to the workers with the plan, so it must be picklable.
    """
    PROVIDERS[name] = make
    _KEYED.discard(name)
    if needs_key:
        _KEYED.add(name)


def provider(name: str, dimension: int, **settings: str):
    """A provider; an unknown name and a missing key are errors."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider: {name}")
    if name in _KEYED and not settings.get("api_key"):
        raise ValueError(f"the embedding provider {name} needs a key")
    return PROVIDERS[name](dimension=dimension, **settings)


def embed(df: DataFrame, text: str = "content", into: str = "embedding", name: str = "hashing", dimension: int = 128, **settings: str) -> DataFrame:
    """``df`` with the vector of its text; null text gives null. Batches go to the provider whole.

    A vector of another length than ``dimension`` is an error of the task.
    """
    ship(df.sparkSession)
    provider(name, dimension, **settings)  # fails here rather than in a task
    make = PROVIDERS[name]

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        vectors = make(dimension=dimension, **settings).embed(s.fillna("").tolist())
        if len(vectors) != len(s) or any(len(v) != dimension for v in vectors):
            raise ValueError(f"the embedding provider {name} did not give {len(s)} vectors of {dimension} values")
        return pd.Series([v if ok else None for v, ok in zip(vectors, s.notna())])

    return df.withColumn(into, run(F.col(text)))
