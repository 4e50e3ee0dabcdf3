"""Models are plugged in; these are the protocols and deterministic stand-ins."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EmbeddingModel:
    name: str = "hashed-words"
    dimension: int = 384


class Embedder(Protocol):
    """Gives unit vectors for a text column, as array<float>."""

    model: EmbeddingModel

    def embed(self, text: Column) -> Column: ...


class PairScorer(Protocol):
    """Scores (question, text) pairs, as double."""

    def __call__(self, question: Column, text: Column) -> Column: ...


class Verifier(Protocol):
    """Judges (claim, evidence) pairs, as one of the verdicts."""

    def __call__(self, claim: Column, evidence: Column) -> Column: ...


class Generator(Protocol):
    """Adds answer, model, token counts and latency to prompts."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


def hashed_words(values: pd.Series, size: int) -> np.ndarray:
    """Unit rows of hashed word counts for a batch of texts; each distinct word is hashed once."""
    found = values.fillna("").str.lower().str.findall(r"[\w-]+")
    row = np.repeat(np.arange(len(values)), found.str.len().to_numpy(int))
    code, names = pd.factorize(np.array([w for words in found for w in words], object))
    h = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in names], np.int64)
    out = np.zeros((len(values), size))
    if len(h):
        np.add.at(out, (row, (h % size)[code]), np.where(h >> 16 & 1, 1.0, -1.0)[code])
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(length > 0, length, 1.0)).astype(np.float32)


class HashedWords:
    """Unit vectors of hashed word counts: equal texts are equal, shared words bring texts near."""

    def __init__(self, dimension: int = 384) -> None:
        self.model = EmbeddingModel(dimension=dimension)

    def embed(self, text: Column) -> Column:
        size = self.model.dimension

        @F.pandas_udf("array<float>")
        def embed(values: pd.Series) -> pd.Series:
            return pd.Series(list(hashed_words(values, size)))

        return embed(text)
