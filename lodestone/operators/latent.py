"""An embedder learned from the corpus: randomised SVD of a hashed tf-idf matrix.

Words are hashed to `features` columns; a row holds (1 + log tf) * idf at unit
length, with idf = 1 + log((1 + n) / (1 + df)) counted over all texts. The right
singular vectors come from subspace iteration: each round multiplies A'A with a
narrow matrix, in one pass over the texts. A task adds up its product in one
features x (dimension + extra) matrix and emits it as blocks; blocks are summed
by a shuffle of that size a task. What reaches the driver is one such matrix,
whatever the size of the corpus, and a model is a table of `features` rows.

A text's vector is its row times the singular vectors, at unit length.

Defined results: null texts and texts without a word have the zero vector and
weigh nothing in the fit; they count in n, as rows without words. Repeated rows
count as often as they occur. An empty corpus, or fewer independent texts than
`dimension`, gives vectors whose further entries are 0. Words that share a
column are one word. The sign of each singular vector is such that its largest
entry is positive, so a fit repeats up to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.models import EmbeddingModel
from lodestone.session import drop_stash, ship_package, stash

SCHEMA = "feature int, idf double, vector array<float>"
#: Rows of a matrix that travel as one, and texts that are multiplied at a time.
BLOCK, TEXTS = 256, 64


@dataclass(frozen=True)
class Settings:
    """extra: columns beyond dimension that the iteration carries; rounds: products with A'A before the last one."""

    dimension: int = 64
    features: int = 1 << 14
    extra: int = 16
    rounds: int = 3
    seed: int = 7


def columns(words: Column, features: int) -> Column:
    """The columns of words, in order, with repeats."""
    return F.transform(words, lambda w: F.pmod(F.crc32(F.encode(w, "utf-8")), F.lit(features)).cast("int"))


def rows_of(lists: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit tf-idf rows over the columns that occur, and which these are."""
    size = len(idf)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    held = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(row) else np.empty(0, np.int64)
    key, n = np.unique(row * size + held, return_counts=True)
    row, held = np.divmod(key, size)
    used, at = np.unique(held, return_inverse=True)
    out = np.zeros((len(lists), len(used)))
    out[row, at] = (1 + np.log(n)) * idf[held]
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(length > 0, length, 1.0), used


def parts(values: pd.Series) -> Iterator[list[np.ndarray]]:
    """Few lists at a time, null as the empty one."""
    for at in range(0, len(values), TEXTS):
        yield [np.empty(0, np.int64) if x is None else x for x in values.iloc[at : at + TEXTS]]


def product(texts: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'Aq for the texts' tf-idf matrix A, from lists of columns `c`."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast((idf, q.astype(np.float32)))
    width = q.shape[1]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, matrix = shared.value
        total = np.zeros(matrix.shape)
        for batch in batches:
            for lists in parts(batch["c"]):
                a, used = rows_of(lists, weight)
                total[used] += a.T @ (a @ matrix[used])
        for at in range(0, len(total), BLOCK):
            if total[at : at + BLOCK].any():
                yield pd.DataFrame({"block": [at // BLOCK], "m": [total[at : at + BLOCK].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, m in zip(batch["block"], batch["m"]):
                part = np.frombuffer(m).reshape(-1, width)
                sums[block] = sums[block] + part if block in sums else part
        yield pd.DataFrame({"block": list(sums), "m": [x.tobytes() for x in sums.values()]})

    made = texts.mapInPandas(multiply, "block int, m binary")
    summed = made.repartition("block").mapInPandas(add, "block int, m binary")
    out = np.zeros(q.shape)
    for r in summed.collect():  # at most features x width numbers
        part = np.frombuffer(r["m"]).reshape(-1, width)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] += part
    shared.unpersist()
    return out


def fit(texts: DataFrame, settings: Settings = Settings(), text: str = "text") -> LatentWords:
    """The model of all texts. Their words' columns are written once, and read by each round."""
    s = settings
    ship_package(texts.sparkSession)
    words = stash(texts.select(columns(T.tokens(F.coalesce(F.col(text), F.lit(""))), s.features).alias("c")), "columns")
    n = words.count()
    counts = words.select(F.explode(F.array_distinct("c")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(s.features)
    for r in counts.collect():  # at most features rows
        df[r["feature"]] = r["df"]
    idf = np.where(df > 0, 1 + np.log((1 + n) / (1 + df)), 0.0)
    width = min(s.dimension + s.extra, s.features)
    q = np.random.default_rng(s.seed).standard_normal((s.features, width))
    for _ in range(s.rounds):
        q = np.linalg.qr(product(words, idf, q))[0]
    values, turn = np.linalg.eigh(q.T @ product(words, idf, q))
    drop_stash(words)
    best = np.argsort(-values, kind="stable")[: s.dimension]
    vectors = (q @ turn)[:, best] * (values[best] > 1e-9 * max(values.max(), 1e-300))
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    vectors = np.pad(vectors, ((0, 0), (0, s.dimension - vectors.shape[1])))
    return LatentWords(texts.sparkSession, idf, vectors.astype(np.float32), np.sqrt(np.maximum(values[best], 0)))


class LatentWords:
    """Unit vectors of texts in a space learned from a corpus: texts are near whose words occur with like words."""

    def __init__(self, spark: SparkSession, idf: np.ndarray, vectors: np.ndarray, singular: np.ndarray | None = None) -> None:
        self.spark, self.idf, self.vectors, self.singular = spark, idf, vectors, singular
        self.model = EmbeddingModel("latent-words", vectors.shape[1])
        self._shared = spark.sparkContext.broadcast((idf, vectors))

    def table(self) -> DataFrame:
        """The model as rows (feature, idf, vector)."""
        rows = pd.DataFrame({"feature": np.arange(len(self.idf)), "idf": self.idf, "vector": list(self.vectors.tolist())})
        return self.spark.createDataFrame(rows, SCHEMA)

    @staticmethod
    def of(table: DataFrame) -> LatentWords:
        """The model that a table holds; one row for each feature, of a number that the settings bound."""
        rows = table.toPandas().sort_values("feature")
        return LatentWords(table.sparkSession, rows["idf"].to_numpy(float), np.array(rows["vector"].to_list(), np.float32))

    def embed(self, text: Column) -> Column:
        """A text's vector."""
        shared = self._shared

        @F.pandas_udf("array<float>")
        def embed(values: pd.Series) -> pd.Series:
            weight, vectors = shared.value
            return pd.Series([v for lists in parts(values) for v in placed(lists, weight, vectors)], dtype=object)

        return embed(columns(T.tokens(F.coalesce(text, F.lit(""))), len(self.idf)))

    def embed_all(self, texts: Column) -> Column:
        """The vectors of an array of texts, as `chunking.semantic` takes them."""
        shared = self._shared

        @F.pandas_udf("array<array<float>>")
        def embed(values: pd.Series) -> pd.Series:
            weight, vectors = shared.value
            done = []
            for each in values:
                flat = pd.Series([] if each is None else list(each), dtype=object)
                done.append([v for lists in parts(flat) for v in placed(lists, weight, vectors)])
            return pd.Series(done, dtype=object)

        size = len(self.idf)
        return embed(F.transform(texts, lambda t: columns(T.tokens(F.coalesce(t, F.lit(""))), size)))


def placed(lists: list[np.ndarray], idf: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Unit vectors of lists of columns; zero where no word is known."""
    a, used = rows_of(lists, idf)
    out = a @ vectors[used]
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(length > 1e-12, length, 1.0)).astype(np.float32)
