"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings come from the labels table: 0 for quality 0, 1 for quality 1 of a text
that is toxic, 2 for quality 1 of a clean one. Words and token shapes, hashed,
share one weight vector over the ordered thresholds. The operator gives the
expected grade and the tail probability P(rating >= select_grade), by which
documents are selected.

Defined results: see ordinal. A document is kept if its tail probability is at
least keep_from; without a model every document is kept. Null ids are scored
like any other; if an id repeats, each row is scored by its own text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import features, ordinal
from lodestone.llm.common import fresh


@dataclass(frozen=True)
class Settings:
    model: ordinal.Settings = ordinal.Settings(features.Kinds(prefixes=(5,), shapes=True), least_z=5.0)
    select_grade: int = 1
    keep_from: float = 0.5


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and rating; an id with several labels takes its worst, a null toxic counts as clean."""
    clean = F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 0, 2).otherwise(1)
    rating = F.when(F.col("quality") == 0, 0).otherwise(clean)
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.min(rating).cast("int").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> ordinal.Model | None:
    """A model of the ratings, or None without two different ones."""
    return ordinal.train(docs, ratings(labels), settings.model)


def _tail(model: ordinal.Model | None, settings: Settings, column: str = "_tails") -> Column:
    at = max(0, sum(g < settings.select_grade for g in model.grades) - 1) if model else 0
    return F.get(column, F.lit(at))


def score(docs: DataFrame, model: ordinal.Model | None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, quality_grade, expected_grade, p_selected and selected of every row."""
    tail = _tail(model, settings)
    return ordinal.predict(docs, model, 1.0).select(
        "doc_id",
        F.col("_grade").alias("quality_grade"),
        F.round("_expected", 9).alias("expected_grade"),
        F.round(tail, 9).alias("p_selected"),
        (tail >= settings.keep_from).alias("selected"),
    )


def selected(docs: DataFrame, model: ordinal.Model | None, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, with all their columns, that are selected."""
    found = ordinal.predict(docs, model, 1.0, tuple(docs.columns))
    tail = _tail(model, settings, fresh("_tails", docs.columns))
    return found.where(tail >= settings.keep_from).select(*docs.columns)
