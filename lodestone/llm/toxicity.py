"""Toxicity: severity grades by cumulative-link ordinal regression.

labels.toxic says only whether a text is toxic. A first regression is fitted to
that. The severity grades come from it: 0 where toxic is 0; toxic texts get 1, 2
or 3 by their score in it, cut into thirds over all labelled toxic texts. Feature
values are rates among a text's words, so a score tells how strong and how dense
what marks a text is, not how long the text is. The ordinal regression on these
grades starts from the first one and shares one weight vector over all thresholds.

Defined results: see ordinal. A text is rejected if P(severity > 0) is at
least reject_from; grades weigh in the fit by the root of how often they occur,
so that probability is above the plain one. Documents with null ids are scored
like any other; if an id repeats, each row is scored by its own text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import ordinal
from lodestone.llm.common import drop_stash, fresh

_BINS, _STEP, _LEAST = 1024, 0.125, -32.0


@dataclass(frozen=True)
class Settings:
    """steps: of the ordinal fit, which starts from the fit on plain labels."""

    model: ordinal.Settings = ordinal.Settings()
    steps: int = 6
    reject_from: float = 0.4


def marks(labels: DataFrame) -> DataFrame:
    """doc_id and the plain 0/1 label; an id with several labels takes the largest."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("grade"))


def strength(rows: ordinal.Rows, weights: np.ndarray) -> np.ndarray:
    """The rows' scores as numbers of bins."""
    return np.clip(np.floor((rows.scores(weights) - _LEAST) / _STEP), 0, _BINS - 1).astype(int)


def cuts(histogram: np.ndarray) -> tuple[int, int]:
    """The bins from which grades 2 and 3 start: thirds of the rows, as near as bins allow."""
    below = np.concatenate([[0], np.cumsum(histogram)])
    second, third = (int(np.searchsorted(below, share * below[-1])) for share in (1 / 3, 2 / 3))
    return second, max(third, second)


def regraded(weights: np.ndarray, second: int, third: int) -> Callable[[ordinal.Rows], ordinal.Rows]:
    """Severity grades in place of plain labels."""

    def regrade(rows: ordinal.Rows) -> ordinal.Rows:
        at = strength(rows, weights)
        return replace(rows, grade=np.where(rows.grade == 0, 0, 1 + (at >= second) + (at >= third)))

    return regrade


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> ordinal.Model | None:
    """A model of severity, or None without both toxic and clean labelled documents."""
    found = ordinal.prepare(docs, marks(labels), settings.model)
    if found is None:
        return None
    plain = ordinal.fit(found, settings.model)
    toxic = ordinal.summed(
        found.blocks, lambda rows: np.bincount(strength(rows, plain.weights)[rows.grade > 0], minlength=_BINS).astype(float)
    )
    second, third = cuts(toxic)
    parts = (0, second, third, _BINS)
    sizes = {0: int(found.counts.sizes[0])} | {g: int(toxic[parts[g - 1] : parts[g]].sum()) for g in (1, 2, 3)}
    there = [g for g in (1, 2, 3) if sizes[g]]
    each = ordinal.weight_of_rows(found.counts.sizes.astype(float))
    first = ordinal.Start(
        plain.weights,
        np.maximum.accumulate([plain.thresholds[0], *(_LEAST + _STEP * parts[g - 1] for g in there[1:])]),
        each[[0, *(1 for _ in there)]],
    )
    again = replace(settings.model, steps=settings.steps)
    model = ordinal.fit(found, again, regraded(plain.weights, second, third), sizes, first)
    drop_stash(found.blocks)
    return model


def score(docs: DataFrame, model: ordinal.Model | None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, severity, expected_severity, p_toxic and rejected of every row."""
    p_toxic = F.round(F.get("_tails", F.lit(0)), 9)
    return ordinal.predict(docs, model, 0.0).select(
        "doc_id",
        F.col("_grade").alias("severity"),
        F.round("_expected", 9).alias("expected_severity"),
        p_toxic.alias("p_toxic"),
        (p_toxic >= settings.reject_from).alias("rejected"),
    )


def accepted(docs: DataFrame, model: ordinal.Model | None, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected."""
    tails = fresh("_tails", docs.columns)
    found = ordinal.predict(docs, model, 0.0, tuple(docs.columns))
    return found.where(F.get(tails, F.lit(0)) < settings.reject_from).select(*docs.columns)
