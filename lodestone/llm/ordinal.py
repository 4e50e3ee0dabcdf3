"""Cumulative-link ordinal regression on hashed text features.

One weight vector w is shared by all ordered thresholds t_1 < t_2 < ...:
P(grade > j) = sigmoid(w.x - t_j). Toxicity severity and quality grades are two
uses of this model; they differ in the grades and in the features.

Every labelled row takes part, wherever it lies. Features (`features`) have the
value log(1 + rate), the rate being that among PER of the text's words, so
that values do not grow with a text's length. They are counted by grade over all
labelled rows; kept are those
whose presence differs between the grades by more than chance. The counts of
the kept features of all labelled rows are written as compressed blocks, and
the likelihood is maximised by quasi-Newton steps whose gradients are summed
over these blocks in the executors. What the driver holds is one number for
each bucket at most, whatever the number of rows.

Defined results: a null or empty text has no features and gets the grade the
thresholds alone give. Without labels, or with one grade only, there is no
model: every row gets the lowest probability, 0, of being above any threshold
in the severity operator and 1 in the quality operator, so nothing is removed.
A repeated id takes part with each of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import features
from lodestone.llm.common import drop_stash, fresh, map_column, ship_package, slices, stash


@dataclass(frozen=True)
class Settings:
    """least_z: two-proportion z from which a feature is kept, for full_rows labelled rows or more; see `least`.

    least_rows: rows of the rarer grades that have a kept feature.

    spread: standard deviation of a weight in the prior; steps: of the quasi-Newton method at most, which ends
    earlier where the gradient has shrunk to tolerance of the first.
    broadcast_rows: labels up to this number are broadcast (16 bytes each), more are joined by a shuffle.
    """

    features: features.Kinds = features.Kinds()
    least_rows: int = 2
    least_z: float = 4.0
    full_rows: int = 10_000
    spread: float = 1.0
    steps: int = 14
    tolerance: float = 1e-2
    broadcast_rows: int = 1_000_000


@dataclass(frozen=True)
class Model:
    grades: tuple[int, ...]
    buckets: np.ndarray  # kept buckets, sorted
    weights: np.ndarray
    thresholds: np.ndarray
    settings: Settings


@dataclass(frozen=True)
class Counts:
    """Rows of each grade, and for some buckets in how many rows of each grade they occur."""

    grades: tuple[int, ...]
    sizes: np.ndarray  # grades
    buckets: np.ndarray
    rows: np.ndarray  # buckets x grades


@dataclass(frozen=True)
class Labelled:
    """Labelled rows by their kept features: `blocks` lie in the shared folder."""

    counts: Counts
    blocks: DataFrame


PER = 256
BLOCKS = "grade binary, words binary, size binary, at binary, n binary"


@dataclass(frozen=True)
class Rows:
    """Some labelled rows in memory: row i has `size[i]` features, columns `at` and counts `n`."""

    grade: np.ndarray
    words: np.ndarray
    size: np.ndarray
    at: np.ndarray
    n: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    @property
    def x(self) -> np.ndarray:
        """Feature values: counts as rates, for few words as if there were some more."""
        return np.log1p(self.n * np.repeat(PER / (self.words + PER / 4), self.size))

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.x * w[self.at], minlength=len(self.size))

    def packed(self) -> list[bytes]:
        kinds = (np.int32, np.int64, np.int32, np.int32, np.int32)
        return [np.ascontiguousarray(x, k).tobytes() for x, k in zip((self.grade, self.words, self.size, self.at, self.n), kinds)]

    @staticmethod
    def of(batch: pa.RecordBatch, i: int) -> Rows:
        kinds = (np.int32, np.int64, np.int32, np.int32, np.int32)
        return Rows(*[np.frombuffer(batch.column(j)[i].as_buffer(), k) for j, k in enumerate(kinds)])


def rows_of(texts: list[str | None], grade: np.ndarray, kept: np.ndarray, settings: Settings) -> Iterator[Rows]:
    """Labelled texts as blocks of rows; kept: sorted buckets."""
    wanted = np.zeros(settings.features.buckets, bool)
    wanted[kept] = True
    for b in features.blocks(texts, settings.features, wanted):
        size = np.bincount(b.doc - b.first, minlength=len(b.words))
        yield Rows(grade[b.first : b.first + len(b.words)], b.words, size, np.searchsorted(kept, b.at), b.n)


def _present(rows: DataFrame, settings: Settings, kept: np.ndarray | None) -> DataFrame:
    """grade, bucket and n: in how many rows of each grade each bucket occurs; bucket -1 counts the rows."""
    buckets = settings.features.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None
        if kept is not None:
            wanted = np.zeros(buckets, bool)
            wanted[kept] = True
        found: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            grade = batch.column(1).to_numpy()
            for b in features.blocks(batch.column(0).to_pylist(), settings.features, wanted):
                own = grade[b.first : b.first + len(b.words)]
                for g in np.unique(own):
                    c = found.setdefault(int(g), np.zeros(buckets + 1, np.int32))
                    at, n = np.unique(b.at[own[b.doc - b.first] == g], return_counts=True)
                    c[at] += n.astype(np.int32)
                    c[-1] += int((own == g).sum())
        for g, c in found.items():
            for i in range(0, len(c), 1 << 16):
                at = i + np.flatnonzero(c[i : i + (1 << 16)])
                bucket = np.where(at == buckets, -1, at).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), g, np.int32)), pa.array(bucket), pa.array(c[at].astype(np.int64))], ["grade", "bucket", "n"]
                )

    return rows.select("text", "grade").mapInArrow(count, "grade int, bucket int, n long")


def _summed(present: DataFrame, grades: list[int], least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of each of the grades, buckets that occur in `least` of them, and their counts by grade."""
    by = present.groupBy("bucket").agg(*[F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in grades])
    total = sum((F.col(f"n{g}") for g in grades), F.lit(0))
    found = by.where((F.col("bucket") < 0) | (total >= least)).toArrow()
    bucket = found.column("bucket").to_numpy()
    n = np.stack([found.column(f"n{g}").to_numpy() for g in grades], 1).astype(np.int64).reshape(len(bucket), len(grades))
    order = np.argsort(bucket, kind="stable")
    bucket, n = bucket[order], n[order]
    rows = n[0] if len(bucket) and bucket[0] < 0 else np.zeros(len(grades), np.int64)
    inside = bucket >= 0
    return rows, bucket[inside], n[inside]


def least(rows: int, settings: Settings) -> float:
    """The z from which a feature is kept, of so many labelled rows.

    z of an equally telling feature grows with the root of the rows, what chance
    can bring more slowly: the cut goes with the sixth root, up to full_rows.
    """
    return settings.least_z * min(1.0, rows / settings.full_rows) ** (1 / 6)


def select(counts: Counts, settings: Settings) -> Counts:
    """The buckets whose presence above and below some threshold differs enough."""
    sizes, rows = counts.sizes.astype(float), counts.rows.astype(float)
    total, n = rows.sum(1), sizes.sum()
    p = total / n
    kept = np.zeros(len(counts.buckets), bool)
    for j in range(1, len(counts.grades)):
        n1 = sizes[j:].sum()
        n0 = n - n1
        up = rows[:, j:].sum(1)
        z = (up / n1 - (total - up) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        kept |= np.abs(z) >= least(n, settings)
    kept &= total >= settings.least_rows
    return Counts(counts.grades, counts.sizes, counts.buckets[kept], counts.rows[kept])


def prepare(docs: DataFrame, marks: DataFrame, settings: Settings) -> Labelled | None:
    """Count and choose features over all labelled rows, and write the rows' kept features.

    marks: doc_id and grade, an id once. None without two grades.
    """
    ship_package(docs.sparkSession)
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).select("doc_id", F.col("grade").cast("int").alias("grade"))
    sizes = {r["grade"]: r["n"] for r in marks.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    texts = docs.select("doc_id", "text")
    small = sum(sizes.values()) <= settings.broadcast_rows
    rows = texts.join(F.broadcast(marks), "doc_id") if small else stash(texts.join(marks, "doc_id"), "labelled")
    common = max(sizes, key=lambda g: (sizes[g], -g))
    rare = sorted(set(sizes) - {common})
    least = settings.least_rows
    rare_n, buckets, rare_rows = _summed(_present(rows.where(F.col("grade") != common), settings, None), rare, least)
    common_n, found, common_rows = _summed(_present(rows.where(F.col("grade") == common), settings, buckets), [common])
    grades = tuple(sorted(sizes))
    table = np.zeros((len(buckets), len(grades)), np.int64)
    place = {g: i for i, g in enumerate(grades)}
    table[:, [place[g] for g in rare]] = rare_rows
    table[np.searchsorted(buckets, found), place[common]] = common_rows[:, 0]
    n = np.zeros(len(grades), np.int64)
    n[[place[g] for g in rare]], n[place[common]] = rare_n, common_n[0]
    there = np.flatnonzero(n)
    if len(there) < 2:
        return None
    counts = select(Counts(tuple(grades[i] for i in there), n[there], buckets, table[:, there]), settings)
    kept = counts.buckets

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for block in rows_of(batch.column(0).to_pylist(), batch.column(1).to_numpy(), kept, settings):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block.packed()], [c.split()[0] for c in BLOCKS.split(", ")])

    return Labelled(counts, stash(rows.select("text", "grade").mapInArrow(compress, BLOCKS), "labelled-features"))


def summed(blocks: DataFrame, of: Callable[[Rows], np.ndarray], parts: int = 8) -> np.ndarray | None:
    """The sum of a vector over all blocks: within tasks, then in a few tasks, then in the driver."""

    def add(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                made = make(batch, i)
                total = made.copy() if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    schema = "v binary"
    first = blocks.mapInArrow(lambda it: add(it, lambda b, i: of(Rows.of(b, i))), schema)
    again = lambda it: add(it, lambda b, i: np.frombuffer(b.column(0)[i].as_buffer()))
    found = first.repartition(parts).mapInArrow(again, schema).collect()
    return sum((np.frombuffer(r["v"]) for r in sorted(found, key=lambda r: bytes(r["v"]))), start=0.0) if found else None


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the steps."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def likelihood(rows: Rows, w: np.ndarray, t: np.ndarray, share: np.ndarray, curved: bool = False) -> np.ndarray:
    """Weighted negative log-likelihood of rows, its gradient by t and w, and if curved the curvature by w, as one vector.

    rows.grade: places in the order of grades. share: the weight of a row of each grade.
    """
    y, row, x = rows.grade, rows.row, rows.x
    score = np.bincount(row, x * w[rows.at], minlength=len(y))
    up = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -35, 35)))  # P(grade > j)
    bounds = np.concatenate([np.ones((len(y), 1)), up, np.zeros((len(y), 1))], 1)
    slope = bounds * (1 - bounds)
    i, even = np.arange(len(y)), share[y]
    p = np.maximum(bounds[i, y] - bounds[i, y + 1], 1e-12)
    by_score = -even * (slope[i, y] - slope[i, y + 1]) / p
    by_t = np.bincount(y, even * slope[i, y] / p, len(t) + 2) - np.bincount(y + 1, even * slope[i, y + 1] / p, len(t) + 2)
    made = [[-(even * np.log(p)).sum()], by_t[1:-1], np.bincount(rows.at, x * by_score[row], minlength=len(w))]
    if curved:
        curve = even * (slope[i, y] + slope[i, y + 1])
        made.append(np.bincount(rows.at, x * x * curve[row], minlength=len(w)))
    return np.concatenate(made)


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, tolerance: float, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent; value gives a function's value and gradient."""
    x, pairs = start, []
    f, g = value(x)
    first = np.linalg.norm(g)
    for _ in range(steps):
        d, kept = -g, []
        for s, y, r in reversed(pairs):
            a = r * (s @ d)
            d = d - a * y
            kept.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(pairs, reversed(kept)):
            d = d + (a - r * (y @ d)) * s
        slope, size = float(g @ d), 1.0
        for _ in range(12):
            f_new, g_new = value(x + size * d)
            if f_new <= f + 1e-4 * size * slope:
                break
            size *= 0.4
        else:
            break
        s, y = size * d, g_new - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        x, f, g = x + s, f_new, g_new
        if np.linalg.norm(g) <= tolerance * first:
            break
    return x


Total = Callable[[Callable[[Rows], np.ndarray]], np.ndarray]


def weight_of_rows(sizes: np.ndarray) -> np.ndarray:
    """What a row of each grade weighs: grades weigh between equally and as often as they occur."""
    each = (sizes / sizes.sum()) ** 0.5 / sizes
    return each / (each * sizes).sum()


@dataclass(frozen=True)
class Start:
    """Where a fit starts, and what a row of each grade weighs in it."""

    weights: np.ndarray
    thresholds: np.ndarray
    each: np.ndarray


def fit_counts(total: Total, buckets: np.ndarray, grades: tuple[int, ...], sizes: np.ndarray, settings: Settings, first: Start | None = None) -> Model:
    """Fit, given how a vector is summed over all labelled rows; sizes: rows of each grade."""
    n = sizes.sum()
    each = weight_of_rows(sizes) if first is None else first.each
    below = np.cumsum(each * sizes)[:-1]
    t = np.log(below / (1 - below)) if first is None else first.thresholds
    raw = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    k, m = len(raw), len(buckets)
    prior = 1 / (settings.spread**2 * n)
    begin = np.zeros(m) if first is None else first.weights
    start = total(lambda rows: likelihood(rows, begin, t, each, curved=True))
    scale = np.concatenate([np.full(k, 2.0), 1 / np.sqrt(start[1 + k + m :] + prior)])

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        raw, w = theta[:k] * scale[:k], theta[k:] * scale[k:]
        t = thresholds(raw)
        made = total(lambda rows: likelihood(rows, w, t, each))
        tail = np.cumsum(made[1 : 1 + k][::-1])[::-1]
        by_raw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
        by_w = made[1 + k : 1 + k + m] + prior * w
        return float(made[0] + prior / 2 * (w @ w)), np.concatenate([by_raw, by_w]) * scale

    found = minimise(value, np.concatenate([raw, begin]) / scale, settings.steps, settings.tolerance) * scale
    return Model(grades, buckets, found[k:], thresholds(found[:k]), settings)


def fit(
    found: Labelled | None,
    settings: Settings,
    regrade: Callable[[Rows], Rows] | None = None,
    sizes: dict[int, int] | None = None,
    first: Start | None = None,
) -> Model | None:
    """Fit on all labelled rows. regrade: other grades for the rows, of which sizes tells how many there are."""
    if found is None:
        return None
    sizes = sizes or dict(zip(found.counts.grades, found.counts.sizes.tolist()))
    grades = tuple(sorted(g for g, n in sizes.items() if n))
    if len(grades) < 2:
        return None
    order = np.array(grades)

    def placed(rows: Rows) -> Rows:
        rows = regrade(rows) if regrade else rows
        return Rows(np.searchsorted(order, rows.grade), rows.words, rows.size, rows.at, rows.n)

    total = lambda of: summed(found.blocks, lambda rows: of(placed(rows)))
    return fit_counts(total, found.counts.buckets, grades, np.array([sizes[g] for g in grades], float), settings, first)


def train(docs: DataFrame, marks: DataFrame, settings: Settings) -> Model | None:
    """Prepare, fit and delete what was written between."""
    found = prepare(docs, marks, settings)
    model = fit(found, settings)
    if found:
        drop_stash(found.blocks)
    return model


def tails(model: Model, texts: list[str | None]) -> np.ndarray:
    """P(grade > j) of each text and for each threshold j."""
    score = np.zeros(len(texts))
    for rows, first in _scored(model, texts):
        score[first : first + len(rows.size)] = rows.scores(model.weights)
    return 1 / (1 + np.exp(-np.clip(score[:, None] - model.thresholds[None, :], -35, 35)))


def _scored(model: Model, texts: list[str | None]) -> Iterator[tuple[Rows, int]]:
    first = 0
    for rows in rows_of(texts, np.zeros(len(texts), np.int32), model.buckets, model.settings):
        yield rows, first
        first += len(rows.size)


def predict(docs: DataFrame, model: Model | None, empty: float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with _grade (most probable), _expected (mean grade) and _tails (P above each threshold).

    empty: what every tail is without a model.
    """

    def start():
        def work(texts: list[str | None]) -> list[list]:
            if model is None:
                return [[int(empty)] * len(texts), [float(empty)] * len(texts), [[float(empty)]] * len(texts)]
            up = tails(model, texts)
            ends = np.ones((len(texts), 1))
            p = -np.diff(np.concatenate([ends, up, 0 * ends], 1), axis=1)
            grades = np.array(model.grades)
            return [grades[p.argmax(1)].tolist() if len(p) else [], (p @ grades).tolist(), up.tolist()]

        return work

    names = [fresh(n, keep) for n in RESULTS]
    made = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("int", "double", "array<double>")))
    return map_column(docs, "text", keep, made, start)


RESULTS = ("_grade", "_expected", "_tails")
