"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. One binary classifier over hashed
byte n-grams predicts each bit. A text's language is the codeword with the
least weighted logistic loss against the predicted bits; a small lead over the
runner-up flags the text as ambiguous.

Defined results: a null text, or one without a letter, is `und` with score 0
and not ambiguous. Equal texts get equal rows. With one learned language every
text with a letter gets it with score 1; with none every text is `und`. A null
id is predicted like any other and is not held out. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_column, ship_package

_MAYBE_LETTER = re.compile(r"[^\W\d_]")
#: Everything but lower-case ASCII letters and bytes of longer characters counts as a gap between words.
_GAPS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PIECE = 1 << 20
SCHEMA = "lang_pred string, score double, margin double, ambiguous boolean"


def has_letter(text: str) -> bool:
    """Whether a text has a letter; the pattern also finds numerals such as superscripts."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


@dataclass(frozen=True)
class Settings:
    """buckets: hashed features. sample_rows: bound on the labelled rows that are fitted."""

    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    sample_rows: int = 3000
    epochs: int = 25
    ambiguous_below: float = 0.1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits: how well a bit is predicted for a language
    settings: Settings


def codewords(n: int) -> np.ndarray:
    """Codes of n languages: all distinct splits up to 7 languages, else a greedy spread code."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        return np.array([[1 if i in s else -1 for s in splits] for i in range(n)], np.int8)
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    draw = np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), size=(n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        near = min((code[i] != code[j]).sum() for i, j in combinations(range(n), 2)) if n <= 64 else (
            (bits - np.abs(code.astype(int) @ code.T.astype(int)) + bits * np.eye(n)) / 2
        ).min()
        if near > apart:
            best, apart = code, near
    return best


def _hashes(text: str, settings: Settings) -> Iterator[np.ndarray]:
    """Hashed n-grams of a whole text, piece by piece, so that memory stays bounded.

    Runs of gaps are one gap. An n-gram belongs to the piece it starts in, for each order.
    """
    x = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_GAPS) + b" ", np.uint8)
    gap = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    whole = x[keep]
    for at in range(0, len(whole), _PIECE):
        x = whole[at : at + _PIECE + max(settings.orders) - 1].astype(np.uint32)
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(settings.orders) + 1):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)
            if n in settings.orders:
                mixed = h[:_PIECE] * np.uint32(0x9E3779B1)
                yield (mixed ^ (mixed >> np.uint32(15))) % np.uint32(settings.buckets)


def _sparse(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A text as bucket numbers and the square roots of their shares (unit length)."""
    counts: np.ndarray | None = None
    for h in _hashes(text, settings):
        c = np.bincount(h, minlength=settings.buckets)
        counts = c if counts is None else counts + c
    if counts is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), np.sqrt(counts[at] / counts.sum()).astype(np.float32)


def _sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """Labelled rows in equal number for each language, by a hash of id and text: at most about sample_rows.

    Rows that repeat an id with its text count once, so they cannot exceed the bound.
    """
    fit = docs.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    ).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = settings.sample_rows / max(1, len(sizes))
    if not sizes:
        return fit.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return fit.where(draw < F.element_at(share, F.col("lang"))).dropDuplicates(["doc_id", "text", "lang"])


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from text and lang of the rows that are not held out. None if there are none."""

    ship_package(docs.sparkSession)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_sparse(t, settings) if has_letter(t) else None for t in batch["text"]]
            yield pd.DataFrame(
                [(l, r[0], r[1]) for l, r in zip(batch["lang"], rows) if r is not None and len(r[0])],
                columns=["lang", "at", "x"],
            )

    rows = _sample(docs, settings).mapInPandas(features, "lang string, at array<int>, x array<float>").toArrow().to_pandas()
    if rows.empty:
        return None
    languages = tuple(sorted(rows["lang"].unique()))
    codes = codewords(len(languages))
    rows = rows.sort_values("lang", kind="stable").reset_index(drop=True)
    label = rows["lang"].map({l: i for i, l in enumerate(languages)}).to_numpy()
    sizes = rows["at"].map(len).to_numpy()
    at = np.concatenate(rows["at"].to_list()).astype(np.int64)
    x = np.concatenate(rows["x"].to_list()).astype(np.float32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    row = np.repeat(np.arange(len(rows)), sizes)
    even = 1.0 / np.bincount(label)[label]
    even = even / even.sum()
    weights = np.zeros((settings.buckets, codes.shape[1]), np.float32)
    bias = np.zeros(codes.shape[1], np.float32)
    trust = np.ones(codes.shape)
    for bit in range(codes.shape[1]):
        y = codes[label, bit].astype(np.float32)
        w, b = np.zeros(settings.buckets), 0.0
        seen, seen_b = np.full(settings.buckets, 1e-6), 1e-6
        for _ in range(settings.epochs):
            f = np.add.reduceat(x * w[at], starts) + b
            pull = even * -y / (1 + np.exp(np.clip(y * f, -30, 30)))
            g = np.bincount(at, x * pull[row], minlength=settings.buckets) + 1e-7 * w
            seen += g * g
            w -= 2.0 * g / np.sqrt(seen)
            gb = pull.sum()
            seen_b += gb * gb
            b -= 0.5 * gb / np.sqrt(seen_b)
        weights[:, bit], bias[bit] = w, b
        right = (np.add.reduceat(x * w[at], starts) + b) * y > 0
        trust[:, bit] = (np.bincount(label, right) + 1) / (np.bincount(label) + 2)
    trust /= trust.sum(1, keepdims=True)
    return Model(languages, codes, weights, bias, trust, settings)


def decode(model: Model, bits: np.ndarray) -> tuple[str, float, float, bool]:
    """Nearest codeword by weighted logistic loss: language, score, lead, ambiguous."""
    loss = (model.trust * np.logaddexp(0, -model.codes * bits)).sum(1)
    near = np.exp(-(loss - loss.min()) * model.codes.shape[1])
    near /= near.sum()
    first = int(loss.argmin())
    lead = float(near[first] - np.delete(near, first).max()) if len(near) > 1 else 1.0
    return model.languages[first], float(near[first]), lead, lead < model.settings.ambiguous_below


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, margin and ambiguous for every row of docs."""

    def start():
        def work(texts: list[str | None]) -> list[list]:
            out = []
            for text in texts:
                if model is None or text is None or not has_letter(text):
                    out.append(("und", 0.0, 0.0, False))
                    continue
                n, counts = 0, np.zeros(model.settings.buckets, np.int64)
                for h in _hashes(text, model.settings):
                    n += len(h)
                    counts += np.bincount(h, minlength=model.settings.buckets)
                at = np.flatnonzero(counts)
                bits = np.sqrt(counts[at] / max(n, 1)).astype(np.float32) @ model.weights[at] + model.bias
                out.append(decode(model, bits))
            return [list(c) for c in zip(*out)] or [[]] * 4

        return work

    return map_column(docs, "text", ["doc_id"], SCHEMA, start)
