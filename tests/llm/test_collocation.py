"""Phrases against plain Python: exact however small the sketch is."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import collocation
from lodestone.llm.collocation import Settings

SCHEMA = "lang string, text string"


def plain(rows, settings):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, settings.words + 1):
                for i in range(len(words) - n + 1):
                    key = lang, tuple(words[i : i + n])
                    counts[key] = counts.get(key, 0) + 1
    frequent = {k: c for k, c in counts.items() if c >= settings.least and len(k[1]) > 1}
    by = {}
    for (lang, p), a in frequent.items():
        l, r, score = min(
            ((counts[lang, p[:k]], counts[lang, p[k:]], 1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]])) for k in range(1, len(p))), key=lambda x: x[2]
        )
        inside = any(
            other == lang and len(q) > len(p) and 100 * b >= settings.cover * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (other, q), b in frequent.items()
        )
        if not inside:
            by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    out = []
    for lang, found in by.items():
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[: settings.top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def check(spark, rows, settings=Settings(), schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted(tuple(r) for r in collocation.collocations(df, settings).collect())
    assert got == plain([r[:2] for r in rows], settings)
    return got


def texts(seed, n, vocabulary=40):
    rng = random.Random(seed)
    words = [f"{rng.choice(['a', 'É', 'B', '😀', 'x'])}{i}" for i in range(vocabulary)]
    between = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!?", " ; "]
    return [
        (rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words[: rng.randint(2, vocabulary)]) + rng.choice(between) for _ in range(rng.randint(0, 60))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("settings", [Settings(), Settings(words=4, least=3, top=7, cover=80), Settings(rows=1, least=5, slice_bytes=200)])
def test_random_texts(spark, settings):
    assert check(spark, texts(settings.words, 150), settings)


def test_null_empty_long_and_repeated(spark):
    long = "to be or not to be. " * 3000 + "x" * 100_000
    rows = [("en", None), (None, None), ("en", ""), ("en", " .,\n"), ("en", long), ("fr", "La vie"), ("fr", "la VIE")] + [("fr", "la vie")] * 8
    got = check(spark, rows)
    assert ("fr", 1, "la vie", 10, 10, 10, 20, 1_000_000) in got


def test_empty_table_and_clashing_columns(spark):
    check(spark, [])
    rows = [("en", "good morning", "p", 1)] * 10
    assert len(check(spark, rows, schema=SCHEMA + ", phrase string, n int")) == 1


def test_a_sketch_that_is_too_small_loses_nothing(spark, monkeypatch):
    """Every cell counts many n-grams: all survive, and the second pass sorts them out."""
    monkeypatch.setattr(collocation, "cells", lambda mixed, row, bits: mixed >> np.uint64(61))
    part = collocation.Slice(pa.array(["en"] * 50), pa.array([f"a b c{i}" for i in range(50)]))
    part.count(3)
    sketch = collocation.Sketch(Settings(), 18)
    for grams in part.grams:
        sketch.add(grams)
    for grams in part.grams:
        for row in range(2):
            assert (sketch.counters[row][collocation.cells(grams.hash, row, 18)] >= np.minimum(grams.count, 10)).all()
    assert sketch.counters.max() == 10


def test_a_sketch_drops_what_is_rare(spark):
    rows = [("en", " ".join(f"w{i}x{j}" for j in range(50)) + " in fact") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    settings = Settings()
    sketch, bits = collocation.sketched(df, settings)
    full = sum(int(np.unpackbits(np.frombuffer(r["cells"], np.uint8)).sum()) for r in sketch.where("block >= 0").collect())
    assert bits == 18 and 6 <= full < 400  # of some 30,000 n-grams
    assert sketch.where("block < 0").groupBy("lang").sum("n").first()[1] == 200 * 52
    found, _ = collocation.counts(df, settings)
    assert {r["phrase"]: r["f"] for r in found.collect()} == {"in": 200, "fact": 200, "in fact": 200}


def test_scores_beyond_64_bits(spark):
    big = 10**13 + 7
    found = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "a b", big)], "lang string, phrase string, f long")
    row = collocation.scored(found).first()
    assert row["score"] == 1_000_000 * big * big // (6 * big * big) and (row["l"], row["r"]) == (3 * big, 2 * big)
