"""Phrases of words that occur together, by count-min sketches and an exact second pass.

The first pass counts all n-grams of all texts in a count-min sketch for each
task. A counter stops at `least`, so a cell is a byte; cells of all tasks are
added up by block, and what remains of a merged sketch is one bit for each cell:
whether `least` was reached. A sketch never counts too little, so an n-gram with
a cell below `least` is rare. The second pass reads the texts again, counts
exactly the n-grams all of whose cells, and whose parts' cells, are full, and
drops those that are rare after all. The result is exact whatever the sketch's size.

A sketch has 2^bits cells in each of its rows, a cell for every 16 bytes of text,
at most 2^max_bits: its memory in a task, and the merged bits that each executor
gets. On texts beyond that the sketch fills up and the second pass counts more
n-grams, nothing else changes.

Then a phrase's score is the least over its cuts of least(part counts), and a
phrase inside a longer one that occurs at least cover % as often is left out.

Texts are cut at bytes, and all n-grams of a slice of texts are counted at once
as pairs of numbers. Equal n-grams of some slices travel as one row; Spark sums them
before and after its shuffle. No list of a language's phrases is ever in one task
but for the `top` best ones of each task.

Defined results: a null text is empty; a null language is `und`, as is the
language `und`. Case is folded for A-Z alone. Repeated rows count as often as
they occur. Words and texts of any length are read whole. A table without phrases
gives an empty result. Ties go by a, then by the phrase's bytes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ship_package, stash

NO_LANG = "und"
#: What a byte is: part of a word, between words, between pieces.
WORD, SPACE, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Multipliers of the hashes: odd 64-bit numbers.
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
ROWS = [np.uint64(x) for x in (0xF1357AEA2E62A9C5, 0x8C2F9D5B3A7E6141, 0xB5297A4D3F84D5B5, 0xA24BAED4963EE407)]
#: Rows that a task sums before it passes them on.
PENDING = 400_000
#: Cells of a block in which sketches travel.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Settings:
    """words: of the longest phrase; least: a phrase's occurrences; cover: per cent of a phrase's occurrences, from which a longer one replaces it.

    top: rows for each language. rows, max_bits: of the sketch. slice_bytes: of
    the texts whose n-grams a task holds at a time; one text is never cut.
    """

    words: int = 3
    least: int = 10
    cover: int = 50
    top: int = 2000
    rows: int = 2
    max_bits: int = 25
    slice_bytes: int = 2 << 20

    def __post_init__(self) -> None:
        if not 1 <= self.least <= 15 or not 1 <= self.rows <= len(ROWS) or not 18 <= self.max_bits <= 28 or self.words < 2:
            raise ValueError("least is 1 to 15, rows 1 to 4, max_bits 18 to 28, words 2 or more")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: pa.BinaryArray) -> np.ndarray:
    """A 64-bit hash of each string; the same in all tasks."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    data = words.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, BASE, np.uint64))
    sums = np.zeros(len(words), np.uint64)
    some = lengths > 0
    if some.any():
        sums[some] = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[place], (offsets[:-1] - offsets[0])[some])
    return _mixed(sums + lengths.astype(np.uint64) * STEP)


@dataclass
class Grams:
    """The distinct n-grams of one length in a slice: as (n-gram without its last word, last word), their counts and hashes."""

    before: np.ndarray
    last: np.ndarray
    count: np.ndarray
    hash: np.ndarray
    keep: np.ndarray | None = field(default=None)


class Slice:
    """The words of some texts as numbers, and their n-grams."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = KIND[raw]
        first = np.zeros(len(raw), bool)  # bytes that begin a text
        first[offsets[:-1][offsets[:-1] < len(raw)]] = True
        inside = kind == WORD
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:]
        piece = np.cumsum((kind == BREAK) | first, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
        at = np.flatnonzero(starts)
        self.piece = piece[at]
        lengths = np.flatnonzero(ends) + 1 - at
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[raw[inside]])])
        coded = words.dictionary_encode()
        self.dictionary = coded.dictionary.cast(pa.binary())
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spoken = pc.fill_null(langs.cast(pa.string()), NO_LANG).dictionary_encode()
        self.langs = spoken.dictionary
        text_of = np.searchsorted(offsets, at, side="right") - 1
        self.lang = spoken.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text_of]
        self.word_hash, self.lang_hash = hashes(self.dictionary), hashes(self.langs.cast(pa.binary()))
        self.grams: list[Grams] = []

    def totals(self) -> tuple[list[str], list[int]]:
        return self.langs.to_pylist(), np.bincount(self.lang, minlength=len(self.langs)).tolist()

    def count(self, words: int, survive: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        """Find the n-grams of up to so many words; longer ones of n-grams that survive alone, if that is asked."""
        size = max(1, len(self.dictionary))
        code, place, hash_before = self.lang, np.arange(len(self.word)), self.lang_hash  # place: of each n-gram's first word
        for n in range(1, words + 1):
            if n > 1:  # two n-grams one word apart make a longer one
                near = np.flatnonzero((place[1:] == place[:-1] + 1) & (self.piece[place[1:]] == self.piece[place[:-1]]))
                code, place, hash_before = code[near], place[near], self.grams[-1].hash
            last = self.word[place + n - 1]
            code, distinct = pd.factorize(code * size + last)
            count = np.bincount(code, minlength=len(distinct))
            prior, word = np.divmod(distinct, size)
            mixed = _mixed(hash_before[prior] * STEP + self.word_hash[word])
            self.grams.append(Grams(prior, word, count, mixed))
            if survive:
                alive = survive(mixed)
                self.grams[-1].keep = alive
                place, code = place[alive[code]], code[alive[code]]

    def phrases(self, n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Language, phrase and count of the surviving n-grams of n words."""
        grams = self.grams[n - 1]
        at = np.flatnonzero(grams.keep)
        count, parts = grams.count[at], []
        for m in range(n - 1, -1, -1):
            parts.insert(0, self.dictionary.take(pa.array(self.grams[m].last[at])))
            at = self.grams[m].before[at]
        joined = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, b" ")
        return self.langs.take(pa.array(at)), joined.cast(pa.string()), pa.array(count, pa.int64())


def cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Slice]:
    """Slices of (lang, text) batches with at most so many bytes of text, one text at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield Slice(batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at))
            at = to


def cells(mixed: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed * ROWS[row]) >> np.uint64(64 - bits)


class Sketch:
    """Counters that stop at `least`."""

    def __init__(self, settings: Settings, bits: int) -> None:
        self.settings, self.bits = settings, bits
        self.counters = np.zeros((settings.rows, 1 << bits), np.uint8)

    def add(self, grams: Grams) -> None:
        least = self.settings.least
        if not len(grams.hash):
            return
        counts = np.minimum(grams.count, least).astype(np.uint64)
        for row, counters in enumerate(self.counters):
            packed = np.sort((cells(grams.hash, row, self.bits) << np.uint64(4) | counts).astype(np.uint32))
            cell = packed >> 4
            begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            more = np.add.reduceat((packed & 15).astype(np.int64), begins)
            spots = cell[begins]
            counters[spots] = np.minimum(counters[spots] + more, least)


def _sketched(settings: Settings, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, totals = None, {}
        for part in cut(batches, settings.slice_bytes):
            sketch = sketch or Sketch(settings, bits)
            part.count(settings.words)
            for grams in part.grams:
                sketch.add(grams)
            for lang, n in zip(*part.totals()):
                totals[lang] = totals.get(lang, 0) + n
        for lang, n in totals.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int64()), "cells": pa.array([None], pa.binary()), "lang": [lang], "n": pa.array([n], pa.int64())})
        flat = sketch.counters.reshape(-1) if sketch else np.zeros(0, np.uint8)
        for at in range(0, len(flat), BLOCK):
            block = flat[at : at + BLOCK]
            if block.any():
                packed = pa.compress(block.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_pydict({"block": pa.array([at // BLOCK], pa.int64()), "cells": pa.array([packed], pa.binary()), "lang": pa.array([None], pa.string()), "n": pa.array([None], pa.int64())})

    return run


def _merged(settings: Settings) -> Callable:
    """Blocks of all tasks, sorted by number, to one of full cells as bits; totals pass through."""
    def full(block: int, counters: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(counters >= settings.least).tobytes()
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "cells": pa.array([bits], pa.binary()), "lang": pa.array([None], pa.string()), "n": pa.array([None], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counters = None, None
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                if block < 0:
                    yield batch.slice(i, 1)
                    continue
                if block != at:
                    if at is not None:
                        yield full(at, counters)
                    at, counters = block, np.zeros(BLOCK, np.uint8)
                more = np.frombuffer(pa.decompress(batch.column(1)[i].as_py(), BLOCK, "zstd"), np.uint8)
                counters = np.minimum(counters + more, settings.least)  # at most 15 each: no byte overflows
        if at is not None:
            yield full(at, counters)

    return run


def summed(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Equal phrases of several slices as one row."""
    found = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
    for batch in found.select(["lang", "phrase", "f_sum"]).to_batches(100_000):
        yield pa.RecordBatch.from_arrays(batch.columns, ["lang", "phrase", "f"])
    del found, tables
    pa.default_memory_pool().release_unused()  # workers live on


def _survivors(settings: Settings, bits: int, sketch) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = sketch.value

        def survive(mixed: np.ndarray) -> np.ndarray:
            alive = np.ones(len(mixed), bool)
            for row in range(settings.rows):
                cell = cells(mixed, row, bits) + np.uint64(row << bits)
                alive &= (full[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            return alive

        pending, rows = [], 0
        for part in cut(batches, settings.slice_bytes):
            part.count(settings.words, survive)
            for n in range(1, settings.words + 1):
                pending.append(pa.Table.from_arrays([*part.phrases(n)], ["lang", "phrase", "f"]))
                rows += len(pending[-1])
            if rows > PENDING:
                yield from summed(pending)
                pending, rows = [], 0
        if pending:
            yield from summed(pending)

    return run


def sketched(docs: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """The merged sketch (block, cells as bits; block -1: a language and its words in a task) and its bits."""
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(settings.max_bits, max(18, (size >> 4).bit_length()))
    schema = "block long, cells binary, lang string, n long"
    tasks = 2 * spark.sparkContext.defaultParallelism  # a sketch for each, whatever the number of files
    each = docs.coalesce(tasks).mapInArrow(_sketched(settings, bits), schema)
    merged = each.repartition("block").sortWithinPartitions("block").mapInArrow(_merged(settings), schema)
    return stash(merged, "collocation-sketch"), bits


def counts(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all n-grams of 1 to `words` words with f at least `least`, exactly; (lang, n) of all words."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    sketch, bits = sketched(docs, settings)
    full = np.zeros(settings.rows << bits >> 3, np.uint8)  # at most 4 MB a row with the default max_bits
    step = BLOCK >> 3
    found = sketch.where("block >= 0").select("block", "cells").toArrow()
    for block, part in zip(found.column(0).to_pylist(), found.column(1)):
        full[block * step : block * step + len(part.as_py())] = np.frombuffer(part.as_py(), np.uint8)
    run = _survivors(settings, bits, spark.sparkContext.broadcast(full))
    exact = docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    totals = sketch.where("block < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return stash(exact.where(F.col("f") >= settings.least), "collocation-counts"), totals


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r and score of each phrase of two or more words, by its cut with the lowest score."""
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")).where(F.size("words") > 1)
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " "))
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * {wide('a')} * {wide('a')} div ({wide('l')} * {wide('r')})")
    best = F.min_by(F.struct("l", "r", "score", "words"), F.struct("score", "k"))
    cuts = cuts.withColumn("score", score.cast("long"))
    return cuts.groupBy("lang", "phrase", "a").agg(best.alias("best")).select("lang", "phrase", "a", "best.*")


def subsumed(phrases: DataFrame, cover: int) -> DataFrame:
    """lang and phrase of those inside a longer phrase that occurs at least cover % as often."""
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))"
    )
    inside = phrases.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(longest, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("a") * cover).select("lang", "phrase")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, totals = counts(docs, settings)
    phrases = stash(scored(found), "collocation-phrases")
    kept = phrases.join(subsumed(phrases, settings.cover), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.top)
    whole = best.join(totals, "lang")
    return whole.select("lang", *[F.col(c).cast("long").alias(c) if c != "phrase" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")])
