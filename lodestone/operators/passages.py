"""Which texts hold which passages: an exact substring search of many passages in all texts, in one pass over the texts.

A task goes over the bytes of its texts once, whatever the number of passages. The eight bytes (or fewer,
if a passage is shorter) at every place are looked up among the passages' first bytes; where they are found, a hash
of each length that such passages have is looked up among the hashes of whole passages, and what is found is
compared byte by byte, once for each text and passage. No text moves, and no pair is made that is no match,
however common a passage's words are.

Defined results: null passages and null texts match nothing; an empty passage is in every text. Letters match
as they are. A repeated row gives its matches again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieval import small
from lodestone.session import shared_path, ship_package, stash

#: Distinct passages that a task holds at a time; more are searched group by group.
GROUP = 100_000
#: Bytes of text looked at at a time: some 60 bytes of arrays for each.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX, _BITS = np.uint64(_BASE), 20


class Finder:
    """Passages (not empty), by their first bytes and by their length."""

    def __init__(self, passages: list[bytes]) -> None:
        self.passages = passages
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # first bytes, hashes, the passages by hash
        self.heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # sorted first bytes, and where their hashes fall
        by: dict[int, list[int]] = {}
        for i, p in enumerate(passages):
            by.setdefault(len(p), []).append(i)
        heads: dict[int, list[np.ndarray]] = {}
        for n, which in sorted(by.items()):
            x = np.frombuffer(b"".join(passages[i] for i in which), np.uint8)
            start = np.arange(len(which)) * n
            first = windows(x, min(n, 8))[start]
            hashes = Rolling(x).of(start, start + n)
            order = np.argsort(hashes, kind="stable")
            self.lengths[n] = np.unique(first), hashes[order], np.array(which)[order]
            heads.setdefault(min(n, 8), []).append(self.lengths[n][0])
        for width, found in heads.items():
            keys = np.unique(np.concatenate(found))
            table = np.zeros(1 << _BITS, bool)
            table[places(keys)] = True
            self.heads[width] = keys, table

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of a text and of a passage in it, once each."""
        x = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        found, rolling = [], None
        for width, (keys, table) in self.heads.items():
            w = windows(x, width)
            at = np.flatnonzero(table[places(w)])
            at = at[member(keys, w[at])]
            key, text = w[at], np.searchsorted(ends, at, "right")
            for n, (first, hashes, which) in self.lengths.items():
                if min(n, 8) != width:
                    continue
                some = np.flatnonzero(at + n <= ends[text])
                some = some[member(first, key[some])]
                if not len(some):
                    continue
                rolling = rolling or Rolling(x)
                h = rolling.of(at[some], at[some] + n)
                lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
                for step in range(int((hi - lo).max(initial=0))):  # more than one only where hashes of different passages are equal
                    hit = np.flatnonzero(lo + step < hi)
                    found.append((text[some[hit]], which[lo[hit] + step], at[some[hit]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, passage, at = (np.concatenate(c) for c in zip(*found))
        pair = text * len(self.passages) + passage
        order = np.argsort(pair, kind="stable")
        text, passage, at, pair = text[order], passage[order], at[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        sure = np.array([texts[t].startswith(self.passages[p], a - starts[t]) for t, p, a in zip(text[new], passage[new], at[new])], bool)
        for i in np.flatnonzero(~sure):  # an equal hash of other bytes: the passage may still be elsewhere
            sure[i] = self.passages[passage[new[i]]] in texts[text[new[i]]]
        return text[new[sure]], passage[new[sure]]


class Rolling:
    """Hashes of any parts of some bytes: differences of running sums of byte * BASE**place, moved to place 0."""

    def __init__(self, x: np.ndarray) -> None:
        up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(x), b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes of text (column 1), or of one row."""
    for batch in batches:
        upto, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def windows(x: np.ndarray, width: int) -> np.ndarray:
    """The bytes from each place on, at most eight, as one number; zeros follow the end."""
    w = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w[:-step] |= w[step:] << np.uint64(8 * step)
    return w[: len(x)] & np.uint64((1 << 8 * width) - 1)


def places(keys: np.ndarray) -> np.ndarray:
    return (keys * _MIX) >> np.uint64(64 - _BITS)


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys are among sorted values, of which there are some."""
    return values[np.minimum(np.searchsorted(values, keys), len(values) - 1)] == keys


def holders(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id and doc_id for every row of asked (query_id, passage) and every row of texts (doc_id, text) that holds the passage."""
    spark = texts.sparkSession
    ship_package(spark)
    asked = stash(asked.where(F.col("passage").isNotNull()).select("query_id", "passage"), "asked-passages")
    distinct = asked.select("passage").distinct()
    groups = max(1, -(-distinct.count() // GROUP))
    folder = shared_path(spark, "passages")
    numbered = distinct.withColumn("p", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("passage"), F.lit(groups)).cast("int"))
    numbered.write.partitionBy("part").parquet(folder)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def found(group: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.dataset as ds
            from pyarrow.fs import FileSelector, FileSystem

            fs, base = FileSystem.from_uri(f"{folder}/part={group}")
            files = sorted(f.path for f in fs.get_file_info(FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet"))
            if not files:
                return
            held = ds.dataset(files, filesystem=fs, format="parquet").to_table(columns=["passage", "p"])
            passages, numbers = [p.encode("utf-8", "surrogatepass") for p in held.column(0).to_pylist()], held.column(1).to_numpy()
            empty = numbers[[not p for p in passages]]
            some = np.array([bool(p) for p in passages], bool)
            finder, numbers = Finder([p for p in passages if p]), numbers[some]
            for batch in parts(batches, BLOCK):
                there = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
                texts = batch.column(1).take(pa.array(there)).cast(pa.large_binary()).to_pylist()
                text, passage = finder.find(texts)
                row, number = there[text], numbers[passage]
                for p in empty:
                    row, number = np.concatenate([row, there]), np.concatenate([number, np.full(len(there), p)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(number, pa.int64())], ["doc_id", "p"])

        return rows

    told = None
    for group in range(groups):
        part = texts.select("doc_id", "text").mapInArrow(found(group), f"doc_id {kind}, p long")
        told = part if told is None else told.unionByName(part)
    names = asked.join(spark.read.parquet(folder).select("passage", "p"), "passage").select("query_id", "p")
    return told.join(small(names), "p").select("query_id", "doc_id")
