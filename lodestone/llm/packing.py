"""Bulk-synchronous best-fit packing of token sequences.

Pieces longer than half a sequence open one each. The others are taken band by
band of their lengths, long ones first. A superstep of a band sorts its pieces
and all gaps by range. Each piece's successor is the smallest gap that holds it;
where several pieces want one gap the longest wins (ties by a hash, then the id),
the others go on to the next gap. In the sorted order that is the matching of
brackets, a piece opening and a gap closing one: every range is swept where it
lies, and what a range leaves over, counted by range, tells which of its pieces
meet which gaps of later ranges. Gaps are updated. Then pieces without a gap are
dealt out with the gaps that are left; each part fills these best-fit, longest
piece first, and opens sequences for the rest. The next band goes on with the
gaps of both steps.

The driver holds a few numbers for each range of up to range_rows rows. Pieces
carry an id of their own from where they are made, and a sequence is called by
the piece that opened it.

Defined results: a null or empty text is one piece that holds the end id only.
A piece's place among equal ones goes by a hash of its id, so repeated rows are
packed like any others. An empty table packs into nothing. Extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import FORGET, cut, ship_package, stash

#: Texts of these characters only are split here; any other goes to the tokenizer as a whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧]*")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_LONG = 48


@dataclass(frozen=True)
class Settings:
    tokenizer: str
    capacity: int = 4096
    end_id: int = 1
    cached_words: int = 600_000
    range_rows: int = 100_000


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit numbers.

    The tokenizer's words never lie over white space, so the ids of
    blank-separated strings are kept, in two generations of bounded size; a
    text with characters or marks that need more care is encoded by the
    tokenizer at once. Results are the tokenizer's own.
    """

    def __init__(self, path: str, cached_words: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bound, self.known, self.old = cached_words, {}, {}

    def _each(self, words: list[str]) -> list[bytes]:
        """The ids of each string, encoded together: where one ends is known from the offsets."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        starts = np.array([a for a, _ in found.offsets], np.int64)
        cut = [0, *(4 * np.searchsorted(starts, ends)).tolist()]
        return [ids[i:j] for i, j in zip(cut, cut[1:])]

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if not _PLAIN.fullmatch(text) or _SPECIAL.search(text):
            found = self.tokenizer.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False)
            return np.array(found.ids, "<u4").tobytes()
        words = text.lower().split()
        known, once = self.known, {}
        if missing := set(words).difference(known):
            new = []
            for w in missing:
                if w in self.old:
                    known[w] = self.old[w]
                else:
                    new.append(w)
            for at in range(0, len(new), 100):  # the tokenizer is slower on longer strings
                part = new[at : at + 100]
                for w, ids in zip(part, self._each(part)):
                    (known if len(w) <= _LONG else once)[w] = ids
        if once:
            out = b"".join([known[w] if w in known else once[w] for w in words])
        else:
            out = b"".join(map(known.__getitem__, words))
        if len(known) > self.bound:
            self.old, self.known = known, {}
        return out


@lru_cache(maxsize=1)
def encoder(path: str, cached_words: int) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path, cached_words)


FORGET.append(encoder.cache_clear)


def pieces(docs: DataFrame, settings: Settings, keep_ids: bool = False, order: Column | None = None) -> DataFrame:
    """Pieces of at most capacity tokens: id, doc_id, piece, start, length, ids_crc32 and, if wanted, the ids and the documents' order.

    id numbers the pieces of a task; it is not to be relied on before the rows are written.
    """
    ship_package(docs.sparkSession)
    ordered = order is not None
    schema = "id long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", order long" * ordered

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(settings.tokenizer, settings.cached_words).ids
        end, step = int(settings.end_id).to_bytes(4, "little"), 4 * settings.capacity
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * keep_ids, *[pa.int64()] * ordered]
        own = TaskContext.get().partitionId() << 33
        for batch in cut(batches):
            out = []
            for doc_id, text, *place in zip(*[c.to_pylist() for c in batch.columns]):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = (own, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, *[part] * keep_ids, *place))
                    own += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    named = [] if not ordered else [order.cast("long").alias("order")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *named).mapInArrow(rows, schema)


PIECE, GAP, PLACED = 0, 1, 2
STEP = "part int, role int, place long, id long, length long, sequence long, gap long"
_STEP = [c.split()[0] for c in STEP.split(", ")]


def match(kind: Sequence[int]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs (piece, gap) of places in a sorted run of pieces and gaps, and the pieces and gaps that are left.

    Each piece takes the first gap after it that no longer piece has taken.
    """
    pairs, waiting, free = [], [], []
    for at, what in enumerate(kind):
        if what == PIECE:
            waiting.append(at)
        elif waiting:
            pairs.append((waiting.pop(), at))
        else:
            free.append(at)
    return pairs, waiting, free


def meet(left: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """What pieces and gaps left in ranges (range, pieces, gaps) match across ranges.

    Runs of n: pieces of a range from place down, gaps of a later range from place up.
    """
    runs, waiting = [], []
    for part, pieces_left, gaps_left in sorted(left):
        at = 0
        while gaps_left > at and waiting:
            of, n = waiting.pop()
            take = min(n, gaps_left - at)
            runs.append((of, n - 1, part, at, take))
            at += take
            if n > take:
                waiting.append((of, n - take))
        if pieces_left:
            waiting.append((part, pieces_left))
    return runs


class Gaps:
    """Open gaps of sequences by size."""

    def __init__(self) -> None:
        self.by: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, sequence: int, gap: int) -> None:
        if gap <= 0:
            return
        if gap not in self.by:
            self.by[gap] = []
            bisect.insort(self.sizes, gap)
        self.by[gap].append(sequence)

    def take(self, length: int) -> tuple[int, int] | None:
        """A sequence with the smallest gap that holds the length, and that gap."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        sequence = self.by[gap].pop()
        if not self.by[gap]:
            del self.by[gap]
            self.sizes.pop(at)
        return sequence, gap


def bands(capacity: int) -> list[tuple[int, int]]:
    """Lengths above low and up to high: as 2, 3, 4, 6 and 8 of them fit in a sequence, three times by halves, the rest."""
    edges = sorted({capacity // k for k in (2, 3, 4, 6, 8)} | {(capacity // 8) >> i for i in range(4)} | {0})
    return [(low, high) for low, high in zip(edges, edges[1:])][::-1]


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _step(part: int, role: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns |= {"part": np.full(n, part), "role": np.full(n, role)}
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
    arrays = [pa.array(np.asarray(columns[c]), k) if c in columns else pa.nulls(n, k) for c, k in zip(_STEP, kinds)]
    return pa.RecordBatch.from_arrays(arrays, _STEP)


def _items(open_pieces: DataFrame, gaps: DataFrame) -> DataFrame:
    """Pieces (id, length) and gaps (sequence, gap) in one table."""
    one = open_pieces.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), "id")
    return one.unionByName(gaps.select(F.lit(GAP).alias("kind"), F.col("gap").alias("size"), F.col("sequence").alias("id")))


def swept(items: DataFrame, parts: int) -> DataFrame:
    """Sort by range and match within each range."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        part, x = TaskContext.get().partitionId(), _columns(held)
        pairs, waiting, free = match(x["kind"].tolist())
        a, b = (np.array(s, np.int64) for s in (list(zip(*pairs)) or [(), ()]))
        waiting, free = np.array(waiting, np.int64), np.array(free, np.int64)
        yield _step(part, PLACED, id=x["id"][a], length=x["size"][a], sequence=x["id"][b], gap=x["size"][b])
        yield _step(part, PIECE, place=np.arange(len(waiting)), id=x["id"][waiting], length=x["size"][waiting])
        yield _step(part, GAP, place=np.arange(len(free)), sequence=x["id"][free], gap=x["size"][free])

    tied = items.withColumn("tie", F.xxhash64("id"))
    by = ["size", "kind", "tie", "id"]
    return tied.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(rows, STEP)


def numbered(left: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Add `pair` to what ranges have left: the number of the match across ranges, or null. runs: two a range at most."""
    base = np.concatenate([[0], np.cumsum([r[4] for r in runs])]).tolist()
    rows = [(PIECE, of, at - n + 1, at, b + at, -1) for (of, at, _, _, n), b in zip(runs, base)]
    rows += [(GAP, part, at, at + n - 1, b - at, 1) for (_, _, part, at, n), b in zip(runs, base)]
    table = left.sparkSession.createDataFrame(rows, "r int, p int, low long, high long, b long, way long")
    inside = (left["role"] == table["r"]) & (left["part"] == table["p"]) & left["place"].between(table["low"], table["high"])
    return left.join(F.broadcast(table), inside, "left").withColumn("pair", F.col("b") + F.col("way") * F.col("place")).drop(*table.columns)


def filled(items: DataFrame, parts: int, capacity: int) -> DataFrame:
    """Deal pieces and gaps out, fill the gaps best-fit, longest piece first, and open sequences for the rest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, gaps = TaskContext.get().partitionId(), Gaps()
        for batch in batches:
            x = _columns([batch])
            out: list[tuple[int, int, int, int]] = []
            for kind, size, own in zip(x["kind"].tolist(), x["size"].tolist(), x["id"].tolist()):
                if kind == GAP:
                    gaps.add(own, size)
                else:
                    sequence, gap = gaps.take(size) or (own, capacity)
                    gaps.add(sequence, gap - size)
                    out.append((own, size, sequence, gap))
            made = np.array(out, np.int64).reshape(-1, 4).T
            yield _step(part, PLACED, id=made[0], length=made[1], sequence=made[2], gap=made[3])
        for gap in gaps.sizes:
            yield _step(part, GAP, sequence=np.array(gaps.by[gap], np.int64), gap=np.full(len(gaps.by[gap]), gap))

    dealt = items.withColumn("tie", F.xxhash64("id")).repartition(parts, "tie")
    return dealt.sortWithinPartitions(F.desc("kind"), F.desc("size"), "tie", "id").mapInArrow(rows, STEP)


def assign(made: DataFrame, settings: Settings) -> DataFrame:
    """Add sequence_id and offset to written pieces."""
    capacity, half = settings.capacity, settings.capacity // 2
    edges = [low for low, _ in bands(capacity)]
    band = F.lit(len(edges))
    for i, low in reversed(list(enumerate(edges))):
        band = F.when(F.col("length") > low, i).otherwise(band)
    band = F.when(F.col("length") > half, -1).otherwise(band)
    rows = {r["band"]: r["n"] for r in made.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}
    alone = made.where(F.col("length") > half)
    placed = [alone.select("id", F.col("id").alias("sequence"), F.lit(capacity).cast("long").alias("gap"))]
    gaps = alone.where(F.col("length") < capacity).select(F.col("id").alias("sequence"), (F.lit(capacity) - F.col("length")).cast("long").alias("gap"))
    seen = rows.get(-1, 0)
    for i, (low, high) in enumerate(bands(capacity)):
        if not rows.get(i):
            continue
        own = made.where((F.col("length") > low) & (F.col("length") <= high)).select("id", "length")
        seen += rows[i]
        parts = 1 + seen // settings.range_rows
        sweep = stash(swept(_items(own, gaps), parts), "sweep")
        count = lambda role: F.sum((F.col("role") == role).cast("long"))
        left = [(r["part"], r["p"], r["g"]) for r in sweep.groupBy("part").agg(count(PIECE).alias("p"), count(GAP).alias("g")).collect()]
        runs = meet(left)
        pairs = sweep.where(F.col("role") == PLACED).select("id", "length", "sequence", "gap")
        rest = sweep.where(F.col("role") != PLACED)
        if runs:
            told = stash(numbered(rest, runs), "leftovers")
            met = told.where("pair is not null")
            across = met.where(F.col("role") == PIECE).select("pair", "id", "length").join(
                met.where(F.col("role") == GAP).select("pair", "sequence", "gap"), "pair"
            )
            pairs = pairs.unionByName(across.drop("pair"))
            rest = told.where("pair is null")
        placed.append(pairs.select("id", "sequence", "gap"))
        after = pairs.select("sequence", (F.col("gap") - F.col("length")).alias("gap")).where("gap > 0")
        gaps = rest.where(F.col("role") == GAP).select("sequence", "gap").unionByName(after)
        if sum(p for _, p, _ in left) > sum(r[4] for r in runs):
            fill = stash(filled(_items(rest.where(F.col("role") == PIECE), gaps), parts, capacity), "fill")
            placed.append(fill.where(F.col("role") == PLACED).select("id", "sequence", "gap"))
            gaps = fill.where(F.col("role") == GAP).select("sequence", "gap")
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    return made.join(found, "id").select(
        *[c for c in made.columns if c != "id"], F.col("sequence").alias("sequence_id"), (F.lit(capacity) - F.col("gap")).cast("long").alias("offset")
    )


def in_order(packed: DataFrame) -> DataFrame:
    """Sequences numbered anew, with gaps, in the order of the first document that each holds a piece of."""
    packed = stash(packed, "packed")
    first = packed.groupBy("sequence_id").agg(F.min(F.struct("order", "piece", "sequence_id")).alias("first"))
    number = stash(first.orderBy("first").select("sequence_id", F.monotonically_increasing_id().alias("number")), "sequence-order")
    return packed.join(number, "sequence_id").withColumn("sequence_id", F.col("number")).drop("order", "number")


def pack(docs: DataFrame, settings: Settings, order: Column | None = None) -> DataFrame:
    """Tokenize, cut and pack every document: one row for each piece. order: of documents, which sequences then have too."""
    packed = assign(stash(pieces(docs, settings, order=order), "pieces"), settings)
    return packed if order is None else in_order(packed).select("doc_id", *[c for c in packed.columns if c not in ("doc_id", "order")])
