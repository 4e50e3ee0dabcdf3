"""A chunk index in immutable segments.

What is added is a segment: its chunks and vectors, its blocks of postings, and
its own counts (document frequencies of its words, number and length of its
chunks). Nothing that is there is read for it but chunk ids. A chunk that comes
again replaces the stored one: the old one is listed as removed, and the part
carries corrections of the old segment's counts, made from the old text. Readers
add up the counts of all segments and leave out removed chunks.

Segments of like size are written as one when there are `fanout` of them, so
a chunk is written again only as often as the index has tiers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions import text as T
from lodestone.operators import retrieval
from lodestone.plans.store import Store
from lodestone.session import stash

#: The tables of a segment with a row for each chunk, and those of its counts.
CHUNKED, COUNTS = ("chunks", "vectors", "blocks", "corpus"), ("frequencies", "sizes", "removed")
#: Those of a new segment that are written ahead of the commit, as its other parts are made of them.
AHEAD = ("chunks", "blocks", "corpus")
SCHEMAS = {
    "frequencies": "segment string, term string, df long, max_tf long, min_dl long",
    "sizes": "segment string, n long, words long",
}


class Segments:
    """The segments of a store; vectors makes rows (chunk_id, ...) of chunks."""

    def __init__(
        self, store: Store, schema: StructType, vectors: Callable[[DataFrame], DataFrame] | None = None,
        params: retrieval.Bm25 = retrieval.Bm25(), fanout: int = 8,
    ) -> None:
        self.store, self.vectors, self.params, self.fanout = store, vectors, params, max(2, fanout)
        self.schema = StructType([*schema.fields, StructField("segment", StringType())])

    def names(self) -> list[str]:
        return self.store.labels("corpus")

    def removed(self) -> DataFrame | None:
        """segment and chunk_id of the chunks that count no more; None if there are none."""
        return self.store.read("removed") if self.store.labels("removed") else None

    def _counting(self, rows: DataFrame) -> DataFrame:
        gone = self.removed()
        return rows if gone is None else rows.join(retrieval.small(gone), ["segment", "chunk_id"], "left_anti")

    def chunks(self) -> DataFrame:
        """The chunks that count."""
        return self._counting(self.store.read("chunks", self.schema)).drop("segment")

    def vector_rows(self) -> DataFrame:
        """The vectors of the chunks that count."""
        return self._counting(self._vector_rows(self.names())).drop("segment")

    def _vector_rows(self, of: list[str]) -> DataFrame:
        return self.store.read("vectors").where(F.col("segment").isin(of))  # a part of vectors that were built anew is of many segments

    def build_vectors(self) -> None:
        """Make the vectors of all chunks anew."""
        stored = self._counting(self.store.read("chunks", self.schema))
        made = self.vectors(stored.drop("segment")).join(stored.select("segment", "chunk_id"), "chunk_id")
        self.store.commit({"vectors": made})

    def _counts(self, name: str, of: Iterable[str] | None = None) -> DataFrame:
        """Counts and corrections of live segments; of: only what parts with these labels hold."""
        rows = self.store.read(name, StructType.fromDDL(SCHEMAS[name]), of)
        return rows.where(F.col("segment").isin(self.names()))  # corrections of segments that were merged are in the merged counts

    def index(self) -> retrieval.LexicalIndex:
        """All segments as one index, merged as it is read."""
        gone = self.removed()
        return retrieval.merged(
            self.store.read("blocks"), self._counts("frequencies"), self._counts("sizes"), self.store.read("corpus"), self.params,
            None if gone is None else retrieval.small(gone),
        )

    # -------------------------------------------------------------- writing

    def _parts(self, chunks: DataFrame, name: str) -> tuple[dict[str, DataFrame], DataFrame]:
        """A segment's parts and its written corpus; what parts are made of is written once, where it stays."""
        chunks = self.store.put("chunks", chunks.withColumn("segment", F.lit(name)), name).drop("segment")
        rows = {"vectors": self.vectors(chunks).withColumn("segment", F.lit(name))} if self.vectors else {}
        counts, corpus = self._indexed(*retrieval.posting_blocks(chunks, name), name)
        return rows | counts, corpus

    def _indexed(self, blocks: DataFrame, corpus: DataFrame, name: str) -> tuple[dict[str, DataFrame], DataFrame]:
        """The counts of blocks and corpus, which are written, and that corpus."""
        blocks, corpus = self.store.put("blocks", blocks, name), self.store.put("corpus", corpus, name)
        counts = {"frequencies": retrieval.frequencies(blocks), "sizes": retrieval.sizes(corpus)}
        kinds = {n: StructType.fromDDL(SCHEMAS[n]) for n in counts}
        return {n: df.select(*[F.col(f.name).cast(f.dataType) for f in kinds[n]]) for n, df in counts.items()}, corpus

    def replace_all(self, chunks: DataFrame, also: dict[str, DataFrame] | None = None) -> None:
        """One segment of these chunks in the place of all there are. also: further tables of the same commit."""
        base, name = self.store.version(), uuid.uuid4().hex
        old = {label for table in (*CHUNKED, *COUNTS) for label in self.store.labels(table)}
        parts, _ = self._parts(chunks, name)
        self.store.commit(also or {}, parts, name, old, base, ready=AHEAD)

    def add(self, chunks: DataFrame, also: dict[str, DataFrame] | None = None, base: int | None = None) -> None:
        """A segment of these chunks, which replace stored ones of the same ids. also: parts of other tables in the same commit.

        Of chunks that repeat an id one is taken. base: the version that they were made from.
        """
        base, name = self.store.version() if base is None else base, uuid.uuid4().hex
        parts, corpus = self._parts(chunks.dropDuplicates(["chunk_id"]), name)
        if self.names():
            ids = retrieval.small(corpus.select("chunk_id"))
            known = stash(self._counting(self.store.read("corpus").join(ids, "chunk_id", "left_semi").select("segment", "chunk_id")), "known")
            if not known.isEmpty():
                parts |= self._corrections(known, parts)
        self.store.commit({}, parts, name, (), base, also, AHEAD)

    def _corrections(self, known: DataFrame, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The parts, with the known chunks removed and their words taken off their segments' counts."""
        old = self.store.read("chunks", self.schema).join(retrieval.small(known), ["segment", "chunk_id"], "left_semi")
        words = stash(old.select("segment", T.tokens(F.coalesce("text", F.lit(""))).alias("w")), "known-words")
        none = F.lit(None).cast("long")
        less = words.select("segment", F.explode(F.array_distinct("w")).alias("term")).groupBy("segment", "term")
        less = less.agg((-F.count(F.lit(1))).alias("df")).select("segment", "term", "df", none.alias("max_tf"), none.alias("min_dl"))
        fewer = words.groupBy("segment").agg((-F.count(F.lit(1))).alias("n"), (-F.sum(F.size("w"))).cast("long").alias("words"))
        return parts | {
            "removed": known,
            "frequencies": parts["frequencies"].unionByName(less),
            "sizes": parts["sizes"].unionByName(fewer),
        }

    def tiers(self) -> dict[int, list[str]]:
        """The segments by the power of fanout that their numbers of chunks have."""
        found = {r["segment"]: r["n"] for r in self._counts("sizes").groupBy("segment").agg(F.sum("n").alias("n")).collect()}  # one row a segment
        out: dict[int, list[str]] = {}
        for name in self.names():
            n, tier = found.get(name, 0), 0
            while n >= self.fanout:
                n, tier = n // self.fanout, tier + 1
            out.setdefault(tier, []).append(name)
        return out

    def compact(self) -> int:
        """Merge full tiers, until none is; how many merges there were."""
        merges = 0
        while full := next((names for _, names in sorted(self.tiers().items()) if len(names) >= self.fanout), None):
            self.merge(full)
            merges += 1
        return merges

    def merge(self, old: list[str]) -> None:
        """Write these segments as one, without their removed chunks; postings and vectors are moved, not made again."""
        base, name = self.store.version(), uuid.uuid4().hex
        blocks, corpus = self.store.read("blocks", labels=old), self.store.read("corpus", labels=old)
        parts, _ = self._indexed(*retrieval.blocks_again(blocks, corpus, name, self.removed()), name)
        rows = {"chunks": self.store.read("chunks", self.schema, old)} | ({"vectors": self._vector_rows(old)} if self.vectors else {})
        parts |= {n: self._counting(df).withColumn("segment", F.lit(name)) for n, df in rows.items()}
        others = F.col("segment").isin([n for n in self.names() if n not in old])
        for n in ("frequencies", "sizes"):  # corrections of other segments stay
            parts[n] = parts[n].unionByName(self._counts(n, old).where(others))
        if set(old) & set(self.store.labels("removed")):
            parts["removed"] = self.store.read("removed", labels=old).where(others)
        self.store.commit({}, parts, name, old, base, ready=("blocks", "corpus"))
