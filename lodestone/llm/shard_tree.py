"""Hierarchical weighted hash tree: regions hold racks, racks hold shards.

A row descends the tree. At each level every child draws -ln(u)/weight, u a
hash of the row's key and the child's path, and the smallest draw wins; a
child's weight is the sum below it. A draw depends on that child's weight
alone, so a change moves rows only into (or out of) subtrees whose weights
changed. A further shard opens a region of its own, so it takes rows only into
itself.

Only built-in functions run here.

Defined results: a null key is the empty one; a null text has no bytes, so
size 1 and checksum 0. Rows of one key share a shard, whatever their number;
their slots are numbered in parts. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import rank_buckets, ranked


@dataclass(frozen=True)
class Tree:
    """Weights of shards by region and rack; shards are numbered in order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(regions: int = 2, racks: int = 2, shards: int = 4) -> Tree:
        return Tree(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own."""
        return Tree((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _winner(weights: Column, path: Column, key: Column) -> Column:
    """The index of the child with the smallest weighted draw."""

    def draw(weight: Column, i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws(":", path, i.cast("string"), key)), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.ln(u) / weight).alias("draw"), i.alias("i"))

    return F.array_min(F.transform(F.filter(F.transform(weights, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda c: c["w"] > 0), lambda c: draw(c["w"], c["i"])))["i"]


def place(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """Add region, rack and shard (with a prefix) for the key."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    racks = F.array(*[doubles(sum(rack) for rack in region) for region in tree.regions])
    shards = F.array(*[F.array(*[doubles(rack) for rack in region]) for region in tree.regions])
    number, first = 0, []
    for region in tree.regions:
        first.append([])
        for rack in region:
            first[-1].append(number)
            number += len(rack)
    starts = F.array(*[F.array(*[F.lit(x) for x in xs]) for xs in first])
    region, rack, shard = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    df = df.withColumn(region, _winner(doubles(sum(map(sum, r)) for r in tree.regions), F.lit("region"), text))
    df = df.withColumn(
        rack, _winner(F.get(racks, F.col(region)), F.concat_ws(":", F.lit("rack"), F.col(region).cast("string")), text)
    )
    path = F.concat_ws(":", F.lit("shard"), F.col(region).cast("string"), F.col(rack).cast("string"))
    inside = _winner(F.get(F.get(shards, F.col(region)), F.col(rack)), path, text)
    return df.withColumn(shard, (F.get(F.get(starts, F.col(region)), F.col(rack)) + inside).cast("int"))


def assign(docs: DataFrame, tree: Tree) -> DataFrame:
    """Every row's shard, its place when one shard is added, and a gapless slot in its shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = place(place(narrow, F.col("doc_id"), tree), F.col("doc_id"), tree.grown(), "grown_")
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return ranked(placed, ["shard"], order, "slot", rank_buckets(docs.count()))
