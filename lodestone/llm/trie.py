"""The trie of conversation prefixes, by prefix doubling.

A node is a distinct sequence of first turns. Turns get dense numbers; in
logarithmically many join rounds the aligned blocks of 2, 4, 8 ... turns get
dense numbers for their pairs of halves. The prefix of d turns is the blocks of
d's binary digits, so its name is the short list of their numbers, and lengths
add up over the same blocks. Grouping the prefixes by name gives the nodes.

What a node sums over its subtree comes from its members alone. The smallest
member of a node owns it; along a conversation the owned nodes are the last
ones, from depth `first` on. So every node of a subtree is counted once where
each member counts the nodes that it owns below.

No text moves beyond its digest, no conversation or group of members is ever in one row or
needs one task: turns are numbered over a range sort, conversations meet by
equi-joins and sums made before the shuffle. SHA-256 of the conversations that
end in a node is sequential by nature: its input is joined in chunks of sorted ids in
parallel, and one task streams a node's chunks in order.

Defined results: turns go by turn number, null first, ties by a digest of role and text; null roles
and texts are empty; equal rows are turns of their own. Rows without a conv_id
belong to no conversation. An empty table has no nodes, not even the root. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import drop_stash, ship_package, stash

#: Ids in a chunk of the digest's input.
CHUNK = 4096


def _dense(placed: DataFrame, name: str) -> DataFrame:
    """A written column of monotonically_increasing_id without its gaps."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_part", F.shiftright(F.col(name), 33)).withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    sizes = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return placed.join(sizes, "_part").withColumn(name, F.col("_before") + F.col(name)).drop("_part", "_before")


def named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add `name`: a dense number of the distinct values of the keys, in place of them."""
    distinct = stash(rows.select(*keys).distinct().withColumn(name, F.monotonically_increasing_id()), "trie-names")
    return rows.join(_dense(distinct, name), keys).drop(*keys)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i, key and chars: each turn's number in its conversation, a digest of role and text, its code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("key"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["conv_id", "turn", "key", "_row"]  # the row's number splits equal rows
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = _dense(stash(rows, "trie-turns"), "_at")
    first = rows.groupBy("conv_id").agg(F.min("_at").alias("_first"))
    return rows.join(first, "conv_id").select("conv_id", (F.col("_at") - F.col("_first")).alias("i"), "key", "chars")


def rebuilt(own: DataFrame, family: Column | None = None, shared: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, turns) and their turns, the first ones taken from another conversation.

    family, shared: of a conv_id, the conversation whose first turns stand in for
    its own first turns, and how many; without them all turns are its own.
    """
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    if family is None or shared is None:
        return convs.select("conv_id", F.col("n").alias("turns")), own
    lengths = convs.select(F.col("conv_id").alias("family"), F.col("n").alias("there"))
    convs = convs.withColumn("family", family).withColumn("shared", shared.cast("long")).join(lengths, "family", "left")
    convs = convs.withColumn("taken", F.least("shared", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0)))
    convs = stash(convs.select("conv_id", "family", "shared", "taken", "turns"), "trie-convs")
    kept = own.join(convs.select("conv_id", "shared", "taken"), "conv_id").where("i >= shared")
    kept = kept.select("conv_id", (F.col("i") - F.col("shared") + F.col("taken")).alias("i"), "key", "chars")
    most = convs.agg(F.max("taken")).first()[0] or 0
    heads = own.where(F.col("i") < most).select(F.col("conv_id").alias("family"), "i", "key", "chars")
    heads = heads.join(convs.select("conv_id", "family", "taken"), "family").where("i < taken")
    return convs.select("conv_id", "turns"), kept.unionByName(heads.select("conv_id", "i", "key", "chars"))


def blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each power of two the aligned blocks of so many turns: conv_id, i (counted in blocks), name, chars."""
    out = [stash(named(turns, ["key"], "name"), "trie-blocks")]
    while 2 << (len(out) - 1) <= longest:
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = out[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i"))
        pairs = pairs.agg(half(0).alias("left"), half(1).alias("right"), F.sum("chars").alias("chars"))
        pairs = stash(pairs.where(F.col("right").isNotNull()), "trie-pairs")
        out.append(stash(named(pairs, ["left", "right"], "name"), "trie-blocks"))
        drop_stash(pairs)
    return out


def prefixes(convs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Each conversation's prefixes: conv_id, depth, turns, name, chars of all its turns, last of its last one.

    A block that stands for a binary digit of depths stands for a run of them: block i (even) of
    2^b turns for the depths from (i + 1) * 2^b on, 2^b of them.
    """
    rows = None
    for b, level in enumerate(levels):
        stands = F.when(F.col("i") % 2 == 0, F.struct(F.lit(-b).alias("digit"), F.col("name").alias("name"), F.col("chars").alias("chars")))
        last = F.col("chars") if b == 0 else F.lit(None).cast("long")
        level = level.where("i % 2 = 0 or " + ("true" if b == 0 else "false"))
        start = F.shiftleft(F.col("i") + 1, b)
        level = level.select("conv_id", start.alias("start"), F.lit((1 << b) - 1).cast("long").alias("more"), stands.alias("block"), last.alias("last"))
        rows = level if rows is None else rows.unionByName(level)
    rows = rows.join(convs, "conv_id")
    rows = rows.withColumn("depth", F.explode(F.sequence("start", F.least(F.col("start") + F.col("more"), F.col("turns")))))
    root = convs.select("conv_id", "turns", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(rows.schema["block"].dataType).alias("block"), F.lit(None).cast("long").alias("last"))
    rows = rows.select(*root.columns).unionByName(root)
    found = rows.groupBy("conv_id", "depth").agg(
        F.max("turns").alias("turns"),
        F.array_sort(F.collect_list("block")).alias("blocks"),  # as many as depth has binary digits
        F.coalesce(F.sum("block.chars"), F.lit(0)).alias("chars"),
        F.coalesce(F.max("last"), F.lit(0)).alias("last"),
    )
    return found.select("conv_id", "depth", "turns", F.col("blocks.name").alias("name"), "chars", "last")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows to (node, first id, ids joined by commas), at most CHUNK ids each."""
    at, ids = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if ids:
            yield pa.RecordBatch.from_pydict({"node": [at], "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != at or len(ids) == CHUNK:
                yield from flush()
                at, ids = node, []
            ids.append(conv)
    yield from flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to (node, SHA-256 of its chunks joined by commas); one digest is open at a time."""
    at, digest = None, None
    for batch in batches:
        nodes, shas = [], []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if node == at:
                digest.update(b",")
            else:
                if digest is not None:
                    nodes.append(at)
                    shas.append(digest.hexdigest())
                at, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.string()), "sha256": pa.array(shas, pa.string())})
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"node": [at], "sha256": [digest.hexdigest()]})


def ends(prefix: DataFrame) -> DataFrame:
    """depth, name and ends_sha256 of the nodes in which conversations end."""
    ship_package(prefix.sparkSession)
    node = F.concat_ws(",", F.col("depth").cast("string"), F.col("name").cast("array<string>"))
    rows = prefix.where("depth = turns").select(node.alias("node"), "conv_id")
    rows = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    rows = rows.mapInArrow(_chunks, "node string, first long, ids string")
    found = rows.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node string, sha256 string")
    parts = F.split("node", ",")
    depth, name = parts[0].cast("long"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<long>")
    return found.select(depth.alias("depth"), name.alias("name"), F.col("sha256").alias("ends_sha256"))


def nodes(conversations: DataFrame, family: Column | None = None, shared: Column | None = None) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, counts and sums over its subtree, ends_sha256."""
    convs, of = rebuilt(turns(conversations), family, shared)
    longest = convs.agg(F.max("turns")).first()[0] or 0
    prefix = stash(prefixes(convs, blocks(stash(of, "trie-rebuilt"), longest)), "trie-prefixes")
    same = ["depth", "name"]
    found = prefix.groupBy(*same).agg(F.min("conv_id").alias("owner"), F.max("turns").alias("deepest"), F.max("last").alias("last"))
    found = stash(found, "trie-nodes")
    owned = found.groupBy("owner").agg(
        F.min("depth").alias("first"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"), F.sum("last").alias("own")
    )
    info = prefix.where("depth = turns").select("conv_id", F.col("chars").alias("total"))
    info = stash(info.join(owned.withColumnRenamed("owner", "conv_id"), "conv_id", "left"), "trie-owners")

    members = prefix.join(info, "conv_id")
    after = F.col("total") - F.col("chars")
    below = F.when(F.col("first").isNull(), F.lit(0)).when(F.col("depth") + 1 >= F.col("first"), after).otherwise(F.col("own"))
    child = (F.col("first") <= F.col("depth") + 1) & (F.col("depth") < F.col("turns"))
    summed = members.groupBy(*same).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if(child).alias("n_children"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
        ((F.count(F.lit(1)) - 1) * F.max("last") + F.sum(after - below)).alias("saved_tokens"),
    )

    top = info.where("first > 0").select("conv_id", (F.col("first") - 1).alias("depth"))
    root = F.broadcast(found.where("depth = 0").select("depth", F.col("owner").alias("parent")))  # one row
    at_root = top.where("depth = 0").join(root, "depth").select("conv_id", "parent")
    inner = top.where("depth > 0").join(prefix.select("conv_id", *same), ["conv_id", "depth"])
    inner = inner.join(found.select(*same, F.col("owner").alias("parent")), same).select("conv_id", "parent")
    tops = info.where("first is not null").select("conv_id", "first").join(at_root.unionByName(inner), "conv_id", "left")

    out = summed.join(tops, "conv_id").join(ends(prefix), same, "left")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent"))
    return out.select(
        "conv_id",
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
