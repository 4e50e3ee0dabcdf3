"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are grouped into partitions, correlated bits together.
If two fingerprints differ in at most r bits and the partitions' thresholds sum
to r - m + 1 (m partitions, a threshold of -1 skips one), at least one partition
differs within its threshold. A dynamic program allots the thresholds, and with
them m, by the candidates that bit statistics of all fingerprints predict.
Fingerprints are probed partition by partition and each candidate is verified.

A bucket with too many candidate pairs is split exactly, by the same principle
on the bits that its key leaves free. Links join distinct fingerprints; copies
share one. Components are contracted round by round.

Defined results: a null or empty text, or one of blanks only, has fingerprint
zero and is linked like any other. A repeated id takes part with each of its
rows; null ids are ignored when the smallest id is taken, and a component of
null ids only has none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checked_broadcast, drop_stash, fresh, map_column, ship_package, stash

BITS = 64
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Settings:
    """shingle: words; radius: differing bits; hot_pairs: candidate pairs from which a bucket is split."""

    shingle: int = 3
    radius: int = 2
    hot_pairs: int = 4_000_000
    depth: int = 3


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of a whole text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    ends, n, ones = ends[shingle - 1 :], len(words) - shingle + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        h = np.array([digest(flat[i:j], 42) for i, j in spans], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def start():
        return lambda texts: [[_signed(fingerprint(t, shingle)) for t in texts]]

    return map_column(docs, "text", ["doc_id"], "fp long", start)


def hexed(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@dataclass(frozen=True)
class Partition:
    mask: int  # unsigned
    threshold: int


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together, over all rows."""

    ship_package(fps.sparkSession)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.unpackbits(batch["fp"].to_numpy(np.int64).astype(">i8").view(np.uint8)).reshape(-1, BITS)
            for at in range(0, len(x), _BLOCK):
                part = x[at : at + _BLOCK].astype(np.float32)
                total += part.T @ part
            n += len(x)
        flat = np.concatenate([total.astype(np.int64).ravel(), [n]])
        yield pd.DataFrame({"i": np.arange(len(flat)), "n": flat})

    rows = fps.select("fp").mapInPandas(sums, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["i"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy groups of near-equal width, correlated bits together."""
    p = np.diag(together) / max(n, 1)
    var = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    near = np.abs(together / max(n, 1) - np.outer(p, p)) / var
    np.fill_diagonal(near, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = -(-len(free) // (parts - k))
        left = sorted(free)
        sub = near[np.ix_(left, left)]
        i = int(sub.max(1).argmax())
        group = [left[i]]
        free.discard(left[i])
        while len(group) < width:
            left = sorted(free)
            pick = left[int(near[np.ix_(left, group)].mean(1).argmax())]
            group.append(pick)
            free.discard(pick)
        groups.append(sorted(group))
    return groups


def candidates(n: int, differ: np.ndarray, group: list[int], threshold: int) -> float:
    """Pairs expected within the threshold on a group of bits, each differing at its own rate."""
    if threshold < 0:
        return 0.0
    chance = np.zeros(threshold + 2)
    chance[0] = 1.0
    for bit in group:
        chance[1:] = chance[1:] * (1 - differ[bit]) + chance[:-1] * differ[bit]
        chance[0] *= 1 - differ[bit]
    return n * n / 2 * float(chance[: threshold + 1].sum())


#: What it costs to write and sort a probe, in comparisons of two fingerprints.
PROBE_COST = 3.0


def allot(n: int, together: np.ndarray, radius: int, widest_probe: int = 400) -> list[Partition]:
    """Partitions and thresholds of least estimated cost (probes written plus candidates verified)."""
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[Partition]] | None = None
    for m in range(1, radius + 2):
        groups = group_bits(n, together, m)
        need = radius - m + 1
        costs = []
        for group in groups:
            row = {-1: 0.0}
            for t in range(0, radius + 1):
                probes = sum(comb(len(group), d) for d in range(t + 1))
                if probes <= widest_probe:
                    row[t] = PROBE_COST * n * (probes + 1) + candidates(n, differ, group, t)
            costs.append(row)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of thresholds + groups -> cost
        for row in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in table.items():
                for t, c in row.items():
                    new = (cost + c, [*chosen, t])
                    if total + t + 1 not in step or new < step[total + t + 1]:
                        step[total + t + 1] = new
            table = step
        if (found := table.get(need + m)) and (best is None or found[0] < best[0]):
            masks = [sum(1 << (BITS - 1 - b) for b in g) for g in groups]
            best = found[0], [Partition(k, t) for k, t in zip(masks, found[1]) if t >= 0]
    return best[1]


def _bits(mask: int) -> list[int]:
    return [1 << i for i in range(BITS) if mask >> i & 1]


def _flips(mask: int, threshold: int) -> list[int]:
    bits = _bits(mask)
    return [sum(c) for d in range(threshold + 1) for c in combinations(bits, d)]


def links(fps: DataFrame, parts: list[Partition], radius: int, settings: Settings) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in at most radius bits; those of split buckets may come twice."""
    lit = lambda x: F.lit(_signed(x))
    differ = F.col("p.fp").bitwiseXOR(F.col("b.fp"))
    near = F.bit_count(differ) <= radius
    within = [(p, F.bit_count(differ.bitwiseAND(lit(p.mask))) <= p.threshold) for p in parts]
    near = near & (F.col("p.base") == F.coalesce(*[F.when(hit, lit(p.mask)) for p, hit in within]))  # once, by the first
    own = ["fp", "base"]
    exact = all(p.threshold == 0 for p in parts)
    fp = F.col("fp")

    def keyed(make) -> DataFrame:
        pairs = F.array(*[F.struct(lit(p.mask).alias("mask"), lit(f).alias("flip")) for p in parts for f in make(p)])
        rows = fps.select(*own[:-1], F.explode(pairs).alias("k")).select(*own[:-1], "k.mask", "k.flip")
        return rows.withColumn("base", F.col("mask")).withColumn("key", fp.bitwiseXOR(F.col("flip")).bitwiseAND(F.col("mask")))

    build = keyed(lambda p: [0])
    probe = build if exact else keyed(lambda p: _flips(p.mask, p.threshold))
    masks, found = [p.mask for p in parts], []
    for level in range(settings.depth + 1):
        hot = None
        if level < settings.depth:
            sizes = build.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("nb"))
            if exact:
                sizes = sizes.withColumn("np", F.col("nb"))
            else:
                sizes = sizes.join(probe.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("np")), ["mask", "key"])
            hot = stash(sizes.where(F.col("nb") * F.col("np") > settings.hot_pairs).select("mask", "key"), "hot-buckets")
            if hot.isEmpty():
                hot = None
        cold = lambda df: df if hot is None else df.join(hot, ["mask", "key"], "left_anti")
        found.append(
            cold(probe)
            .alias("p")
            .join(
                cold(build).alias("b"),
                (F.col("p.mask") == F.col("b.mask")) & (F.col("p.key") == F.col("b.key")) & (F.col("p.fp") < F.col("b.fp")) & near,
            )
            .select(F.col("p.fp").alias("a"), F.col("b.fp").alias("b"))
        )
        if hot is None:
            break
        children = {}  # the free bits of each mask in radius + 1 parts: one of them is equal in every linked pair
        for mask in masks:
            free = _bits(((1 << BITS) - 1) & ~mask)
            split = [sum(free[i :: radius + 1]) for i in range(radius + 1)]
            children[mask] = [mask | s for s in split]
        by_mask = F.create_map(
            *[x for m, c in children.items() for x in (lit(m), F.array(*[lit(k) for k in c]))]
        )

        def finer(df: DataFrame) -> DataFrame:
            rows = df.join(hot, ["mask", "key"], "left_semi")
            rows = rows.select(*own, "flip", F.explode(F.element_at(by_mask, F.col("mask"))).alias("mask"))
            return rows.withColumn("key", fp.bitwiseXOR(F.col("flip")).bitwiseAND(F.col("mask")))

        build, probe = finer(build), None if exact else finer(probe)
        probe = build if exact else probe
        masks = sorted({k for c in children.values() for k in c})
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of the edges (a, b), by rounds of hooking, jumping and contraction."""
    edges = stash(edges.select("a", "b").where("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        hook = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        jump = stash(
            hook.alias("h").join(hook.alias("g"), F.col("h.p") == F.col("g.u")).select("h.u", F.col("g.p").alias("p")),
            "jump",
        )
        rounds.append(jump)
        to = lambda side: jump.select(F.col("u").alias(side), F.col("p").alias(f"p{side}"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("pa <> pb")
        after = stash(
            moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges"
        )
        drop_stash(edges)
        edges = after
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mapping = rounds[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for jump in rounds[1:]:
        later = jump.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
        mapping = mapping.join(later, mapping["root"] == later["_u"], "left").select("node", F.coalesce("_p", "root").alias("root"))
    return stash(mapping, "roots") if len(rounds) > 1 else mapping


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    marked = stash(fingerprints(docs, settings.shingle), "fingerprints")
    fps = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    n, together = bit_statistics(fps)
    if n < 2:
        return marked.join(fps, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))
    roots = components(links(fps, allot(n, together, settings.radius), settings.radius, settings))
    members = roots.join(fps, roots["node"] == fps["fp"]).select("node", "root", "first")
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = members.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    ids = fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id.

    If that id repeats in its component, one of its rows stays. Rows without an
    id stay only for a component that has no id at all, one each.
    """
    start = lambda: lambda texts: [[_signed(fingerprint(t, settings.shingle)) for t in texts]]
    return one_each(docs, near_duplicates(docs.select("doc_id", "text"), settings), start)


def one_each(docs: DataFrame, found: DataFrame, start) -> DataFrame:
    """The rows of docs that `deduplicated` keeps, from doc_id, fp and component_id; start makes fp from texts."""
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fp")
    names = {c: fresh(c, docs.columns) for c in ("kept_id", "kept_n")}
    ids = stash(kept.groupBy(F.col("doc_id").alias(names["kept_id"])).agg(F.count(F.lit(1)).alias(names["kept_n"])), "kept-ids")
    out = docs.join(checked_broadcast(ids), docs["doc_id"].eqNullSafe(ids[names["kept_id"]]))
    once = out.where(F.col(names["kept_n"]) == 1).select(*docs.columns)
    if ids.where(F.col(names["kept_n"]) > 1).isEmpty():
        return once
    repeated = out.where(F.col(names["kept_n"]) > 1).select(*docs.columns)
    mark = fresh("kept_fp", docs.columns)
    keyed = map_column(repeated, "text", docs.columns, f"`{mark}` long", start)
    rows = kept.select(F.col("doc_id").alias(names["kept_id"]), F.col("fp").alias(names["kept_n"])).distinct()
    exact = keyed.join(rows, keyed["doc_id"].eqNullSafe(rows[names["kept_id"]]) & (keyed[mark] == rows[names["kept_n"]]), "left_semi")
    return once.unionByName(exact.dropDuplicates(["doc_id", mark]).select(*docs.columns))
