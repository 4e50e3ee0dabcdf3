"""Mixing sources to target weights by Pfair scheduling.

Without a budget every row of a source with a weight is scheduled. The sources
run at their target weights, each until its supply ends; the others then go on
in proportion. So rows up to the position where the first source ends have the
target shares, and all rows have them if the shares of the supply are the
targets. `deviation` tells how far a source's share of the mix is from its
target_weight.

With a budget a mix of budget * rows documents is drawn, with shares as near to
the target weights as the supply allows: a source that cannot fill its share
gives all it has, and the others grow in proportion; its sources run at their
shares of the mix.

Each source's documents form blocks. If T(v) blocks of all sources are done when
a source of weight w has done w * v, its block k is released at slot
floor(T(k / w)) and due by slot ceil(T((k + 1) / w)); earliest deadline first
then runs one released block a slot, and at any time a source is less than one
block off its rate.

Only DataFrame functions run. A block has `block` documents at any size of the
table. Slots are scheduled in stretches of `stretch`, each in a row of its own:
how many blocks of a source lie before a stretch's border is its fluid count
rounded up or down, those up that are due first, such that borders have the
right sums; borders are found by halving, level by level, for all stretches at
once, and a stretch holds only sources with a block in it, so at most `stretch`.
In a stretch windows are cut at its borders. With one stretch this is plain
earliest deadline first, and a source is always less than one block off its rate.
With several it is less than one in all runs of the tests; that is not proven in
general: a border whose sum cannot be met by rounding takes further blocks of
the sources due first, and a slot without a released block takes the block due first.

Defined results: null sources form one source. Weights that are null or not
positive, and sources that a weights table doesn't name, count as 0: all their
documents stay out. Ranks are dealt by a hash of the id, the row's checksum and
its place in the input, so repeated rows have ranks of their own. An empty table
gives an empty result. Columns of the input are kept, whatever their names; those
named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import rank_buckets, ranked, stash

NO_SOURCE = "\u0000null"
MADE = ("source_rank", "block", "release", "deadline", "slot", "position", "in_mix", "target_weight", "share", "deviation")


@dataclass(frozen=True)
class Settings:
    """temperature: without a table of weights, a source's weight is its number of documents to this power.

    budget: the part of all rows that is drawn; None schedules all rows.
    block: documents of a block. stretch: slots that are scheduled in one row.
    """

    temperature: float = 0.5
    budget: float | None = 0.9
    block: int = 64
    stretch: int = 512


def quotas(counts: DataFrame, settings: Settings) -> DataFrame:
    """Documents of each source in the mix and the size of a block, from (source, n, weight)."""
    total = Window.partitionBy()
    given = counts.withColumn("target_weight", F.col("weight") / F.sum("weight").over(total))
    if settings.budget is None:
        full = given.where("target_weight > 0").withColumn("quota", F.col("n").cast("long")).withColumn("rate", F.col("target_weight"))
        return _sized(full, settings)
    given = given.withColumn("target", F.floor(F.sum("n").over(total) * F.lit(settings.budget)))
    before = Window.orderBy(F.col("n") / F.nullif("target_weight", F.lit(0.0)), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    usable = given.where("target_weight > 0")
    rest = F.lit(1.0) - F.coalesce(F.sum("target_weight").over(before), F.lit(0.0))
    level = (F.col("target") - F.coalesce(F.sum("n").over(before), F.lit(0))) / F.when(rest > 1e-12, rest)
    full = usable.withColumn("_level", level).withColumn("_level", F.max("_level").over(total))
    share = F.floor(F.least(F.col("n").cast("double"), F.col("_level") * F.col("target_weight") + F.lit(1e-9)))
    return _sized(full.withColumn("quota", share.cast("long")).withColumn("rate", F.lit(None).cast("double")), settings)


def _sized(full: DataFrame, settings: Settings) -> DataFrame:
    """With the size of a block. rate: the weight a source runs at, null for its number of blocks."""
    size = F.lit(settings.block).cast("long").alias("block_size")
    return full.select("source", "n", "target_weight", "quota", "rate", size)


NEAR = 1e-7


def curve(sized: DataFrame) -> DataFrame:
    """The corners of T, as (v, t) with the corner before (v0, t0): where a source's supply ends, T's slope falls."""
    ends = sized.groupBy((F.col("b") / F.col("w")).alias("v")).agg(F.sum("w").alias("w"), F.sum("b").cast("double").alias("b"))
    by = Window.orderBy("v")
    after = F.coalesce(F.sum("w").over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    corners = ends.select("v", (F.sum("b").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("v") * after).alias("t"))
    return corners.select("v", "t", *[F.lag(c, 1, 0.0).over(by).alias(f"{c}0") for c in ("v", "t")])


def borders(corners: DataFrame, stretch: int) -> DataFrame:
    """v at each multiple of a stretch below the total, as (stretch, v)."""
    first, last = (F.ceil(F.col(c) / stretch).cast("long") for c in ("t0", "t"))
    inside = corners.where(first < last).select("*", F.explode(F.sequence(first, last - 1)).alias("stretch"))
    part = (F.col("stretch") * stretch - F.col("t0")) / (F.col("t") - F.col("t0"))
    return inside.select("stretch", (F.col("v0") + part * (F.col("v") - F.col("v0"))).alias("v"))


def halved(nodes: DataFrame, times: DataFrame, half: int, stretch: int, total: int) -> DataFrame:
    """Each node (a, source, w, b, low, high), of 2 * half stretches from a on, as two. low, high: blocks before its start and end."""
    at = nodes.withColumn("mid", F.col("a") + half).join(times.withColumnRenamed("stretch", "mid"), "mid", "left")
    fluid = F.coalesce(F.least(F.col("b").cast("double"), F.col("w") * F.col("v")), F.col("b").cast("double"))
    down = F.floor(fluid + NEAR).cast("long")
    at = at.withColumn("least", F.least(F.greatest(down, "low"), "high")).withColumn("due", (down + 1) / F.col("w"))
    at = at.withColumn("most", F.greatest(F.least(F.ceil(fluid - NEAR).cast("long"), "high"), "least"))
    node = Window.partitionBy("a")
    up, back = node.orderBy("due", "source"), node.orderBy(F.desc("due"), F.desc("source"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = lambda c: F.least(F.col(c) * stretch, F.lit(total))
    gain, more, less = F.col("most") - F.col("least"), F.col("high") - F.col("most"), F.col("least") - F.col("low")
    need = end("mid") - end("a") - F.sum(less).over(node)
    taken = lambda c, goal, w: F.greatest(F.lit(0), F.least(c, goal - before(c, w)))
    change = taken(gain, need, up) + taken(more, need - F.sum(gain).over(node), up) - taken(less, -need, back)
    at = at.withColumn("middle", (F.col("least") + change).cast("long"))
    two = F.explode(F.array(
        F.struct(F.col("a"), F.col("low"), F.col("middle").alias("high")),
        F.struct(F.col("mid").alias("a"), F.col("middle").alias("low"), F.col("high")),
    ))
    return at.select("source", "w", "b", "quota", "block_size", two.alias("x")).select("x.*", "source", "w", "b", "quota", "block_size").where("low < high")


def schedule(plan: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """source, block, release, deadline, slot and first position of every block, from quotas."""
    stretch = settings.stretch
    blocks = F.ceil(F.col("quota") / F.col("block_size")).cast("long")
    sized = plan.where("quota > 0").select(
        "source", "quota", "block_size", blocks.alias("b"), F.coalesce(F.col("rate"), blocks.cast("double")).alias("w")
    )
    total = sized.agg(F.sum("b")).first()[0] or 0
    corners = curve(sized)
    times = stash(borders(corners, stretch), "borders")
    levels = max(0, -(-total // stretch) - 1).bit_length()
    zero = F.lit(0).cast("long")
    nodes = sized.select(zero.alias("a"), zero.alias("low"), F.col("b").alias("high"), "source", "w", "b", "quota", "block_size")
    for level in reversed(range(levels)):
        nodes = halved(nodes, times, 1 << level, stretch, total)
        if level % 3 == 0:
            nodes = stash(nodes, "nodes")
    points = times.select((F.col("stretch") * stretch).cast("double").alias("t"), "v").unionByName(corners.select("t", "v"))
    of = F.floor(F.col("t") / stretch).cast("long")
    both = F.when(F.col("t") == of * stretch, F.array(of, of - 1)).otherwise(F.array(of))  # a border ends one and begins one
    lines = points.select(F.explode(both).alias("a"), F.struct("v", "t").alias("p"))
    lines = lines.groupBy("a").agg(F.array_sort(F.collect_set("p")).alias("line"))
    items = nodes.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("source", "w", "b", "quota", "block_size", "low", "high"))).alias("given"))
    start, end = F.col("a") * stretch, F.least((F.col("a") + 1) * stretch, F.lit(total))
    one = items.join(lines, "a").withColumn("start", start).withColumn("end", end)

    def done(v: Column) -> Column:
        """T(v) in the stretch, its borders beyond them."""
        p = F.try_element_at(F.filter("line", lambda x: x["v"] <= v), F.lit(-1))
        q = F.get(F.filter("line", lambda x: x["v"] > v), F.lit(0))
        t = p["t"] + (v - p["v"]) * (q["t"] - p["t"]) / (q["v"] - p["v"])
        t = F.when(p.isNull(), F.col("start").cast("double")).when(q.isNull(), F.col("end").cast("double")).otherwise(t)
        return F.greatest(F.col("start").cast("double"), F.least(F.col("end").cast("double"), t))

    def windows(s: Column) -> Column:
        """A source with the slots of releases and deadlines of its blocks in the stretch."""
        ends = F.transform(F.sequence(s["low"], s["high"]), lambda k: done(k / s["w"]))
        n = (s["high"] - s["low"]).cast("int")
        release = F.transform(F.slice(ends, F.lit(1), n), lambda t: F.floor(t + NEAR).cast("long"))
        deadline = F.transform(F.slice(ends, F.lit(2), n), lambda t: F.ceil(t - NEAR).cast("long"))
        own = [s[c].alias(c) for c in ("source", "b", "quota", "block_size", "low")]
        return F.struct(*own, n.alias("n"), release.alias("release"), deadline.alias("deadline"))

    one = one.select("a", "start", "end", F.transform("given", windows).alias("sources"))
    none = F.transform("sources", lambda s: F.lit(0))

    def run(state: Column, slot: Column) -> Column:
        def job(s: Column, i: Column) -> Column:
            k = F.get(state["next"], i)
            early = F.get(s["release"], k) > slot
            return F.when(k < s["n"], F.struct(early.alias("early"), F.get(s["deadline"], k).alias("due"), i.alias("i"), k.alias("k")))

        def after(first: Column) -> Column:
            return F.struct(
                F.transform(state["next"], lambda k, i: k + F.when(i == first["i"], 1).otherwise(0)).alias("next"),
                F.concat(state["order"], F.array(F.struct(first["i"].alias("i"), first["k"].alias("k")))).alias("order"),
            )

        first = F.array_min(F.transform("sources", job))
        return F.get(F.transform(F.array(first), after), F.lit(0))  # found once, not for each source

    order = F.aggregate(
        F.sequence("start", F.col("end") - 1),
        F.struct(none.alias("next"), F.array().cast("array<struct<i:int,k:int>>").alias("order")),
        run,
        lambda s: s["order"],
    )
    slots = one.select("a", "start", "sources", F.posexplode(order).alias("at", "x")).withColumn("s", F.get("sources", F.col("x.i")))
    block = F.col("s.low") + F.col("x.k")
    slots = stash(slots.select(
        "a", F.col("s.source").alias("source"), block.alias("block"), F.get("s.release", F.col("x.k")).alias("release"),
        F.get("s.deadline", F.col("x.k")).alias("deadline"), (F.col("start") + F.col("at")).cast("long").alias("slot"),
        F.least(F.col("s.block_size"), F.col("s.quota") - block * F.col("s.block_size")).alias("docs"),
        (F.col("s.b") / F.lit(total)).alias("share"),
    ), "slots")
    before = lambda w: F.coalesce(F.sum("docs").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = slots.groupBy("a").agg(F.sum("docs").alias("docs")).select("a", before(Window.orderBy("a")).alias("base"))
    slots = slots.withColumn("within", before(Window.partitionBy("a").orderBy("slot"))).join(sums, "a")
    return slots.select("source", "block", "release", "deadline", "slot", (F.col("base") + F.col("within")).alias("first"), "share")


def mix(docs: DataFrame, weights: DataFrame | None = None, settings: Settings = Settings(), source: str = "source") -> DataFrame:
    """Every row with its source rank, block, release, deadline, slot, position and whether it is in the mix.

    weights: source and weight. Rows outside the mix have null block to position.
    """
    taken = {c.lower() for c in MADE}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in taken])
    rest = sorted(c for c in docs.columns if c.lower() != "doc_id")
    keyed = docs.select(  # the row travels as one column, whatever its columns are called
        F.struct(*docs.columns).alias("row"),
        F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source"),
        F.xxhash64("doc_id").alias("h"),
        F.col("doc_id").alias("id"),
        (F.xxhash64(*rest) if rest else F.lit(0).cast("long")).alias("mark"),
    )
    counts = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("n", F.lit(settings.temperature)))
    else:
        named = weights.select(
            F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), F.col("weight").cast("double")
        )
        named = named.groupBy("source").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight"))).alias("weight"))
        counts = counts.join(named, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    plan = stash(quotas(counts, settings), "quotas")
    slots = schedule(plan, settings)
    placed = ranked(keyed, ["source"], [F.col("h"), F.col("id"), F.col("mark")], "source_rank", rank_buckets(docs.count()))
    placed = placed.join(plan.select("source", "target_weight", "quota", "block_size"), "source", "left")
    inside = F.coalesce(F.col("source_rank") < F.col("quota"), F.lit(False))
    placed = placed.withColumn("in_mix", inside).withColumn(
        "block", F.when(inside, F.floor(F.col("source_rank") / F.col("block_size")).cast("long"))
    )
    out = placed.join(slots, ["source", "block"], "left").withColumn("deviation", F.col("share") - F.col("target_weight"))
    position = F.col("first") + F.col("source_rank") - F.col("block") * F.col("block_size")
    return out.withColumn("position", position).select("row.*", *MADE)
