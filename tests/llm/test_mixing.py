import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing as M


def docs(spark, sizes):
    rows = [(i * 100_000 + j, s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit(1))


def model_quotas(sizes, weights, budget):
    """Water-filling by bisection."""
    goal = math.floor(sum(sizes.values()) * budget)
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(sizes[s], mid * weights[s]) for s in sizes) < goal else (lo, mid)
    return {s: math.floor(min(sizes[s], hi * weights[s]) + 1e-6) for s in sizes}


def model_schedule(blocks):
    """Earliest deadline first with release times, slot by slot."""
    total, done, out = sum(blocks.values()), dict.fromkeys(blocks, 0), []
    for slot in range(total):
        ready = [(-(-(k + 1) * total // blocks[s]), s) for s, k in done.items() if k < blocks[s] and k * total // blocks[s] <= slot]
        due, s = min(ready)
        assert slot < due
        out.append((s, done[s]))
        done[s] += 1
    return out


@pytest.mark.parametrize("sizes,size", [({"a": 50, "b": 10, "c": 3}, 1), ({"a": 900, "b": 60, "c": 61, "d": 1}, 6), ({"a": 7}, 1)])
def test_schedule(spark, sizes, size):
    settings = M.Settings(block=size)
    rows = M.mix(docs(spark, sizes), settings=settings).collect()
    assert len(rows) == sum(sizes.values())
    weights = {s: n**0.5 for s, n in sizes.items()}
    quota = model_quotas(sizes, weights, 0.9)
    inside = [r for r in rows if r["in_mix"]]
    got = {s: sum(r["source"] == s for r in inside) for s in sizes}
    assert got == quota
    blocks = {s: -(-q // size) for s, q in quota.items() if q}
    assert sorted({(r["slot"], r["source"], r["block"]) for r in inside}) == [(i, s, k) for i, (s, k) in enumerate(model_schedule(blocks))]
    assert sorted(r["position"] for r in inside) == list(range(len(inside)))
    total = sum(blocks.values())
    for s, b in blocks.items():
        slots = sorted({r["slot"] for r in inside if r["source"] == s})
        for t in range(1, total + 1):
            assert abs(sum(x < t for x in slots) - t * b / total) < 1
    assert all(r["position"] is None and r["block"] is None for r in rows if not r["in_mix"])


def test_given_weights_and_edges(spark):
    rows = docs(spark, {"a": 40, "b": 40, "c": 5})
    rows = rows.unionByName(spark.createDataFrame([(None, None), (1, None), (1, None)], "doc_id long, source string").withColumn("slot", F.lit(1)))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None), (None, 0.5), ("zz", 9.0)], "source string, weight double")
    got = M.mix(rows, weights, M.Settings(budget=0.4)).collect()
    inside = {s: sum(r["source"] == s and r["in_mix"] for r in got) for s in ("a", "b", "c", None)}
    assert inside["c"] == 0 and inside["a"] == pytest.approx(3 * inside["b"], abs=3) and inside[None] <= 3
    assert len(got) == 88 and all(r["slot"] != 1 or r["in_mix"] for r in got)
    assert M.mix(rows.limit(0)).count() == 0
    everything = M.mix(rows, settings=M.Settings(budget=1.0))
    assert everything.where("in_mix").count() == 88


def test_without_a_budget_nothing_is_dropped_and_weights_hold_while_supplies_last(spark):
    even = M.mix(docs(spark, {"a": 40, "b": 40, "c": 40}), settings=M.Settings(budget=None)).collect()
    assert all(r["in_mix"] for r in even) and all(abs(r["deviation"]) < 1e-9 for r in even)
    sizes = {"big": 400, "x": 25, "y": 25, "z": 25}
    for size, stretch in ((1, 512), (5, 512), (1, 32)):
        rows = M.mix(docs(spark, sizes), settings=M.Settings(budget=None, block=size, stretch=stretch)).collect()
        assert sorted(r["position"] for r in rows) == list(range(475)) and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
        target = {s: n**0.5 / (20 + 15) for s, n in sizes.items()}
        meets = 25 * 35 // 5  # the small sources end here
        for upto in range(10, meets + 1, 11):
            for s in sizes:
                got = sum(r["source"] == s and r["position"] < upto for r in rows)
                assert abs(got - target[s] * upto) < 2 * size
        assert {r["source"]: round(r["deviation"], 6) for r in rows} == {s: round(n / 475 - target[s], 6) for s, n in sizes.items()}


def test_any_column_names(spark):
    names = ("quota", "block_size", "first", "_part", "_before", "_source", "n", "h", "id", "mark", "row", "share", "weight", "_row")
    plain = docs(spark, {"a": 30, "b": 12}).select("doc_id", "source")
    clashing = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    got = M.mix(clashing, settings=M.Settings(budget=None)).collect()
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names if c != "share")
    want = {r["source"]: 0 for r in got}
    for r in got:
        want[r["source"]] += 1
    assert want == {"a": 30, "b": 12} and sorted(r["position"] for r in got) == list(range(42))


def test_one_row_repeated_is_split(spark):
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("source"))
    got = M.mix(rows, settings=M.Settings(budget=None))
    assert got.agg(F.countDistinct("position"), F.max("position")).first() == (30_000, 29_999)


@pytest.mark.parametrize("seed", range(4))
def test_stretches_keep_the_bound_and_are_earliest_deadline_first(spark, seed):
    r = random.Random(seed)
    plan, budget = [], seed % 2
    for i in range(r.choice((3, 12, 40))):
        quota = int(r.paretovariate(0.6) * 3) % 700 + 1
        plan.append((f"s{i:02d}", quota, None if budget else r.random() + 0.02))
    total, stretch = sum(q for _, q, _ in plan), 37
    frame = spark.createDataFrame(plan, "source string, quota long, rate double").withColumn("block_size", F.lit(1).cast("long"))
    rows = sorted(M.schedule(frame, M.Settings(stretch=stretch)).collect(), key=lambda x: x["slot"])
    assert [x["slot"] for x in rows] == list(range(total)) == [x["first"] for x in rows]
    assert sorted((x["source"], x["block"]) for x in rows) == sorted((s, k) for s, q, _ in plan for k in range(q))
    for at in range(0, total, stretch):  # each stretch by plain code, from its jobs
        jobs = {(x["source"], x["block"]): (x["release"], x["deadline"]) for x in rows[at : at + stretch]}
        for x in rows[at : at + stretch]:
            heads = {}
            for s, k in jobs:
                heads[s] = min(heads.get(s, k), k)
            best = min((jobs[s, k][0] > x["slot"], jobs[s, k][1], s, k) for s, k in heads.items())
            assert best[2:] == (x["source"], x["block"])
            del jobs[best[2:]]
    weight = {s: w or float(q) for s, q, w in plan}
    done, worst = dict.fromkeys(weight, 0), 0.0
    for t, x in enumerate(rows, 1):
        done[x["source"]] += 1
        lo, hi = 0.0, max(q / weight[s] for s, q, _ in plan)
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(q, weight[s] * mid) for s, q, _ in plan) < t else (lo, mid)
        worst = max(worst, *(abs(done[s] - min(q, weight[s] * hi)) for s, q, _ in plan))
    assert worst < 1 + 1e-6


def test_block_size_does_not_grow_and_sources_may_be_many(spark):
    rows = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("host"), F.col("id") % 2000)).alias("source")
    )
    got = M.mix(rows, settings=M.Settings(budget=None))
    told = got.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"))
    assert told.agg(F.max("n"), F.max("slots")).first() == (64, 1)
    assert got.agg(F.countDistinct("position"), F.min("position"), F.max("position")).first() == (60_000, 0, 59_999)
