import math
import zlib

import xxhash
from pyspark.sql import functions as F

from lodestone.llm.shard_tree import Tree, assign, place


def model(tree, key):
    """The descent in plain Python."""

    def winner(weights, path):
        draws = []
        for i, w in enumerate(weights):
            if w > 0:
                bits = xxhash.xxh64_intdigest(f"{path}:{i}:{key}".encode(), 42) >> 11
                draws.append((-math.log((bits + 0.5) / 2**53) / w, i))
        return min(draws)[1]

    r = winner([sum(map(sum, x)) for x in tree.regions], "region")
    k = winner([sum(x) for x in tree.regions[r]], f"rack:{r}")
    s = winner(tree.regions[r][k], f"shard:{r}:{k}")
    return sum(len(x) for reg in tree.regions[:r] for x in reg) + sum(len(x) for x in tree.regions[r][:k]) + s


def test_descent_is_the_models(spark):
    tree = Tree((((1.0, 2.0), (0.5,)), ((3.0,), (1.0, 0.0, 1.0))))
    rows = place(spark.range(500), F.col("id"), tree).collect()
    assert [r["shard"] for r in rows] == [model(tree, r["id"]) for r in rows]
    assert 5 not in {r["shard"] for r in rows}  # its weight is 0


def test_growth_moves_rows_into_the_new_shard_only(spark):
    tree = Tree.even()
    for _ in range(3):
        new = tree.grown()
        rows = place(place(spark.range(3000), F.col("id"), tree), F.col("id"), new, "n_").collect()
        moved = [r for r in rows if r["shard"] != r["n_shard"]]
        assert moved and all(r["n_shard"] == tree.shards for r in moved)
        tree = new


def test_weights_move_rows_within_their_subtree_path(spark):
    """A heavier shard draws rows into its region; regions that keep their weights lose, never swap, rows."""
    a = Tree((((1.0,) * 2, (1.0,) * 2), ((1.0,) * 2, (1.0,) * 2)))
    b = Tree((((1.0,) * 2, (1.0,) * 2), ((1.0,) * 2, (1.0, 3.0))))
    rows = place(place(spark.range(3000), F.col("id"), a), F.col("id"), b, "n_").collect()
    assert all(r["n_region"] == 1 for r in rows if r["region"] != r["n_region"])
    assert all(r["shard"] == r["n_shard"] for r in rows if r["n_region"] == 0)
    share = sum(r["n_shard"] == 7 for r in rows) / len(rows)
    assert abs(share - 3 / 10) < 0.05


def test_assignment(spark):
    rows = [(i, f"té{i}" * (i % 9)) for i in range(400)] + [(7, "again"), (7, "again"), (None, None), (500, None), (501, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as slot")
    got = assign(docs, Tree.even()).collect()
    assert len(got) == len(rows)
    want = sorted(((-1 if i is None else i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert assign(docs.limit(0), Tree.even()).count() == 0


def test_one_hot_key_gets_gapless_slots(spark):
    docs = spark.range(5000).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("text"))
    slots = sorted(r["slot"] for r in assign(docs, Tree.even()).collect())
    assert slots == list(range(5000))
