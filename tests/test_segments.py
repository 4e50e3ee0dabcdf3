"""Indexes that grow by segments: equal to one that is built at once, without reading old postings."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import retrieval
from lodestone.plans.segments import Segments
from lodestone.plans.store import CommitConflict, Store

SCHEMA = "chunk_id string, text string"
WORDS = "the of a red fox dog cat sat mat zebra heron token seven".split()


def texts(seed, ids):
    rng = random.Random(seed)
    return [(f"c{i:03d}", " ".join(rng.choices(WORDS, range(len(WORDS), 0, -1), k=rng.randint(0, 15)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def segments(spark, path, fanout=3):
    make = lambda df: df.select("chunk_id", F.array(F.length("text").cast("double")).alias("embedding"))
    return Segments(Store(spark, f"file://{path}"), StructType.fromDDL(SCHEMA), make, fanout=fanout)


def same(spark, index, rows, search=True):
    """The merged index equals that of all rows."""
    whole = retrieval.lexical_index(frame(spark, rows))
    merged = index.index()
    tell = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert tell(merged.terms, "term", "df", F.round("idf", 9)) == tell(whole.terms, "term", "df", F.round("idf", 9))
    assert tell(merged.stats, "n", F.round("avgdl", 9)) == tell(whole.stats, "n", F.round("avgdl", 9))
    assert tell(merged.postings, "term", "chunk_id", "tf", "dl") == tell(whole.postings, "term", "chunk_id", "tf", "dl")
    assert tell(index.chunks(), "chunk_id", "text") == sorted(rows)
    assert tell(index.vector_rows(), "chunk_id", F.col("embedding")[0]) == sorted((c, float(len(t))) for c, t in rows)
    if not search:
        return
    asked = spark.createDataFrame([(1, "red fox"), (2, "the zebra of the heron"), (3, "none")], "query_id int, text string")
    rank = lambda i: tell(retrieval.bm25(i, asked, 5, fill_zero=True), "query_id", "rank", "chunk_id", F.round("score", 9))
    assert rank(merged) == rank(whole)


def test_segments_equal_one_index(spark, tmp_path):
    index, have = segments(spark, tmp_path), {}
    for step, ids in enumerate((range(40), range(40, 50), [3, 4, 45, 60], [3, 61, 62])):
        rows = texts(step, ids)
        rows = [*dict(rows).items()] if step < 3 else [*dict(rows).items(), *list(dict(rows).items())[1:2]]  # one twice
        index.add(frame(spark, rows))
        have |= dict(rows)
    before = len(index.names())
    index.merge(index.names()[1:3])  # one with removed chunks of another
    assert len(index.names()) == before - 1
    same(spark, index, [*have.items()])
    index.merge(index.names())
    assert len(index.names()) == 1 and index.removed().count() == 0
    same(spark, index, [*have.items()], search=False)
    index.build_vectors()
    index.add(frame(spark, [("c000", "new"), ("c999", None)]))
    index.merge(index.names())
    assert index.chunks().where("chunk_id = 'c000'").first()["text"] == "new" and index.vector_rows().count() == len(have) + 1


def test_an_addition_reads_no_old_posting(spark, tmp_path):
    index = segments(spark, tmp_path / "s")
    first, more = texts(1, range(30)), texts(2, range(25, 40))
    index.add(frame(spark, first))
    os.rename(tmp_path / "s/blocks", tmp_path / "hidden")
    index.add(frame(spark, more))
    for part in os.listdir(tmp_path / "hidden"):
        os.rename(tmp_path / "hidden" / part, tmp_path / "s/blocks" / part)
    same(spark, index, [*(dict(first) | dict(more)).items()], search=False)


def test_segments_leave_no_blocks_in_the_shared_folder(spark, tmp_path, monkeypatch):
    """each addition and merge left a second copy of its blocks."""
    from lodestone import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    index = segments(spark, tmp_path / "s")
    for step in range(2):
        index.add(frame(spark, texts(step, range(step * 20, step * 20 + 25))))
    index.merge(index.names())
    assert not [n for n in os.listdir(tmp_path / "shared") if n.startswith("blocks")]


def test_full_blocks_are_merged_whole(spark, tmp_path, monkeypatch):
    """a merge dealt out every posting again, in shuffles of five times the input."""
    monkeypatch.setattr(retrieval, "BLOCK_CHUNKS", 4)
    index, have = segments(spark, tmp_path), {}
    for step, ids in enumerate((range(40), range(40, 70), [3, 4, 45, *range(70, 90)])):
        rows = dict(texts(step, ids))
        index.add(frame(spark, [*rows.items()]))
        have |= rows

    def fail(*_):
        raise AssertionError("postings were dealt out")

    with monkeypatch.context() as m:
        m.setattr(retrieval, "_blocks", fail)
        index.merge(index.names()[:2])
    same(spark, index, [*have.items()])
    bounds = index.store.read("blocks").select(F.array_max("list.tf") == F.col("max_tf"), F.array_min("list.dl") == F.col("min_dl"))
    assert {tuple(r) for r in bounds.distinct().collect()} == {(True, True)}
    assert index.store.read("corpus").groupBy("segment", "block").count().agg(F.max("count")).first()[0] < 30


def test_tiers(spark, tmp_path):
    index = segments(spark, tmp_path, fanout=2)
    for i in range(5):
        index.add(frame(spark, texts(i, [i])))
        index.compact()
        assert len(index.names()) == [1, 1, 2, 1, 2][i]
    assert index.index().stats.first()["n"] == 5


def test_of_two_commits_from_one_state_one_fails(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    table = spark.createDataFrame([(1,)], "x int")
    for turn in range(3):
        stores = [Store(spark, f"file://{tmp_path}/{turn}") for _ in range(4)]
        stores[0].commit({"a": table})

        def work(i, stores=stores):
            try:
                stores[i]._publish(2, {"a": [f"{i}"]})
                return 1
            except CommitConflict:
                return 0

        with ThreadPoolExecutor(4) as pool:
            assert sum(pool.map(work, range(4))) == 1
        assert stores[0].version() == 2
    with pytest.raises(CommitConflict):
        stores[0].commit({"b": table}, base=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_search_is_exact(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(f"c{i:04d}", " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(1500)]
    rows += [(f"d{i:04d}", rows[i][1]) for i in range(200)]  # ties
    index = retrieval.lexical_index(frame(spark, rows))
    asked = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 12)))) for i in range(25)], "query_id int, text string")
    tell = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    whole = lambda scores, k: retrieval.top_k(scores, k)
    for k in (1, 5):
        assert tell(retrieval.bm25(index, asked, k)) == tell(whole(retrieval.bm25_scores(index, asked), k))
    some = frame(spark, rows).where("chunk_id like '%7'")
    allowed = retrieval.bm25_scores(index, asked).join(some.select("chunk_id"), "chunk_id", "left_semi")
    assert tell(retrieval.bm25(index, asked, 5, where=some)) == tell(whole(allowed, 5))


def test_frequent_words_are_read_in_part(spark, monkeypatch):
    """Four times the chunks: the postings that a search opens grow less than those that its words have."""

    def reads(n):
        rng = random.Random(5)
        rows = [(f"c{i:05d}", " ".join(["the"] * rng.randint(1, 3) + [f"x{rng.randint(0, n // 12)}" for _ in range(20)])) for i in range(n)]
        index = retrieval.lexical_index(frame(spark, rows))
        asked = spark.createDataFrame([(i, f"the x{i} x{i + 1}") for i in range(5)], "query_id int, text string")
        found = retrieval.postings_opened(index, asked, 3).agg(F.sum("listed"), F.sum("opened")).first()
        return found[0], found[1]

    monkeypatch.setattr(retrieval, "BLOCK_CHUNKS", 16)
    (listed, opened), (listed4, opened4) = reads(2000), reads(8000)
    assert listed4 > 3 * listed and opened4 < 2.5 * opened and opened4 < 0.6 * listed4, (listed, opened, listed4, opened4)
