import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.operators import evaluate, rerank, retrieval

TEXTS = ["the cat sat on the mat", "a dog sat", "the cat and the dog", "", "zebra zebra", "a dog sat"]
QUERIES = ["cat dog", "the the zebra", "nothing here", ""]


def chunks(spark):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(TEXTS)], "chunk_id string, text string")


def queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")


def model_scores(query):
    docs = [re.findall(r"\b[\w\-]+\b", t.lower()) for t in TEXTS]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else low for w, v in idf.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in re.findall(r"\b[\w\-]+\b", query)))
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
def test_bm25_fills_with_zeros(spark, k):
    got = retrieval.bm25(retrieval.lexical_index(chunks(spark)), queries(spark), k, fill_zero=True).collect()
    for i, query in enumerate(QUERIES):
        scores = model_scores(query)
        order = sorted(range(len(TEXTS)), key=lambda j: (-round(scores[j], 9), j))[:k]
        rows = sorted((r["rank"], r["chunk_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [r[1] for r in rows] == [f"c{j}" for j in order]
        assert [r[2] for r in rows] == pytest.approx([scores[j] for j in order])


def test_bm25_matches_only_and_filter(spark):
    index = retrieval.lexical_index(chunks(spark))
    rows = retrieval.bm25(index, queries(spark), 10).collect()
    assert {r["query_id"] for r in rows} == {0, 1}
    allowed = chunks(spark).where("chunk_id in ('c2', 'c4')")
    assert {r["chunk_id"] for r in retrieval.bm25(index, queries(spark), 10, where=allowed).collect()} == {"c2", "c4"}


def test_postings_are_made_where_their_block_is(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_tasks", lambda n: 3)
    blocks, _ = retrieval.posting_blocks(chunks(spark))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(block" in plan


@pytest.mark.parametrize("few", [0, 300_000])
def test_search_moves_lists_once_for_all_queries(spark, monkeypatch, few):
    """Found chunks that are few are broadcast, many are joined by their keys: with the same results. Lists are dealt out by block."""
    monkeypatch.setattr(retrieval, "FEW", few)
    monkeypatch.setattr(retrieval, "_tasks", lambda n: 3)
    index, plans, stash = retrieval.written(retrieval.lexical_index(chunks(spark))), {}, retrieval.stash
    monkeypatch.setattr(retrieval, "stash", lambda df, label: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), stash(df, label))[1])
    got = retrieval.bm25(index, queries(spark), 2).collect()
    for i, query in enumerate(QUERIES):
        scores = model_scores(query)
        order = sorted((j for j in range(len(TEXTS)) if set(TEXTS[j].split()) & set(query.split())), key=lambda j: (-round(scores[j], 9), j))[:2]
        assert [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == [f"c{j}" for j in order]
    assert "Exchange hashpartitioning(segment" in plans["candidates"]


def test_what_is_written_leaves_no_shuffle_files(spark):
    """F4 to F25: shuffle files of all steps lay on disk until the driver collected its garbage."""
    import time

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(manager.getAllFiles().mkString("\n").split("\n"))
    before, setting = files(), spark.conf.get(session.CLEANUP, None)
    df = session.stash(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    until = time.time() + 10
    while (left := {f for f in files() - before if "shuffle_" in f}) and time.time() < until:
        time.sleep(0.2)
    assert not left and df.count() == 7 and spark.conf.get(session.CLEANUP, None) == setting


def test_candidates_raise_the_bar(spark, monkeypatch):
    """F4 to F25: with the bar of the rarest words alone nearly every chunk that shares a word was written and completed."""
    rng = np.random.default_rng(4)
    rows = [f"rare{i % 12} filler" for i in range(60)] + [" ".join(f"w{j}" for j in range(40))] * 5
    rows += [" ".join(f"w{j}" for j in rng.choice(40, 8, replace=False)) for _ in range(1000)]
    held = spark.createDataFrame(list(enumerate(rows)), "chunk_id int, text string")
    asked = spark.createDataFrame([(i, " ".join([f"rare{i}", *(f"w{j}" for j in range(40))])) for i in range(12)], "query_id int, text string")
    counted, stash = {}, retrieval.stash
    monkeypatch.setattr(retrieval, "stash", lambda df, label: (out := stash(df, label), counted.update({label: out.count()}))[0])
    index = retrieval.lexical_index(held)
    tell = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    got = tell(retrieval.bm25(index, asked, 5))
    assert counted["candidates-left"] < 0.5 * counted["candidates"]
    assert got == tell(retrieval.top_k(retrieval.bm25_scores(index, asked), 5))


@pytest.mark.parametrize("k", [1, 3])
def test_negative_weights_stay_exact(spark, k):
    """Most words in most chunks: the mean of the raw weights, and so the floor, is negative."""
    rng = np.random.default_rng(9)
    held = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(10) if rng.random() < 0.6 + j / 30)) for i in range(300)], "chunk_id int, text string")
    asked = spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.choice(10, 4))) for i in range(12)], "query_id int, text string")
    index = retrieval.lexical_index(held)
    assert index.terms.where("idf < 0").count()
    tell = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert tell(retrieval.bm25(index, asked, k)) == tell(retrieval.top_k(retrieval.bm25_scores(index, asked), k))


def test_dense_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    held = spark.createDataFrame([(f"v{i:03d}", i, x.tolist()) for i, x in enumerate(v)], "chunk_id string, position int, embedding array<float>")
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(5)], "query_id int, embedding array<float>")
    got = retrieval.dense(held.repartition(3), asked, 4, block=64).collect()
    for q in range(5):
        scores = np.round(v.astype(float) @ v[q].astype(float), 9)
        want = sorted(range(300), key=lambda j: (-scores[j], j))[:4]
        assert [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [f"v{j:03d}" for j in want]
    near = retrieval.near_duplicate(held.where("position > 5"), asked).collect()
    assert {r["query_id"] for r in near if r["is_duplicate"]} == {3}


def test_rrf_ties_follow_first_sight(spark):
    schema = "query_id int, chunk_id string, score double, rank int"
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], schema)
    lexical = spark.createDataFrame([(1, "c", 5.0, 1), (1, "b", 4.0, 2)], schema)
    rows = retrieval.hybrid(lexical, dense).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["b", "a", "c"]
    assert rows[0]["score"] == pytest.approx(2 / 62)
    assert rows[0]["sources"]["dense"]["rank"] == 2 and set(rows[2]["sources"]) == {"bm25"}


def candidates(spark):
    rows = [(1, "red fox", "a", "a red fox", 0.1, 1), (1, "red fox", "b", "nothing", 0.1, 2), (1, "red fox", "c", "fox", 0.1, 3)]
    return spark.createDataFrame(rows, "query_id int, question string, chunk_id string, text string, retrieval_score double, retrieval_rank int")


def test_rerankers(spark):
    assert [r["chunk_id"] for r in rerank.cross_encode(candidates(spark), 2).orderBy("final_rank").collect()] == ["a", "c"]
    rows = rerank.rank_fusion(candidates(spark)).orderBy("final_rank").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "c", "b"]
    assert rows[1]["final_score"] == pytest.approx(0.5 / 63 + 0.5 / 62)
    with pytest.raises(ValueError):
        rerank.cross_encode(candidates(spark), 0)
    with pytest.raises(ValueError):
        rerank.rank_fusion(candidates(spark), retrieval_weight=0, reranker_weight=0)
    with pytest.raises(Exception, match="blank"):
        rerank.cross_encode(candidates(spark).withColumn("question", F.lit(" "))).collect()


def test_set_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, chunk_id string, rank int")
    expected = spark.createDataFrame([(1, ["b", "z"]), (2, ["y"]), (3, ["q"])], "query_id int, expected array<string>")
    rows = {r["query_id"]: r for r in evaluate.evaluate_retrieval(ranking, expected, 2).collect()}
    assert (rows[1]["hit"], rows[1]["recall"], rows[1]["precision"], rows[1]["mrr"]) == (1.0, 0.5, 0.5, 0.5)
    assert all(rows[q][m] == 0 for q in (2, 3) for m in ("hit", "recall", "precision", "mrr"))
    with pytest.raises(Exception, match="empty"):
        evaluate.means(evaluate.evaluate_retrieval(ranking, expected.limit(0))).collect()


def test_judged_metrics_by_hand(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, chunk_id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (1, "d", 1), (2, "x", 1)], "query_id int, doc_id string, score int")
    rows = {r["query_id"]: r for r in evaluate.judged_metrics(ranking, qrels, 3).collect()}
    ideal = 3 + 1 / math.log2(3) + 1 / 2
    assert rows[1]["ndcg"] == pytest.approx((3 / math.log2(3) + 1 / 2) / ideal)
    assert rows[1]["map"] == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert rows[1]["precision"] == pytest.approx(2 / 3) and rows[1]["mrr"] == 0.5
    assert rows[2]["ndcg"] == rows[2]["map"] == 0


def test_rank_movements(spark):
    schema = "query_id int, chunk_id string, rank int"
    before = spark.createDataFrame([(1, "a", 8), (2, "b", 2), (4, "d", 3)], schema)
    after = spark.createDataFrame([(1, "a", 2), (2, "b", 9), (3, "c", 1)], schema)
    expected = spark.createDataFrame([(i, [x]) for i, x in enumerate("abcd", 1)], "query_id int, expected array<string>")
    rows = {r["query_id"]: r for r in evaluate.rank_movements(before, after, expected).collect()}
    assert (rows[1]["kind"], rows[1]["movement"], rows[1]["rescued"]) == ("improvement", 6, True)
    assert (rows[2]["kind"], rows[2]["pushed_out"]) == ("regression", True)
    assert rows[3]["kind"] == "candidate_miss" and rows[4]["kind"] == "regression"


def test_evidence(spark):
    cases = spark.createDataFrame(
        [("q", [("docs/A.md", "X > y"), ("b.md", None)], [("docs/a.md", None, "Some  Text")]), ("none", [], [])],
        "id string, expected_sources array<struct<document:string,section:string>>, evidence_spans array<struct<document:string,section:string,text:string>>",
    )
    chunks = spark.createDataFrame(
        [("q", 1, "other", "data/docs/a.md", "z"), ("q", 2, "has some text here", "data/docs/a.md", "x > Y"), ("q", 3, "t", "ab.md", "")],
        "id string, rank int, text string, source string, section string",
    )
    rows = {r["id"]: r for r in evaluate.evidence(cases, chunks).collect()}
    assert (rows["q"]["source_recall"], rows["q"]["evidence_recall"], rows["q"]["first_relevant_rank"], rows["q"]["mrr"]) == (0.5, 1.0, 2, 0.5)
    assert rows["none"]["source_recall"] is None and rows["none"]["hit"] is None and rows["none"]["mrr"] is None
