"""Vector collections, commits, broken files and judgments, cosine search, latency."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import models, schemas
from lodestone.operators import evaluate, retrieval
from lodestone.plans.store import CommitConflict, Store, vector_index
from lodestone.sources import files, tables

VECTORS = "chunk_id string, embedding array<double>"


def test_collections(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    schema = spark.createDataFrame([], VECTORS).schema
    store.create("vectors", schema, 2)
    assert store.read("vectors").count() == 0
    store.commit({"vectors": spark.createDataFrame([("a", [1.0, 2.0])], VECTORS)})
    store.create("vectors", schema, 2)
    assert store.read("vectors").count() == 1
    with pytest.raises(ValueError, match="dimensions"):
        store.create("vectors", schema, 3)
    store.reset("vectors", schema)
    assert store.read("vectors").count() == 0 and store.clean() == 2 and store.read("vectors").count() == 0


def test_vectors_are_used_again_or_built(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    make = lambda df: df.withColumn("embedding", F.array(F.lit(1.0)))
    assert vector_index(store, chunks, make) and not vector_index(store, chunks, make)
    assert vector_index(store, chunks, make, rebuild=True)
    more = chunks.unionByName(spark.createDataFrame([("c",)], "chunk_id string"))
    assert vector_index(store, more, make) and store.read("vectors").count() == 3
    with pytest.raises(RuntimeError, match="were written for"):
        vector_index(store, more, lambda df: make(df).limit(1), rebuild=True)


def test_a_commit_between_is_seen(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    table = spark.createDataFrame([(1,)], "x int")
    one.commit({"a": table})

    class Slow(dict):
        def items(self):
            yield "b", table
            two.commit({"c": table})

    with pytest.raises(CommitConflict):
        one.commit(Slow())
    assert set(one.current()) == {"a", "c"}


def test_ingest_adds_parts_and_compacts(spark, tmp_path):
    from lodestone.plans.engine import Engine, EngineConfig

    e = Engine(spark, EngineConfig(store_path=f"file://{tmp_path}/s", many_parts=3))
    upload = lambda name, text: spark.createDataFrame([(name, bytearray(text.encode()))], "filename string, content binary")
    for i, parts in enumerate((1, 2, 1, 2)):
        e.ingest(upload(f"{i}.txt", f"file number {i} about herons"))
        assert e.store.parts("blocks") == parts and e.chunks().count() == i + 1 == e.lexical_index().stats.first()["n"]
    assert e.lexical_index().terms.where("term = 'herons'").first()["df"] == 4 and e.list_documents().count() == 4
    again = e.chunks().limit(1).withColumn("text", F.lit("another text"))
    e._add(again, e.registry().limit(0))
    assert e.chunks().count() == 4 and e.lexical_index().terms.where("term = 'herons'").first()["df"] == 3
    found = e.retrieve(spark.createDataFrame([(1, "another text")], "query_id int, text string")).where("rank = 1").first()
    assert found["chunk_id"] == again.first()["chunk_id"]


def test_broken_lines_have_numbers(spark, tmp_path):
    path = tmp_path / "chunks.jsonl"
    path.write_text('{"text": "a", "source": "s", "chunk_index": 0}\n\n{"text": oops}\n{"text": "b"\n')
    assert tables.broken_line(spark, f"file://{path}", schemas.of("CHUNK")) == (3, '{"text": oops}')
    with pytest.raises(ValueError, match="line 3"):
        tables.chunk_store(spark, f"file://{path}")
    path.write_text('{"text": "a", "source": "s", "chunk_index": 0}\n')
    assert tables.chunk_store(spark, f"file://{path}").count() == 1


def test_broken_judgments_raise(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d9", 1), ("q3", "d8", 1)], "query_id string, doc_id string, score int")
    queries = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    corpus = spark.createDataFrame([("d1",)], "doc_id string")
    with pytest.raises(RuntimeError, match="2 judged document.*'d8'.*1 judged query.*'q3'"):
        tables.check_benchmark(qrels, queries, corpus)
    tables.check_benchmark(qrels.limit(1), queries, corpus)


def test_cosine_of_any_vectors(spark):
    rows = [(1, [3.0, 0.0]), (2, [0.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [5.0, 5.0])]
    held = spark.createDataFrame([(i, i, v) for i, v in rows], "chunk_id int, position int, embedding array<double>")
    asked = spark.createDataFrame([(1, [9.0, 0.0]), (2, None)], "query_id int, embedding array<double>")
    got = [(r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in retrieval.dense(held, asked, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (1, 5, 0.707107), (1, 2, 0.0), (1, 4, 0.0)]


def test_hashed_words_of_a_batch():
    made = models.hashed_words(pd.Series(["One two two", None, "", "two-fold one"]), 64)
    alone = [models.hashed_words(pd.Series([t]), 64)[0] for t in ("One two two", None, "", "two-fold one")]
    assert np.allclose(made, alone) and np.allclose(np.linalg.norm(made, axis=1), [1, 0, 0, 1])
    assert models.hashed_words(pd.Series([], dtype=object), 8).shape == (0, 8)


def test_latency_of_architectures(spark):
    queries = spark.createDataFrame([("q1", "x"), ("q2", "y")], "query_id string, text string")
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 1)], "query_id string, doc_id string, score int")
    ranking = spark.createDataFrame([("q1", "d1", 0.9, 1), ("q1", "d1", 0.8, 2), ("q1", "d3", 0.7, 3), ("q2", "d3", 0.7, 1)], "query_id string, chunk_id string, score double, rank int")
    scores, took = evaluate.evaluate_architecture(lambda q: ranking, queries, qrels)
    assert took > 0 and {r["query_id"]: r["ndcg"] for r in scores.collect()} == {"q1": 1.0, "q2": 0.0}
    table = evaluate.compare({"a": scores, "b": scores}, latency_ms={"a": 10.0, "b": 35.0})
    assert {r["architecture"]: r["mean_latency_ms"] for r in table.collect()} == {"a": 10.0, "b": 35.0}
    assert evaluate.latency_changes(table, "a", "b").first()["added_ms"] == 25.0
    none, zero = evaluate.evaluate_architecture(lambda q: ranking.limit(0), queries.limit(0), qrels)
    assert zero == 0.0


def test_pdf_pages(spark, tmp_path, monkeypatch):
    """Without a reader a PDF is an error that says so; with one, each page with text is a document."""
    path = tmp_path / "two.pdf"
    path.write_bytes(b"%PDF page one|  |page three")
    rows = files.scan(spark, f"file://{tmp_path}")
    with pytest.raises(Exception, match="(?i)pdf"):
        files.documents(rows).collect()
    import textwrap

    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "pypdf.py").write_text(textwrap.dedent("""
        class _Page:
            def __init__(self, text): self._text = text
            def extract_text(self): return self._text
        class PdfReader:
            def __init__(self, stream): self.pages = [_Page(t.decode()) for t in stream.read().removeprefix(b"%PDF ").split(b"|")]
    """))
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "pypdf.py"))
    got = files.documents(files.scan(spark, f"file://{tmp_path}")).orderBy("metadata.page_number").collect()
    assert [(r["text"], r["metadata"]["page_number"], r["metadata"]["page_count"]) for r in got] == [("page one", 1, 3), ("page three", 3, 3)]


def test_readable_rows(spark):
    rows = spark.createDataFrame([(1, 0.5, None, "x" * 600)], "rank int, score double, heading string, text string")
    assert evaluate.described(rows, ("rank", "score", "heading"), "text").first()["lines"] == "rank: 1\nscore: 0.5\n\n" + "x" * 500
    result = spark.createDataFrame([{"case_id": "c1", "expected_answerable": True, "should_abstain": True, "decision": "ABSTAIN"}], schemas.of("CASE_RESULT"))
    said = evaluate.case_summaries(result).first()["summary"]
    assert said.startswith("case_id: c1\n") and said.endswith("failures: FALSE_ABSTENTION")
