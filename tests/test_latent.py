import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, latent
from lodestone.plans import registry
from lodestone.plans.engine import Engine, EngineConfig, EngineError

TOPICS = {
    "sea": "whale harbour tide sail anchor reef coral wave".split(),
    "kitchen": "oven flour yeast knead bake crust butter sugar".split(),
    "court": "judge appeal verdict jury counsel plea trial oath".split(),
}


def corpus(n=90, words=4, seed=3):
    """Short texts of one topic each: two texts of a topic often share no word."""
    r = np.random.default_rng(seed)
    names = list(TOPICS)
    return [(i, names[i % 3], " ".join(r.choice(TOPICS[names[i % 3]], words, replace=False))) for i in range(n)]


def plain(texts, features):
    """Unit tf-idf rows and their singular values, by numpy's whole SVD."""
    tf = np.zeros((len(texts), features))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            tf[i, zlib.crc32(w.encode()) % features] += 1
    df = (tf > 0).sum(0)
    idf = np.where(df > 0, 1 + np.log((1 + len(texts)) / (1 + df)), 0)
    a = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    length = np.sqrt((a * a).sum(1, keepdims=True))
    a = a / np.where(length > 0, length, 1)
    return a, np.linalg.svd(a, full_matrices=False)


def test_fit_is_the_svd(spark):
    rows = corpus() + [(90, None, None), (91, None, ""), (92, None, "tide " * 5000)]
    settings = latent.Settings(dimension=5, features=600, extra=19, rounds=5)  # 24 words: the iteration holds them all
    df = spark.createDataFrame(rows, "id int, topic string, text string").repartition(7)
    model = latent.fit(df, settings)
    a, (_, s, vt) = plain([r[2] for r in rows], 600)
    assert np.allclose(model.singular, s[:5], atol=1e-6)
    assert np.allclose(model.vectors.astype(float) @ model.vectors.T, vt[:5].T @ vt[:5], atol=1e-5)
    got = {r["id"]: np.array(r["e"]) for r in df.select("id", model.embed(F.col("text")).alias("e")).collect()}
    want = a @ vt[:5].T
    for i, x in enumerate(want):
        length = np.linalg.norm(x)
        assert np.linalg.norm(got[i]) == pytest.approx(1 if length > 0 else 0, abs=1e-5)
        assert all(got[i] @ got[j] == pytest.approx(x @ want[j] / (length * np.linalg.norm(want[j]) or 1), abs=1e-4) for j in (0, 1, 2, 92))
    again = latent.LatentWords.of(model.table())
    same = {r["id"]: np.array(r["e"]) for r in df.select("id", again.embed(F.col("text")).alias("e")).collect()}
    assert all(np.allclose(got[i], same[i], atol=1e-6) for i in got)


def test_topics_without_shared_words(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id int, topic string, text string")
    model = latent.fit(df, latent.Settings(dimension=3, features=4096))
    e = {r["id"]: np.array(r["e"]) for r in df.select("id", model.embed(F.col("text")).alias("e")).collect()}
    apart = [(i, j) for i, _, x in rows for j, _, y in rows if i < j and i % 3 == j % 3 and not set(x.split()) & set(y.split())]
    assert apart and min(e[i] @ e[j] for i, j in apart) > 0.9
    assert max(e[i] @ e[j] for i in e for j in e if i % 3 != j % 3) < 0.1


def test_small_and_empty(spark):
    none = spark.createDataFrame([], "text string")
    model = latent.fit(none, latent.Settings(dimension=4, features=64))
    assert model.vectors.shape == (64, 4) and not model.vectors.any()
    one = spark.createDataFrame([("a b",), ("a b",), (None,)], "text string")
    model = latent.fit(one, latent.Settings(dimension=4, features=64))
    e = [np.round(r["e"], 5).tolist() for r in one.select(model.embed(F.col("text")).alias("e")).collect()]
    assert e[0] == e[1] and abs(e[0][0]) == 1 and not any(e[0][1:]) and not any(e[2])


def test_semantic_chunks_by_the_model(spark):
    rows = corpus(300, 4)
    model = latent.fit(spark.createDataFrame(rows, "id int, topic string, text string"), latent.Settings(dimension=3, features=4096))
    same = [t for i, topic, t in rows if topic == "sea"][:40]
    other = [t for i, topic, t in rows if topic == "court"][:40]
    docs = spark.createDataFrame([("a", "txt", "\n\n".join(same + other))], "source string, file_type string, text string")
    got = chunking.semantic(docs, embed=model.embed_all).orderBy("chunk_index").collect()
    assert [r["metadata"]["start_paragraph"] for r in got] == [0, 40]
    assert len(chunking.semantic(docs).collect()) > 2  # by shared words neighbours of one topic are unlike


def test_engine_learns_and_stores(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i, topic, text in corpus(30, 5):
        (raw / f"{i}.txt").write_text(text)
    config = EngineConfig(store_path=f"file://{tmp_path}/store")
    made = Engine(spark, config, learned=latent.Settings(dimension=3, features=1024))
    with pytest.raises(EngineError):
        made.embedder
    assert made.build_index(f"file://{raw}") == 30
    again = Engine(spark, config, learned=latent.Settings())  # the stored model counts
    asked = spark.createDataFrame([(1, "whale anchor")], "query_id int, text string")
    ranks = again.trace(asked).where("dense_rank <= 5").join(again.chunks().select(F.substring("chunk_id", 1, 12).alias("chunk"), "text"), "chunk").collect()
    assert len(ranks) == 5 and all(set(r["text"].split()) <= set(TOPICS["sea"]) for r in ranks)
    before = again.store.current()["embedder"]
    again.ingest(spark.createDataFrame([("n.txt", bytearray(b"reef coral"))], "filename string, content binary"))
    assert again.store.current()["embedder"] == before and again.segments.vector_rows().count() == 31
    fresh = Engine(spark, EngineConfig(store_path=f"file://{tmp_path}/other"), learned=latent.Settings(dimension=3, features=256))
    fresh.ingest(spark.createDataFrame([("n.txt", bytearray(b"reef coral"))], "filename string, content binary"))
    assert fresh.embedder.model.dimension == 3 and fresh.segments.vector_rows().count() == 1


def test_query_against_whole_svd(spark, tmp_path):
    docs = [(i, t) for i, _, t in corpus(60, 6)] + [(60, ""), (61, "unseen words only here")]
    asked = [(1, "whale coral unknown"), (2, "judge oath butter"), (3, "nothing known")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in registry.QUERIES["latent_topk"](spark, f"file://{tmp_path}").collect():
        got.setdefault(r["query_id"], {})[r["chunk_id"]] = r["score"]
    size = latent.Settings().features
    a, (_, s, vt) = plain([t for _, t in docs], size)
    vt = vt[s > 1e-9]
    idf = np.zeros(size)
    for w in {w for _, t in docs for w in t.split()}:
        df = sum(w in t.split() for _, t in docs)
        idf[zlib.crc32(w.encode()) % size] = 1 + np.log((1 + len(docs)) / (1 + df))
    held = a @ vt.T
    held /= np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-12)
    for i, t in asked:
        x = np.zeros(size)
        for w in t.split():
            x[zlib.crc32(w.encode()) % size] = idf[zlib.crc32(w.encode()) % size]
        x = vt @ x
        scores = held @ (x / max(np.linalg.norm(x), 1e-12))
        assert sorted(got[i].values()) == pytest.approx(sorted(scores)[-20:], abs=1e-4)
        assert all(scores[d] == pytest.approx(v, abs=1e-4) for d, v in got[i].items())
