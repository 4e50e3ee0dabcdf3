import json

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.identity import chunk_id
from lodestone.plans.engine import Engine, EngineConfig, EngineError, Timer
from lodestone.plans.store import Store, append_results, complete, merge_existing_wins, merge_new_wins
from lodestone.sources import files, tables
from lodestone.streaming import ingest

GUIDE = "# Guide\nThe cache is warm.\n## Tokens\nA token expires after seven days. Renew it early."


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "guide.md").write_text(GUIDE)
    (raw / "note.txt").write_bytes(b"Zebras have stripes.\r\n\r\nLions roar loudly.")
    (raw / "page.htm").write_text("<p>Whales sing songs.</p><script>x</script>")
    (raw / "skip.csv").write_text("a,b")
    return raw


def engine(spark, tmp_path):
    return Engine(spark, EngineConfig(store_path=f"file://{tmp_path}/store"))


def test_build_and_ask(spark, tmp_path, folder):
    e = engine(spark, tmp_path)
    asked = spark.createDataFrame([(1, "When does a token expire?"), (2, "zebras stripes")], "query_id int, text string")
    with pytest.raises(EngineError):
        e.ask(asked)
    assert e.build_index(f"file://{folder}") == 4
    rows = {r["filename"]: r for r in e.list_documents().collect()}
    assert rows["guide.md"]["chunk_count"] == 2 and rows["guide.md"]["chunking_strategy"] == "structure"
    assert rows["page.htm"]["file_type"] == "htm"
    assert e.chunks().where("source like '%page.htm'").first()["file_type"] == "html"
    assert complete(e.store.read("vectors"), e.chunks())
    found = {r["query_id"]: r for r in e.ask(asked).collect()}
    assert found[1]["blocks"][0]["text"].startswith("A token expires") and found[1]["answer"].startswith("A token expires after seven days [1].")
    assert found[2]["blocks"][0]["text"].startswith("Zebras")
    assert found[1]["decision"] in ("ACCEPT", "ACCEPT_WITH_WARNING", "ABSTAIN")
    assert e.trace(asked).where("rank = 1").count() == 2
    with pytest.raises(Exception, match="blank"):
        e.ask(spark.createDataFrame([(1, " ")], "query_id int, text string")).collect()


def test_ingest(spark, tmp_path, folder):
    e = engine(spark, tmp_path)
    e.build_index(f"file://{folder}")
    new = spark.createDataFrame([("dir/new.md", bytearray(b"# N\nPenguins swim fast.")), ("again.txt", bytearray((folder / "note.txt").read_bytes()))], "filename string, content binary")
    got = {r["filename"]: r["duplicate"] for r in e.ingest(new).collect()}
    assert got == {"note.txt": True} | {n: False for n in got if n.endswith("_new.md")} and len(got) == 2
    assert e.chunks().count() == 5
    assert e.lexical_index().stats.first()["n"] == 5
    asked = spark.createDataFrame([(1, "penguins swim")], "query_id int, text string")
    assert e.retrieve(asked).orderBy("rank").first()["chunk_id"] == e.chunks().where("text like 'Penguins%'").first()["chunk_id"]
    before = e.store.current()
    for bad in (("x.exe", bytearray(b"x")), ("x.md", bytearray(b""))):
        with pytest.raises(files.SourceError):
            e.ingest(spark.createDataFrame([bad], "filename string, content binary"))
    assert e.store.current() == before
    assert e.bootstrap_registry(f"file://{folder}").count() == 4


def test_stream(spark, tmp_path, folder):
    e = engine(spark, tmp_path)
    ingest.start(e, f"file://{folder}", f"{tmp_path}/cp").awaitTermination(120)
    assert e.list_documents().count() == 3
    ingest.start(e, f"file://{folder}", f"{tmp_path}/cp").awaitTermination(120)
    assert e.list_documents().count() == 3


def test_load_errors(spark, tmp_path, folder):
    with pytest.raises(FileNotFoundError):
        files.load(spark, f"file://{tmp_path}/none.md")
    with pytest.raises(files.SourceError):
        files.load(spark, f"file://{folder}")
    with pytest.raises(files.SourceError):
        files.load(spark, f"file://{folder}/skip.csv")
    row = files.load(spark, f"file://{folder}/note.txt", "data/note.txt").first()
    assert row["text"] == "Zebras have stripes.\n\nLions roar loudly." and row["source"] == "data/note.txt"


def test_json_sources(spark, tmp_path):
    path = tmp_path / "chunks.jsonl"
    base = {"text": "t", "source": "s", "file_type": "md", "chunk_index": 0, "chunking_strategy": "fixed", "metadata": {}}
    path.write_text(json.dumps(base) + "\n\n")
    row = tables.chunk_store(spark, f"file://{path}").first()
    assert row["chunk_id"] == spark.range(1).select(chunk_id(F.lit("s"), F.lit(0), F.lit("t"))).first()[0]
    path.write_text(json.dumps(base | {"chunk_id": "wrong"}))
    with pytest.raises(Exception, match="does not match"):
        tables.chunk_store(spark, f"file://{path}").collect()
    path.write_text("{broken")
    with pytest.raises(Exception, match="invalid JSON"):
        tables.chunk_store(spark, f"file://{path}").collect()
    assert tables.chunk_store(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.case_results(spark, f"file://{tmp_path}/none")


def test_golden_and_qrels(spark, tmp_path):
    path = tmp_path / "golden.json"
    good = {"id": "a", "question": "q", "answerable": False, "answerability_type": "unanswerable_clear"}
    path.write_text(json.dumps([good]))
    assert tables.golden_cases(spark, f"file://{path}").count() == 1
    path.write_text(json.dumps([good, good | {"question": " "}, {"id": "b", "question": "q", "answerable": True}]))
    with pytest.raises(ValueError, match="not unique"):
        tables.golden_cases(spark, f"file://{path}")
    qrels = tmp_path / "q.tsv"
    qrels.write_text("query-id\tcorpus-id\tscore\n1\td\t1\n1\td\t2\n2\te\t1\n")
    rows = tables.qrels(spark, f"file://{qrels}")
    assert {(r["query_id"], r["doc_id"], r["score"]) for r in rows.collect()} == {("1", "d", 2), ("2", "e", 1)}
    corpus = tables.beir_corpus(spark.createDataFrame([("d", " T ", " b "), ("x", "", "b")], schemas.of("BEIR_DOC")))
    assert [r["text"] for r in corpus.orderBy("doc_id").collect()] == ["T\n\nb", "b"]
    asked = tables.beir_queries(spark.createDataFrame([("1", " q ")], schemas.of("BEIR_QUERY")))
    lost = tables.missing_references(rows, asked, corpus)
    assert {tuple(r) for r in lost.collect()} == {("query", "2"), ("document", "e")}


def test_store_and_logs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit({"a": spark.range(3)})
    store.commit({"a": store.read("a").where("id > 0"), "b": spark.range(1)})
    assert store.read("a").count() == 2 and store.read("b").count() == 1
    old = spark.createDataFrame([("x", 1), ("y", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("y", 2), ("z", 2)], "chunk_id string, v int")
    assert sorted(map(tuple, merge_new_wins(old, new).collect())) == [("x", 1), ("y", 2), ("z", 2)]
    assert sorted(map(tuple, merge_existing_wins(old, new).collect())) == [("x", 1), ("y", 1), ("z", 2)]
    log = f"file://{tmp_path}/log"
    assert tables.completed_cases(spark, log).count() == 0
    append_results(spark.createDataFrame([("a",), ("b",)], "case_id string"), log)
    append_results(spark.createDataFrame([("b",), ("",)], "case_id string"), log)
    assert sorted(r[0] for r in tables.completed_cases(spark, log).collect()) == ["a", "b"]


def test_timer():
    timer = Timer()
    assert timer.average_ms == 0.0
    assert timer.run(lambda: 5) == 5 and timer.average_ms > 0
