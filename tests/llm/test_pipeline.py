import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as C


@pytest.fixture
def folder(spark, tmp_path):
    words = [f"word{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(words[(i * 7 + j * (3 + i % 11)) % 150] for j in range(60))
        if i % 10 == 0:
            text = " ".join(w if j % 6 else "vile" for j, w in enumerate(text.split()))
        if i % 10 == 1:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "en", f"s{i % 3 if i % 2 else 0}", len(text)))
        labels.append((i, int(i % 10 != 1), int(i % 10 == 0)))
    rows += [(1000 + i, rows[3][1], "en", "s0", 1) for i in range(30)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
    ids = set(range(400))
    assert kept["toxicity"] & ids == {i for i in ids if i % 10}
    assert kept["quality"] & ids == {i for i in ids if i % 10 > 1}
    assert not kept["simhash"] & set(range(1000, 1030)) and 3 in kept["simhash"]
    assert len(kept["mixing"]) <= len(kept["simhash"]) and kept["mixing"] <= kept["simhash"]
    pieces = C.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == kept["mixing"]


def test_registered():
    assert set(C.QUERIES) <= set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in __spark_entry__.queries() if k.startswith("op")}


def test_mixing_keeps_equal_rows_together(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(50)
    twice = docs.unionByName(docs)
    got = C.mix_sources(spark, twice, folder).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r["n"] for r in got} == {2}


def test_mixing_keeps_all_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted(C.mix_sources(spark, docs, folder).collect(), key=str) == sorted(docs.collect(), key=str)


def test_sequences_follow_the_mix(spark, folder, tmp_path):
    """packing did not read the order of its documents, so mixing changed nothing."""
    pytest.importorskip("public_tokenizers")
    rows = [(i, " ".join(["the"] * (2100 + i)), "en", f"s{min(i % 7, 2)}", 1) for i in range(21)]  # no two fit in a sequence
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{folder}/documents.parquet").schema)
    orders = []
    for name, ordered in (("mix", C.mix_sources(spark, docs, folder)), ("back", docs.repartition(3).orderBy(F.desc("doc_id")))):
        ordered.write.parquet(f"{tmp_path}/{name}")
        packed = C.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/{name}"), folder).collect()
        orders.append([r["doc_id"] for r in sorted(packed, key=lambda r: r["sequence_id"])])
        assert len({r["sequence_id"] for r in packed}) == len(packed) == len(rows)
        if name == "mix":
            mixed = [r["doc_id"] for r in ordered.collect()]
    assert orders == [mixed, list(range(20, -1, -1))] and mixed != sorted(mixed)


def test_run_against_plain_code(spark, folder):
    """Every stage recomputed row by row: models on each text alone, near copies from all pairs, pieces from the tokenizer."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import zlib

    from lodestone.llm import ordinal, packing, quality, toxicity

    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    bad, good = toxicity.fit(docs, labels), quality.fit(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if ordinal.tails(bad, [t])[0, 0] < toxicity.Settings().reject_from}
    kept = {i: t for i, t in kept.items() if ordinal.tails(good, [t])[0, 0] >= quality.Settings().keep_from}
    sets = {i: (lambda w: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split()) for i, t in kept.items()}
    low = {i: i for i in kept}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in sorted(kept):
        for j in sorted(kept):
            common = len(sets[i] & sets[j])
            if j < i and (sets[i] == sets[j] or common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    encode, want = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 1000).ids, set()
    for i in {find(i) for i in kept}:
        ids = encode(kept[i]) + (1).to_bytes(4, "little")
        want |= {(i, k // 16384, k // 4, len(ids[k : k + 16384]) // 4, zlib.crc32(ids[k : k + 16384])) for k in range(0, len(ids), 16384)}
    got = C.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert len({r["sequence_id"] for r in got}) == -(-sum(r["length"] for r in got) // 4096)


def test_empty_tables_and_no_labels(spark, folder, tmp_path):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    for name, d, n in (("a", docs.limit(0), 0), ("b", docs.where("doc_id < 30"), 30)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert C.run(spark, f"{tmp_path}/{name}").select("doc_id").distinct().count() <= n
        for _, stage in C.STAGES[:2]:
            assert stage(spark, spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), f"{tmp_path}/{name}").count() == n


def test_clashing_columns_pass_through(spark, folder):
    names = ("_tails", "_grade", "fp", "node", "root", "slot", "position", "quota", "row", "kept_id", "first", "source_rank", "component_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
