import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import language_id as L

WORDS = {"en": "the and of that with from this have there", "fr": "le des est une que dans pour avec été", "de": "der und das nicht ist mit für auf sich", "es": "el los que una por con para está del"}


def corpus(spark, n=240):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 4]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 25)).capitalize() + ".", lang, f"s{i}"))
    rows += [(900, None, "en", "x"), (901, "", "fr", "x"), (902, "12 ?! 34 ²½", "de", "x"), (903, "the of and " * 40000, None, None), (None, "der und das nicht", "de", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_codewords_are_apart():
    assert L.codewords(4).shape == (4, 7)
    for n in (2, 5, 7, 9, 20):
        code = L.codewords(n)
        assert len({tuple(r) for r in code}) == n and set(np.unique(code)) <= {-1, 1}


def test_held_out_accuracy_and_edges(spark):
    docs = corpus(spark)
    rows = {r["doc_id"]: r for r in L.predict(docs, L.fit(docs)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (900, 901, 902))
    assert rows[903]["lang_pred"] == "en" and rows[None]["lang_pred"] == "de"


def test_held_out_rows_and_labels_are_not_inputs(spark):
    docs = corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, L.predict(d, L.fit(d)).where("doc_id is not null").collect())) for d in (docs, changed))
    assert a == b


def test_few_languages_and_no_rows(spark):
    none = corpus(spark).limit(0)
    assert L.fit(none) is None and L.predict(none, None).count() == 0
    one = corpus(spark).where("lang = 'en'")
    assert {r["lang_pred"] for r in L.predict(one.where("text like '%the%'"), L.fit(one)).collect()} == {"en"}


def test_mixed_text_is_ambiguous(spark):
    docs = corpus(spark)
    model = L.fit(docs)
    near = L.decode(model, np.zeros(len(model.bias)))
    assert near[3] and near[2] < model.settings.ambiguous_below


def test_pieces_count_every_ngram_once(monkeypatch):
    """Small pieces give the counts of the whole, also for gaps at their borders."""
    text = "the  cat,  sat 12 on   the mat -- été  " * 30
    whole = sorted(np.concatenate(list(L._hashes(text, L.Settings()))).tolist())
    raw = " ".join(["", *"".join(c if c.isalpha() else " " for c in text).split(), ""]).encode()
    assert len(whole) == sum(len(raw) - n + 1 for n in (1, 2, 3))
    for piece in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(L, "_PIECE", piece)
        assert sorted(np.concatenate(list(L._hashes(text, L.Settings()))).tolist()) == whole


def test_a_repeated_id_does_not_exceed_the_sample(spark):
    docs = corpus(spark).select("doc_id", "text", "lang")
    hot = docs.where("doc_id = 2").crossJoin(spark.range(40_000).drop("id"))
    assert L._sample(docs.unionByName(hot), L.Settings()).count() <= 240


def test_decode_against_plain_code(spark):
    docs = corpus(spark)
    model = L.fit(docs)
    for text in ("the and of", "der und das", "le des est une"):
        counts = {}
        for h in L._hashes(text, model.settings):
            for x in h.tolist():
                counts[x] = counts.get(x, 0) + 1
        n = sum(counts.values())
        bits = [sum((c / n) ** 0.5 * model.weights[k, b] for k, c in counts.items()) + model.bias[b] for b in range(model.codes.shape[1])]
        loss = [sum(model.trust[i, b] * np.log1p(np.exp(-model.codes[i, b] * bits[b])) for b in range(len(bits))) for i in range(4)]
        got = L.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
        assert got["lang_pred"] == model.languages[int(np.argmin(loss))]
