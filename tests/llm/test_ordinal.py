import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import features, ordinal, quality, toxicity


def corpus(spark, n=600):
    rng = np.random.default_rng(5)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        toxic, good = i % 5 == 0, i % 7 != 0
        if toxic:
            for j in range(int(rng.integers(2, 12))):
                words[j * 3] = str(rng.choice(["awful", "nasty", "vile"]))
        if not good:
            words = [w.upper() + "$$$" for w in words]
        rows.append((i, " ".join(words), "keep"))
        labels.append((i, int(good), int(toxic)))
    rows += [(9000, None, "a"), (9001, "", "b"), (None, "word1 vile nasty vile awful vile nasty", "c"), (3, rows[3][1], "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tails string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    assert len(model.grades) >= 3 and (np.diff(model.thresholds) > 0).all()
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    right = np.mean([r["rejected"] == bool(r["toxic"]) for r in rows])
    assert right >= 0.97
    by = {}
    for r in rows:
        by.setdefault(r["severity"], []).append(r["expected_severity"])
    means = [np.mean(by[g]) for g in sorted(by)]
    assert means == sorted(means)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 9000 in ids and 9001 in ids and None not in ids and ids.count(3) == 2


def test_quality(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels)
    assert model.grades == (0, 1, 2)
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r["selected"] == bool(r["quality"]) for r in rows]) >= 0.97
    assert all(0 <= r["expected_grade"] <= 2 for r in rows)
    assert quality.selected(docs, model).columns == docs.columns


def test_no_labels_change_nothing(spark):
    docs, labels = corpus(spark, 20)
    for marks in (labels.limit(0), labels.withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1))):
        assert toxicity.fit(docs, marks) is None and quality.fit(docs, marks) is None
    assert toxicity.accepted(docs, None).count() == docs.count() == quality.selected(docs, None).count()
    assert toxicity.score(docs.limit(0), None).count() == 0


def random_rows(n, m, grades, seed=0):
    rng = np.random.default_rng(seed)
    size = rng.integers(0, 6, n)
    at = np.concatenate([rng.choice(m, k, replace=False) for k in size]).astype(np.int32)
    return ordinal.Rows(rng.integers(0, grades, n), rng.integers(1, 400, n), size, at, rng.integers(1, 9, len(at)))


def plain_loss(rows, w, t, each):
    """The likelihood, row by row."""
    total, at = 0.0, 0
    for y, words, k in zip(rows.grade, rows.words, rows.size):
        score = sum(w[a] * np.log(1 + n * 256 / (words + 64)) for a, n in zip(rows.at[at : at + k], rows.n[at : at + k]))
        up = [1.0, *(1 / (1 + np.exp(b - score)) for b in t), 0.0]
        total -= each[y] * np.log(up[y] - up[y + 1])
        at += k
    return total


def test_likelihood_and_gradient_against_differences():
    rows, rng = random_rows(60, 7, 4), np.random.default_rng(1)
    w, t, each = rng.normal(size=7) * 0.4, np.array([-0.5, 0.4, 1.1]), np.array([0.1, 0.3, 0.2, 0.4])
    made = ordinal.likelihood(rows, w, t, each)
    assert made[0] == pytest.approx(plain_loss(rows, w, t, each))
    for i in range(3):
        step = 1e-5 * np.eye(3)[i]
        assert made[1 + i] == pytest.approx((plain_loss(rows, w, t + step, each) - plain_loss(rows, w, t - step, each)) / 2e-5, abs=1e-6)
    for i in range(7):
        step = 1e-5 * np.eye(7)[i]
        assert made[4 + i] == pytest.approx((plain_loss(rows, w + step, t, each) - plain_loss(rows, w - step, t, each)) / 2e-5, abs=1e-6)


def test_sums_over_blocks_are_those_over_rows(spark):
    parts = [random_rows(20, 7, 2, seed) for seed in range(5)]
    blocks = spark.createDataFrame([tuple(p.packed()) for p in parts], ordinal.BLOCKS).repartition(3)
    w, t, each = np.linspace(-1, 1, 7), np.array([0.2]), np.array([0.5, 0.5])
    of = lambda rows: ordinal.likelihood(rows, w, t, each)
    assert np.allclose(ordinal.summed(blocks, of), sum(of(p) for p in parts))
    assert ordinal.summed(blocks.limit(0), of) is None


def test_thresholds_match_shares_without_features():
    rng = np.random.default_rng(0)
    grade = rng.choice(3, 3000, p=[0.5, 0.3, 0.2])
    rows = ordinal.Rows(grade, np.ones(3000, int), np.zeros(3000, int), np.zeros(0, int), np.zeros(0, int))
    sizes = np.bincount(grade).astype(float)
    model = ordinal.fit_counts(lambda of: of(rows), np.zeros(0, int), (0, 1, 2), sizes, ordinal.Settings())
    weight = sizes**0.5 / (sizes**0.5).sum()
    assert np.allclose(1 / (1 + np.exp(model.thresholds)), [weight[1:].sum(), weight[2]], atol=0.02)


def plain_features(text, kinds):
    """Features of a text by name and how often they occur."""
    out = {}
    add = lambda k: out.__setitem__(k, out.get(k, 0) + 1)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        raw = word.encode()
        add(("w", raw))
        for n in kinds.prefixes:
            if len(raw) >= n:
                add((n, raw[:n]))
        for a, b in zip(word, word[1:]):
            if len(a.encode()) == len(b.encode()) == 3:
                add(("pair", a + b))
    if kinds.shapes:
        tokens = text.split()
        for a, b in zip(tokens, tokens[1:]):
            if a == b:
                add("again")
        for token in tokens:
            signs = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if c < "\x80" else "*" for c in token)
            add(("s", re.sub(r"(.)\1+", r"\1", signs)))
    return out


TEXTS = [
    None, "", "one", "Two two TWO", "a,b/c-d_e 12three four5six", "Größe Übermut ÉTÉ été", "“quoted” ‘words’—dashed…", "漢字仮名 と かな",
    "кот КОТ Ελλάς", "x" * 5000 + " y", "go go go stop", "!!! ??? $$$ |", "tab\tand\nline go go",
]


def test_features_against_plain_code():
    kinds = features.Kinds(shapes=True)
    names = {}
    for block in (1 << 18, 7):
        got = [{} for _ in TEXTS]
        words = []
        for b in features.blocks(TEXTS, kinds, block=block):
            for d, a, n in zip(b.doc, b.at, b.n):
                got[d][int(a)] = int(n)
            words += b.words.tolist()
        want = [plain_features(t or "", kinds) for t in TEXTS]
        assert [sorted(g.values()) for g in got] == [sorted(w.values()) for w in want]
        assert words == [len(re.findall(r"[^\W\d_]+", t or "")) for t in TEXTS]
        names.setdefault("first", got)
        assert got == names["first"]


def test_equal_names_share_a_bucket_across_texts():
    kinds = features.Kinds(prefixes=(), shapes=False)
    a, b = ({int(x) for x in blk.at} for t in ("omega alpha", "ALPHA; omega beta") for blk in features.blocks([t], kinds))
    assert a < b and len(b) == 3


def test_long_tokens_are_read_whole():
    words = [f"{a}{b}{c}word" for a in "abcdefg" for b in "hijklmn" for c in "opq"]
    kinds = features.Kinds(prefixes=())
    read = lambda t: [(x.at.tolist(), x.n.tolist()) for x in features.blocks([t], kinds)]
    assert all(read(sign.join(words)) == read(" ".join(words)) for sign in (",", "/", "-", "_"))
    assert read("x" * 70 + "y" + "z" * 70) != read("x" * 70 + "q" + "z" * 70)


def shifted(text, by):
    low = string.ascii_lowercase
    return text.translate(str.maketrans(low, low[by:] + low[:by]))


def vocabularies(spark, many, n):
    """Texts in several vocabularies, each with toxic words of its own."""
    rng = np.random.default_rng(3)
    syllables = [a + b for a in "bcdfgl" for b in "aeiou"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(30, 300)))]
        toxic = i % 10 == 0
        for at in rng.choice(len(words), 3 if toxic else 0, replace=False):
            words[int(at)] = str(rng.choice(["wretch", "maggot", "vermin", "imbecile"]))
        rows.append((i, shifted(" ".join(words), i // 10 % many), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_ten_vocabularies_are_learned(spark):
    docs = vocabularies(spark, 10, 6000).cache()
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = toxicity.fit(docs, docs.where(~held).select("doc_id", "toxic"))
    rows = toxicity.score(docs.where(held), model).join(docs, "doc_id").collect()
    caught = np.mean([r["rejected"] for r in rows if r["toxic"]])
    spared = np.mean([not r["rejected"] for r in rows if not r["toxic"]])
    assert caught >= 0.9 and spared >= 0.99


def test_severity_does_not_follow_length(spark):
    docs = vocabularies(spark, 1, 3000).cache()
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    rows = toxicity.score(docs, model).join(docs, "doc_id").where("toxic = 1 and severity > 0").collect()
    by = {g: np.median([len(r["text"].split()) for r in rows if r["severity"] == g]) for g in (1, 3)}
    assert by[3] < 1.5 * by[1]


def test_repeated_ids_and_rows(spark):
    """One id with 40,000 rows: every row is counted, and the driver holds no rows."""
    docs, labels = corpus(spark, 200)
    many = docs.where("doc_id = 0").crossJoin(spark.range(40_000).drop("id"))
    model = quality.fit(docs.unionByName(many), labels.unionByName(labels))
    assert model.grades == (0, 1, 2) and np.isfinite(model.weights).all()


def test_few_labels_suffice(spark):
    """Rare telling words are found in a small label table."""
    docs = vocabularies(spark, 1, 120)
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    rows = toxicity.score(docs, model).join(docs, "doc_id").collect()
    assert np.mean([r["rejected"] for r in rows if r["toxic"]]) >= 0.9
    assert np.mean([r["rejected"] for r in rows if not r["toxic"]]) <= 0.02


def test_equal_texts_get_equal_results_and_empty_tables_work(spark):
    docs, labels = corpus(spark)
    twice = docs.unionByName(docs)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(twice, model).join(docs.dropDuplicates(["doc_id"]), "doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r["text"], set()).add((r["severity"], r["p_toxic"]))
    assert all(len(v) == 1 for v in by.values())
    assert toxicity.fit(docs.limit(0), labels) is None and quality.fit(docs.limit(0), labels) is None


def test_features_of_many_texts_take_little_memory():
    """The check's finding on pipeline, quality: the arrays of one block and of the counts added to each worker's memory."""
    import tracemalloc

    from lodestone.llm import features

    texts = [" ".join(f"word{(i * j) % 977} Ab{j % 31}" for j in range(150)) for i in range(400)]
    kinds = features.Kinds(prefixes=(5,), shapes=True)
    list(features.blocks(texts[:2], kinds))
    tracemalloc.start()
    for _ in features.blocks(texts, kinds):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 1 << 19 and peak < 14e6
    one, many = (sum(int((b.at.astype("int64") * b.n).sum()) for b in features.blocks(texts, kinds, None, size)) for size in (1 << 18, features.BLOCK))
    assert one == many


def test_a_kept_text_goes_to_python_once(spark):
    """The check's finding on pipeline, quality: texts that stay were sent to the workers twice."""
    from lodestone.llm.common import map_column

    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id long, text string")
    size = lambda: lambda texts: [[len(t or "") for t in texts]]
    both, other = (map_column(docs, "text", keep, "n long", size) for keep in (("doc_id", "text"), ("doc_id",)))
    assert sorted(map(tuple, both.collect())) == [(1, "a b", 3), (2, None, 0), (3, "c", 1)]
    assert sorted(map(tuple, other.collect())) == [(1, 3), (2, 0), (3, 1)]
    assert "\0in" not in both._jdf.queryExecution().analyzed().toString() and "\0in" in other._jdf.queryExecution().analyzed().toString()
