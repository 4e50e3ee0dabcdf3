"""Passages in texts against Python's own search."""

from pyspark.sql import functions as F

from lodestone.operators import passages

TEXTS = ["the cat sat on the mat", "", None, "été à la plage", "x", "aaaaaaaaaaaaaaaaaaaa", "the cat", "on the mat", "cat sat on the mat and on", "ab\x00cd"]
ASKED = ["the cat", "", None, "é", "té à", "x", "aaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaa", "cat sat on the mat", "cat sat on", "the cat", "mat", "b\x00c", "xa", "b", "ab\x00cd\x00"]


def test_holders_are_those_of_contains(spark, monkeypatch):
    texts = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[0])], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id int, passage string")
    want = sorted(tuple(r) for r in texts.join(asked, F.contains("text", "passage")).select("query_id", "doc_id").collect())
    for group in (passages.GROUP, 3):
        monkeypatch.setattr(passages, "GROUP", group)
        assert sorted(tuple(r) for r in passages.holders(texts, asked).collect()) == want
    monkeypatch.setattr(passages, "BLOCK", 8)
    assert sorted(tuple(r) for r in passages.holders(texts, asked).collect()) == want


def test_no_pair_is_made_that_is_no_match(spark):
    """A frequent inner word, or none, used to bring passages together with most texts."""
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("so it is "), F.col("id").cast("string")).alias("text"))
    asked = texts.select(F.col("doc_id").alias("query_id"), F.concat("text", F.lit(" no")).alias("passage"))
    found = passages.holders(texts, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(passages.Rolling, "of", lambda self, start, end: end - start)
    finder = passages.Finder([b"abcdefgh1", b"abcdefgh2", b"abcdefgh"])
    text, passage = finder.find([b"abcdefgh1 abcdefgh2", b"abcdefgh3", b"abcdefg"])
    assert sorted(zip(text.tolist(), passage.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 2)]
