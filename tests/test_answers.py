import json

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import answer, evaluate, verify

BLOCKS = [(1, "a", "Cats purr. Loudly.", "s/a.md", None, None, ["H", "I"]), (2, "b", " Dogs bark ", None, None, 3, None)]


def answers(spark, text):
    schema = f"query_id int, answer string, blocks array<{answer.BLOCK}>"
    return answer.cited(spark.createDataFrame([(1, text, BLOCKS)], schema))


def test_rendered_blocks(spark):
    row = answers(spark, "").select(F.array_join(F.transform("blocks", answer.rendered), "\n\n").alias("t")).first()
    assert row["t"] == "[1]\nSource: s/a.md\nSection: H > I\n\nCats purr. Loudly.\n[/1]\n\n[2]\nPage: 3\n\nDogs bark\n[/2]"


def test_prompts(spark):
    asked = spark.createDataFrame([(1, " why? ")], "query_id int, text string")
    none = spark.createDataFrame([], f"query_id int, reference int, block {answer.BLOCK}")
    row = answer.prompts(answer.contexts(none, asked), asked).first()
    assert row["user_prompt"] == (
        "Question:\nwhy?\n\nEvidence:\n[NO EVIDENCE PROVIDED]\n\nAnswer the question according to the system instructions."
    )
    with pytest.raises(ValueError):
        answer.context_blocks(none, 0)


def test_citations_and_unresolved(spark):
    row = answers(spark, "Cats purr [1][7]. Dogs [2] [1].").first()
    assert [tuple(c) for c in row["citations"]] == [(1, "a"), (2, "b")] and row["unresolved_references"] == [7]


def test_claims_and_metrics(spark):
    made = answers(spark, "Cats purr [1]. Dogs bark [7]. Cows moo. [2].")
    found = verify.claims(made).orderBy("claim_idx").collect()
    assert [(c["text"], c["citations"], c["invalid"]) for c in found] == [("Cats purr.", [1], []), ("Dogs bark.", [], [7]), ("Cows moo.", [], [])]
    keep = verify.claims(made, drop_invalid=False)
    evidence = spark.createDataFrame([(1, 1, "Cats purr. Loudly."), (1, 2, "Dogs bark")], "query_id int, reference int, text string")
    checks = verify.citation_checks(keep, evidence)
    row = verify.citation_metrics(keep, checks).first()
    assert (row["total_claims"], row["uncited_claims"], row["total_verifications"], row["supported"]) == (3, 1, 1, 1)
    assert row["citation_precision"] == 1.0 and row["citation_coverage"] == pytest.approx(1 / 3)
    assert row["unresolved_references"] == [7]
    assert verify.invalid_references(keep, made).first()["invalid_references"] == []


def test_coverage_of_claims_that_repeat_a_text(spark):
    made = answers(spark, "Cats purr [1]. Cats purr [7]. Dogs bark [2].")
    found = verify.claims(made)
    evidence = spark.createDataFrame([(1, 1, "Cats purr."), (1, 2, "Dogs bark")], "query_id int, reference int, text string")
    checks = verify.citation_checks(found, evidence)
    assert verify.citation_metrics(found, checks).first()["citation_coverage"] == 1.0
    assert verify.citation_metrics(found, checks, claim="claim_idx").first()["citation_coverage"] == pytest.approx(2 / 3)


def signals(spark, *counts, unresolved=()):
    names = ("total", "supported", "partially_supported", "unsupported", "contradicted")
    schema = ", ".join(f"{n}_claims long" for n in names) + ", unresolved_references array<int>"
    return verify.abstention(spark.createDataFrame([(*counts, list(unresolved))], schema)).first()


def test_abstention_table(spark):
    none = signals(spark, 0, 0, 0, 0, 0)
    assert none["decision"] == "ABSTAIN" and none["faithfulness_score"] is None
    assert list(none["reasons"]) == ["No verifiable factual claims were produced."]
    assert signals(spark, 2, 2, 0, 0, 0)["decision"] == "ACCEPT"
    warned = signals(spark, 2, 1, 1, 0, 0)
    assert warned["decision"] == "ACCEPT_WITH_WARNING" and warned["faithfulness_score"] == 0.75 and not warned["should_abstain"]
    bad = signals(spark, 4, 1, 1, 1, 1, unresolved=[6, 7])
    assert bad["should_abstain"] and list(bad["reasons"]) == [
        "1 factual claim(s) were unsupported by the supplied evidence.",
        "1 factual claim(s) were contradicted by the supplied evidence.",
        "The answer contained unresolved citation reference(s): 6, 7.",
    ]


def test_final_answer(spark):
    good = verify.verify(answers(spark, "Cats purr [1].")).first()
    assert good["decision"] == "ACCEPT" and good["final_answer"] == "Cats purr [1]."
    lost = verify.verify(answers(spark, "Cats purr [1][9].")).first()
    assert lost["final_answer"] == verify.ABSTENTION_MESSAGE and lost["unresolved_references"] == [9]


def test_replies(spark):
    rows = spark.createDataFrame([(1, '{"verdict": "SUPPORTED"}'), (2, "no json"), (3, None)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(verify.parsed_verdict(F.col("t"))).collect()] == ["SUPPORTED", "UNSUPPORTED", "UNSUPPORTED"]
    with pytest.raises(Exception, match="unknown verdict"):
        spark.createDataFrame([('{"verdict": "MAYBE"}',)], "t string").select(verify.parsed_verdict(F.col("t"))).collect()
    rows = spark.createDataFrame([(1, '{"verdict": "CORRECT"}'), (2, 'so "verdict": "INCORRECT", cut'), (3, "?")], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(evaluate.judged_reply(F.col("t"))).collect()] == ["CORRECT", "INCORRECT", None]


def test_completeness_and_correctness(spark):
    facts = spark.createDataFrame([("a", 0, "Token expires after days", True), ("a", 1, "Unrelated matter entirely", True), ("a", 2, "optional", False)], "case_id string, fact_idx int, description string, required boolean")
    given = spark.createDataFrame([("a", "The token expires after three days [1].", [])], "case_id string, answer string, claims array<string>")
    results = evaluate.completeness(facts, given)
    assert [r["matched"] for r in results.orderBy("fact_idx").collect()] == [True, False]
    cases = spark.createDataFrame([("a", True), ("b", False)], "case_id string, answerable boolean")
    scores = {r["case_id"]: r for r in evaluate.completeness_scores(cases, results).collect()}
    assert scores["a"]["completeness_score"] == 0.5 and scores["b"]["completeness_score"] is None
    judged = spark.createDataFrame([("a", "x", "CORRECT"), ("a", "y", "PARTIALLY_CORRECT"), ("a", " ", "INCORRECT"), ("b", "z", "CORRECT")], "case_id string, text string, verdict string")
    scores = {r["case_id"]: r for r in evaluate.correctness(cases, judged).collect()}
    assert scores["a"]["correctness_score"] == 0.75 and scores["b"]["correctness_score"] is None


def test_empty_results(spark):
    none = spark.createDataFrame([], schemas.of("CASE_RESULT"))
    row = evaluate.benchmark_summary(none).first()
    assert row["total_cases"] == 0 and row["behavior_accuracy"] is None and row["average_faithfulness"] is None
    assert evaluate.run_summary(none).first()["cases"] == 0
