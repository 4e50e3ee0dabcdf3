"""Second-stage ranking: pair scores and weighted rank fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: A pair scorer: (question, text) -> double column.
PairScore = Callable[[Column, Column], Column]


def overlap(question: Column, text: Column) -> Column:
    """Share of a question's distinct words that a text has; the stand-in where no pair scorer is given."""
    asked = F.array_distinct(T.tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, T.tokens(text))) / F.size(asked)).otherwise(F.lit(0.0))


def _by_query(*order: Column):
    return Window.partitionBy("query_id").orderBy(*order)


def reject_blank(df: DataFrame, column: str = "question") -> DataFrame:
    """An error if a question is blank."""
    blank = F.coalesce(T.strip(column), F.lit("")) == ""
    failed = F.raise_error(F.lit("a question must not be blank")).cast("string")
    return df.withColumn(column, F.when(blank, failed).otherwise(F.col(column)))


def cross_encode(candidates: DataFrame, top_k: int = 5, score: PairScore = overlap) -> DataFrame:
    """Candidates (query_id, question, chunk_id, text, retrieval_score, retrieval_rank) by pair score; ties keep their order."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    scored = reject_blank(candidates).withColumn("reranker_score", score(F.col("question"), F.col("text")).cast("double"))
    rank = F.row_number().over(_by_query(F.desc("reranker_score"), "retrieval_rank"))
    ranked = scored.withColumn("reranked_rank", rank)
    return ranked.where(F.col("reranked_rank") <= top_k).withColumns(
        {"final_score": F.col("reranker_score"), "final_rank": F.col("reranked_rank")}
    )


def rank_fusion(
    candidates: DataFrame, top_k: int = 5, retrieval_weight: float = 0.5, reranker_weight: float = 0.5,
    k: int = 60, score: PairScore = overlap,
) -> DataFrame:
    """Weighted reciprocal ranks of retrieval and of the pair scorer over all candidates; ties keep the scorer's order."""
    if retrieval_weight < 0 or reranker_weight < 0 or retrieval_weight + reranker_weight == 0:
        raise ValueError("weights must not be negative, and one must be positive")
    if k < 0:
        raise ValueError("the smoothing constant must not be negative")
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    scored = reject_blank(candidates).withColumn("reranker_score", score(F.col("question"), F.col("text")).cast("double"))
    ranked = scored.withColumn("reranked_rank", F.row_number().over(_by_query(F.desc("reranker_score"), "retrieval_rank")))
    final = F.lit(float(retrieval_weight)) / (F.lit(k) + F.col("retrieval_rank")) + F.lit(float(reranker_weight)) / (
        F.lit(k) + F.col("reranked_rank")
    )
    ranked = ranked.withColumn("final_score", final)
    order = _by_query(F.desc(F.round("final_score", 12)), "reranked_rank")
    return ranked.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_k)


def two_stage(
    ranking: DataFrame, queries: DataFrame, chunks: DataFrame, candidate_k: int = 20, top_k: int = 5,
    fused: bool = True, score: PairScore = overlap, weights: tuple[float, float] = (0.5, 0.5), k: int = 60,
) -> DataFrame:
    """The first candidate_k of a ranking, joined with question and text, then ranked again.

    weights: of retrieval and reranker, with the constant k, where the ranks are fused.
    """
    named = queries.select("query_id", F.col("text").alias("question"))
    texts = chunks.select("chunk_id", "text")
    rows = ranking.where(F.col("rank") <= candidate_k).select(
        "query_id", "chunk_id", F.col("score").alias("retrieval_score"), F.col("rank").alias("retrieval_rank")
    )
    rows = rows.join(texts, "chunk_id").join(named, "query_id")
    return rank_fusion(rows, top_k, *weights, k, score) if fused else cross_encode(rows, top_k, score)
