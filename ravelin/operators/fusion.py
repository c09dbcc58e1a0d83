"""Weighted reciprocal-rank fusion of hit lists, normalised scores, the pool for re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least value that scores are divided by.
FLOOR = 1e-4


def fetch_size(k: int) -> int:
    """Hits to take from each list for k results."""
    return max(12 * k, 40)


def contributions(hits: DataFrame, weight: Column, constant: float = 60.0) -> DataFrame:
    """query_id, id, part: weight / (constant + rank). Hits whose weight is 0 aren't candidates at all."""
    return hits.withColumn("w", weight).where("w > 0").select("query_id", "id", (F.col("w") / (F.lit(constant) + F.col("rank"))).alias("part"))


def fused(vector_hits: DataFrame, text_hits: DataFrame, queries: DataFrame, constant: float = 60.0, text_weight: float = 2.0, technical_weight: float = 5.0) -> DataFrame:
    """query_id, id, rrf (9 decimals), score (6 decimals: rrf by the question's largest).

    queries has query_id and technical: a technical question is answered from full-text hits alone, with the higher weight.
    """
    technical = F.broadcast(queries.select("query_id", "technical"))
    v = contributions(vector_hits.join(technical, "query_id"), F.when(F.col("technical"), 0.0).otherwise(1.0), constant)
    t = contributions(text_hits.join(technical, "query_id"), F.when(F.col("technical"), technical_weight).otherwise(text_weight), constant)
    rrf = v.unionByName(t).groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("rrf"))
    return normalised(rrf)


def normalised(rrf: DataFrame) -> DataFrame:
    return rrf.withColumn("score", F.round(F.col("rrf") / F.greatest(F.lit(FLOOR), F.max("rrf").over(W.partitionBy("query_id"))), 6))


def pool(scored: DataFrame, size: int = 12) -> DataFrame:
    """The best of each question by rrf, with their place."""
    by = W.partitionBy("query_id").orderBy(F.desc("rrf"), "id")
    return scored.withColumn("place", F.row_number().over(by)).where(F.col("place") <= (size if size > 0 else 12))


def rescaled(ranked: DataFrame, score: str = "rerank_score") -> DataFrame:
    """With score as the re-ranker's between the question's worst and best: 0 to 1, or 0 to 0.5 if even the best is below -2; half of that if they're equal."""
    w = W.partitionBy("query_id")
    best, worst = F.max(score).over(w), F.min(score).over(w)
    top = F.when(best < -2, 0.5).otherwise(1.0)
    return ranked.withColumn("score", F.round(F.when(best - worst > FLOOR, (F.col(score) - worst) / (best - worst) * top).otherwise(0.5 * top), 6))
