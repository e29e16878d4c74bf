"""Fusion of two ranked pools, and the reranker that changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA, POOL = 0.5, 4
SPREAD = 1e-12
DIGITS = 6


def min_max(value: str, by: str) -> Column:
    """(x - min) / (max - min) within `by`; 0 where all are alike."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < SPREAD, 0.0).otherwise((F.col(value) - low) / (high - low))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 8, alpha: float | Column = ALPHA, key: str = "chunk_id", query_key: str = "query_id") -> DataFrame:
    """(query_key, key, score, similarity, keyword_score, rank): alpha * vector + (1 - alpha) * keyword, each scaled within its own pool.

    vector has `similarity` and `rank`, keyword `score` and `rank`; a missing side counts 0.  Ties: the vector pool's order first, then
    the keyword pool's.  alpha: a number, or a column of the query key.
    """
    v = vector.select(query_key, key, "similarity", F.col("rank").alias("v_rank"), min_max("similarity", query_key).alias("v"))
    w = keyword.select(query_key, key, F.col("score").alias("keyword_score"), F.col("rank").alias("k_rank"), min_max("score", query_key).alias("w"))
    both = v.join(w, [query_key, key], "full_outer")
    score = F.round(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0)), DIGITS)
    both = both.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.col("v_rank").asc_nulls_last(), "k_rank"))
    both = both.withColumn("rank", rank).where(F.col("rank") <= k)
    return both.select(query_key, key, "score", "similarity", "keyword_score", (F.col("rank") - 1).alias("rank"))


def rerank_identity(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rerank_score", F.col("score"))
