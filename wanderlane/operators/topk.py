"""Ranking scores: k best per source, ties by the lesser node, no padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scores: DataFrame, k: int, by: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """source, rank, node, score. A rank filter that Spark turns into a limit per group before the shuffle."""
    w = Window.partitionBy("source").orderBy(F.col(by).desc(), F.col("node"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("source", "rank", "node", F.col(by).alias("score"), *keep)


def batch(best: DataFrame, k: int, parts: int) -> DataFrame:
    """k_asked, source, rank, node, score for k/parts, 2k/parts, ..., k from one list of the k best."""
    asked = sorted({max(1, k * i // parts) for i in range(1, parts + 1)})
    return best.withColumn("k_asked", F.explode(F.array(*[F.lit(a) for a in asked]))).filter("rank <= k_asked").select("k_asked", "source", "rank", "node", "score")


def kth_score(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    """source, kth: the k-th best score, or the least of fewer."""
    return top_k(scores, k, by).groupBy("source").agg(F.min("score").alias("kth"))
