"""Ranking quality in batch: P@k, MRR, NDCG, their macro averages and comparisons.

``results``: query_id, rank, title; ``qrels``: query_id, query, relevant titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIE = 0.01


def query_metrics(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, precision, mrr, ndcg of every case; 0 where nothing was found.

    Precision is divided by k; gains are binary; the ideal has min(k, relevant)
    ones, so repeated titles can raise NDCG above 1."""
    judged = results.join(qrels.select("query_id", "relevant"), "query_id").where(F.array_contains("relevant", F.col("title")))
    found = judged.groupBy("query_id").agg(F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.size("relevant")))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    some = F.size("relevant") > 0
    return qrels.join(found, "query_id", "left").select(
        "query_id",
        (F.coalesce("hits", F.lit(0)) / F.lit(k) if k > 0 else F.lit(0.0)).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(some & F.lit(k > 0), F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Macro averages over all cases, those without any result included."""
    return metrics.agg(F.count("*").alias("cases"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "mrr", "ndcg")])


def compare(a: DataFrame, b: DataFrame, tie: float = TIE) -> DataFrame:
    """query_id, ndcg_a, ndcg_b, winner: a, b or tie within ``tie``."""
    both = a.select("query_id", F.col("ndcg").alias("ndcg_a")).join(b.select("query_id", F.col("ndcg").alias("ndcg_b")), "query_id")
    gap = F.col("ndcg_a") - F.col("ndcg_b")
    return both.withColumn("winner", F.when(gap > tie, "a").when(gap < -tie, "b").otherwise("tie"))
