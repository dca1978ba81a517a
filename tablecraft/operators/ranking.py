"""Ranking metrics of recommendations: ndcg@k and map@k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(recommended: DataFrame, k: int) -> DataFrame:
    """The k best items per user; equal scores are ordered by item.

    Spark keeps k rows per user before the shuffle, so a user with very many
    candidates sends no more than the others.
    """
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return recommended.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranking_metrics_by_user(recommended: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ndcg and average precision at k for every user with relevant items.

    ``recommended`` has user_id, item_id, score; ``relevant`` has user_id and
    item_id. Relevance is binary. Users without recommendations score 0.
    """
    truth = relevant.select("user_id", "item_id").distinct()
    wanted = truth.groupBy("user_id").agg(F.count("*").alias("n_relevant"))

    hits = top_k(recommended, k).join(truth, ["user_id", "item_id"])
    so_far = Window.partitionBy("user_id").orderBy("rank")
    gained = (
        hits.withColumn("hit_no", F.row_number().over(so_far))
        .groupBy("user_id")
        .agg(
            F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"),
            F.sum(F.col("hit_no") / F.col("rank")).alias("precision_sum"),
        )
    )

    depth = F.least(F.col("n_relevant"), F.lit(k)).cast("int")
    ideal = [1.0 / F.log2(F.lit(position + 1.0)) for position in range(1, k + 1)]
    best_dcg = F.lit(0.0)
    for position, gain in enumerate(ideal, start=1):
        best_dcg = best_dcg + F.when(depth >= position, gain).otherwise(0.0)
    return wanted.join(gained, "user_id", "left").select(
        "user_id",
        (F.coalesce("dcg", F.lit(0.0)) / best_dcg).alias("ndcg"),
        (F.coalesce("precision_sum", F.lit(0.0)) / depth).alias("average_precision"),
    )


def ranking_metrics(recommended: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Mean over users, one row: ``ndcg_at_k`` and ``map_at_k``."""
    per_user = ranking_metrics_by_user(recommended, relevant, k)
    return per_user.agg(
        F.count("*").alias("users"),
        F.round(F.avg("ndcg"), 6).alias("ndcg_at_k"),
        F.round(F.avg("average_precision"), 6).alias("map_at_k"),
    )
