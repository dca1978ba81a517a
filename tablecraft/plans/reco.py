"""Recommendations: interaction counts, profiles, matrix, factorisation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions import sum_if, within_dates
from tablecraft.operators.factorize import Factorization, factorize
from tablecraft.operators.matrix import interaction_matrix

_COLUMNS = ("user_id", "item_id", "interaction_type", "ts")


def extract_interactions(interactions: DataFrame, run_date: str | dt.date) -> DataFrame:
    """Interactions from the start of ``run_date`` on."""
    return interactions.where(within_dates(interactions, "ts", run_date, None)).select(*_COLUMNS)


def user_item_features(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id", "item_id", "interaction_type").agg(
        F.count("*").alias("interaction_count")
    )


def user_profiles(user_items: DataFrame) -> DataFrame:
    """Distinct items, interactions and purchases per user.

    The counts of one user are summed per item before they meet on the user, so
    a user with a third of all rows arrives as one row per task.
    """
    bought = F.col("interaction_type") == "purchase"
    return user_items.groupBy("user_id").agg(
        F.count_distinct("item_id").alias("unique_items"),
        F.sum("interaction_count").alias("total_interactions"),
        sum_if(bought, F.col("interaction_count")).alias("purchase_count"),
    )


def training_prepared(interactions: DataFrame) -> DataFrame:
    return interactions.select(*_COLUMNS)


def train_recommender(
    interactions: DataFrame, n_components: int = 10, max_iter: int = 200, **options: object
) -> Factorization:
    """Weight the interactions, build the sparse matrix and factorise it."""
    matrix = interaction_matrix(training_prepared(interactions))
    return factorize(matrix, n_components, max_iter, **options)
