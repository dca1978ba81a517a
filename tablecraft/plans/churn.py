"""Churn model: lookback extract, features, publication, training, gate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions import as_date, flag, log1p, null_if, safe_divide, to_double, within_dates
from tablecraft.operators.classify import feature_columns, fit_logistic, score
from tablecraft.operators.feature_schema import USER
from tablecraft.operators.feature_store import publish_features
from tablecraft.operators.metrics import evaluate, gate
from tablecraft.session import materialize
from tablecraft.sources.writers import save_model

LOOKBACK_DAYS = 90


def churn_training_raw(
    user_events: DataFrame, run_date: str | dt.date, lookback_days: int = LOOKBACK_DAYS
) -> DataFrame:
    """Rows dated ``run_date - lookback_days .. run_date``, both ends included."""
    end = as_date(run_date)
    start = end - dt.timedelta(days=lookback_days)
    return user_events.where(within_dates(user_events, "event_date", start, end)).select(
        "user_id",
        "session_count_7d",
        "session_count_30d",
        "total_purchases_30d",
        "days_since_last_login",
        "support_tickets_90d",
        "avg_session_duration_s",
        flag(F.col("churned_within_30d")).alias("label"),
    )


def churn_features(raw: DataFrame, as_of: str | dt.datetime | None = None) -> DataFrame:
    """Engineered features of the rows with a user.

    ``as_of`` fixes ``feature_timestamp``; by default it is the query's start.
    """
    stamp = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    sessions_30d = null_if(F.col("session_count_30d"), 0)
    return raw.where(F.col("user_id").isNotNull()).select(
        "user_id",
        "session_count_7d",
        "session_count_30d",
        to_double(F.col("total_purchases_30d")).alias("total_purchases_30d"),
        safe_divide(F.col("session_count_7d"), sessions_30d).alias("session_trend"),
        log1p(F.col("total_purchases_30d")).alias("log_purchases_30d"),
        "days_since_last_login",
        "support_tickets_90d",
        "avg_session_duration_s",
        "label",
        stamp.alias("feature_timestamp"),
    )


def publish_churn_features(
    features: DataFrame, root: str, disposition: str = "WRITE_TRUNCATE"
) -> DataFrame:
    """Store the behavioural features of the users; returns ``features``."""
    return publish_features(
        features,
        root,
        USER,
        "behavioral",
        feature_ids=USER.groups["behavioral"].ids,
        disposition=disposition,
    )


def label_distribution(features: DataFrame) -> DataFrame:
    return features.groupBy("label").agg(F.count("*").alias("row_count"))


@dataclass(frozen=True)
class ChurnRun:
    model: PipelineModel
    metrics: dict[str, float]
    scores: DataFrame
    path: str | None


def train_and_gate(
    features: DataFrame,
    thresholds: Mapping[str, float] | None = None,
    metrics: Sequence[str] = ("auc", "f1"),
    holdout_percent: int = 0,
    model_base: str | None = None,
    run_id: str = "latest",
    **hyperparameters: object,
) -> ChurnRun:
    """Fit, score, evaluate and gate; optionally save the model and its data.

    Evaluates on the training rows by default. With ``holdout_percent`` the
    users are split by a hash of their id, and the held-out part is scored.
    The features feed several jobs, so they are stored once.
    """
    stored = materialize(features, "churn-features")
    train = evaluation = stored
    if holdout_percent:
        held_out = F.pmod(F.xxhash64("user_id"), F.lit(100)) < holdout_percent
        train, evaluation = stored.where(~held_out), stored.where(held_out)
    columns = feature_columns(stored)
    if hyperparameters.get("invalid") == "skip":
        evaluation = evaluation.dropna(subset=[*columns, "label"])
    model = fit_logistic(train, columns, **hyperparameters)
    scores = score(model, evaluation)
    gated = gate(
        evaluate(scores, metrics), {"auc": 0.78} if thresholds is None else dict(thresholds)
    )
    path = None
    if model_base is not None:
        path = save_model(model, model_base, "churn_prediction", run_id, evaluation)
    return ChurnRun(model, gated, scores, path)
