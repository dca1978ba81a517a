"""Distributed logistic regression: scale, assemble, fit, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions import at_threshold
from tablecraft.operators.quality import QualityError
from tablecraft.operators.scaling import Scaler, moments, scaler_from

# Columns that are never features.
NON_FEATURES = ("label", "user_id", "feature_timestamp")


def feature_columns(df: DataFrame) -> list[str]:
    return df.drop(*NON_FEATURES).columns


def fit_logistic(
    df: DataFrame,
    features: Sequence[str] | None = None,
    label: str = "label",
    C: float = 1.0,
    max_iter: int = 1000,
    solver: str = "lbfgs",
    tol: float = 1e-6,
    invalid: str = "error",
) -> PipelineModel:
    """L2-penalised logistic regression on standard-scaled features.

    Minimises ``0.5 * |w|^2 + C * sum(log loss)`` with an unpenalised
    intercept. Spark minimises the mean loss, so its penalty is ``1 / (C * n)``.
    ``invalid`` is "error" or "skip" for rows with a NULL feature or label.
    """
    if solver != "lbfgs":
        raise ValueError(f"unsupported solver {solver!r}; Spark fits with lbfgs")
    if invalid not in ("error", "skip"):
        raise ValueError(f"invalid must be 'error' or 'skip', not {invalid!r}")
    columns = list(features or feature_columns(df))
    rows = df.select(*columns, F.col(label).cast("double").alias(label))
    if invalid == "skip":
        rows = rows.dropna()
    has_null = F.lit(False)
    for column in rows.columns:
        has_null = has_null | F.col(column).isNull()
    stats = (
        rows.agg(
            F.count("*").alias("n"),
            F.count(F.when(has_null, 1)).alias("with_null"),
            F.min(label).alias("lowest"),
            F.max(label).alias("highest"),
            *moments(columns),
        )
        .first()
        .asDict()
    )
    if stats["n"] == 0:
        raise QualityError("no rows to train on")
    if stats["with_null"]:
        raise QualityError(f"{stats['with_null']} training rows have a NULL feature or label")
    if stats["lowest"] == stats["highest"]:
        raise QualityError(f"training rows hold a single class: {stats['lowest']}")

    prepare = [_scale_stage(scaler_from(columns, stats)), _assemble_stage(columns, invalid)]
    vectors = rows
    for stage in prepare:
        vectors = stage.transform(vectors)
    classifier = LogisticRegression(
        featuresCol="scaled_features",
        labelCol=label,
        elasticNetParam=0.0,
        regParam=1.0 / (C * stats["n"]),
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    ).fit(vectors.select("scaled_features", label))
    return PipelineModel([*prepare, classifier])


def score(
    model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("user_id", "label")
) -> DataFrame:
    """Probability of class 1 and the class at threshold 0.5, beside ``keep``."""
    probability = vector_to_array("probability")[1]
    return (
        model.transform(df)
        .select(*keep, probability.alias("probability"))
        .withColumn("predicted", at_threshold(F.col("probability")))
    )


def _scale_stage(scaler: Scaler) -> SQLTransformer:
    # Plain SQL with the fitted numbers in it: saved and loaded with the model.
    scaled = ", ".join(
        f"(CAST(`{c}` AS DOUBLE) - {m!r}D) / {s if s > 0 else 1.0!r}D AS `{c}__scaled`"
        for c, m, s in zip(scaler.columns, scaler.means, scaler.stds)
    )
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def _assemble_stage(columns: Sequence[str], invalid: str) -> VectorAssembler:
    return VectorAssembler(
        inputCols=[f"{c}__scaled" for c in columns],
        outputCol="scaled_features",
        handleInvalid=invalid,
    )
