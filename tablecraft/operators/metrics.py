"""Binary classification metrics and the gate on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.functions import or_zero, rounded
from tablecraft.operators.carry import PART, earlier_ranges, store_in_ranges
from tablecraft.session import materialize

METRICS = ("auc", "f1", "accuracy", "precision", "recall")

# Distinct scores that one task counts along.
SCORES_PER_RANGE = 500_000


class GateError(ValueError):
    """A model does not reach the required metrics."""


def evaluate(
    scored: DataFrame,
    metrics: Sequence[str] = ("auc", "f1"),
    score: str = "probability",
    label: str = "label",
    threshold: float = 0.5,
    scores_per_range: int = SCORES_PER_RANGE,
) -> DataFrame:
    """One row with a column per requested metric, rounded to 4 places.

    A row without a score, or with a label other than 0 and 1, is an error: leaving
    it out would flatter the model. A score counts as class 1
    strictly above ``threshold``. A ratio whose denominator is 0 is 0, except
    ``auc``, which is NULL when only one class is present.
    """
    unknown = [name for name in metrics if name not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; choose from {list(METRICS)}")
    usable = F.coalesce(F.col(score).isNotNull() & F.col(label).isin(0, 1), F.lit(False))
    fault = F.raise_error(F.lit("a score is missing, or a label is not 0 or 1")).cast("double")
    known = scored.select(
        F.when(usable, F.col(score).cast("double")).otherwise(fault).alias("score"),
        F.when(F.col(label) == 1, 1).otherwise(0).cast("double").alias("positives"),
        F.when(F.col(label) == 0, 1).otherwise(0).cast("double").alias("negatives"),
    )
    formulas = _threshold_formulas(threshold)
    if "auc" in metrics:
        known = _with_negatives_below(known, scores_per_range)
        won = F.col("positives") * (F.col("below") + F.col("negatives") / 2)
        formulas["auc"] = F.try_divide(F.sum(won), F.sum("positives") * F.sum("negatives"))
    return known.agg(*[rounded(formulas[name]).alias(name) for name in metrics])


def _threshold_formulas(threshold: float) -> dict[str, Column]:
    above = F.col("score") > threshold
    tp = F.sum(F.when(above, F.col("positives")).otherwise(0.0))
    fp = F.sum(F.when(above, F.col("negatives")).otherwise(0.0))
    positives = F.sum("positives")
    negatives = F.sum("negatives")

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return {
        "f1": ratio(2 * tp, tp + fp + positives),
        "accuracy": ratio(tp + negatives - fp, positives + negatives),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, positives),
    }


def _with_negatives_below(known: DataFrame, scores_per_range: int) -> DataFrame:
    """One row per distinct score, with the number of negatives that score less.

    Rows collapse to distinct scores first (map-side combine), so a score
    shared by a third of the rows is one row. The running count is taken inside
    ranges of scores, whose number follows the number of distinct scores; each
    starts from the negatives of the lower ranges.
    """
    counts = materialize(
        known.groupBy("score").agg(
            F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives")
        ),
        "score-counts",
    )
    parts = max(1, -(-counts.count() // scores_per_range))
    ranged = store_in_ranges(counts, "score", label="score-ranges", parts=parts)
    in_range = ranged.groupBy(PART).agg(F.sum("negatives").alias("negatives"))
    lower = in_range.withColumn("negatives", or_zero(F.sum("negatives").over(earlier_ranges())))
    started = ranged.unionByName(lower, allowMissingColumns=True)
    lower_scores = (
        Window.partitionBy(PART)
        .orderBy(F.asc_nulls_first("score"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    below = started.withColumn("below", F.sum("negatives").over(lower_scores))
    return below.where(F.col("score").isNotNull())


def gate_report(metrics: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Metric, value, threshold and verdict, one row per threshold."""
    _require(metrics, thresholds)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("value"),
                F.lit(float(limit)).alias("threshold"),
                (F.col(name) >= limit).alias("passed"),
            )
            for name, limit in thresholds.items()
        ]
    )
    return metrics.select(F.inline(rows))


def gate(metrics: DataFrame, thresholds: Mapping[str, float]) -> dict[str, float]:
    """Fail if any metric is below its threshold; equal passes.

    The error names every failing metric. A threshold on a metric that was not
    computed is an error too.
    """
    _require(metrics, thresholds)
    row = metrics.first()
    if row is None:
        raise GateError("no metrics to gate on")
    values = row.asDict()
    failures = [
        f"{name}={values[name]} < {limit}"
        for name, limit in thresholds.items()
        if values[name] is None or values[name] < limit
    ]
    if failures:
        raise GateError("metric gate failed: " + ", ".join(failures))
    return values


def _require(metrics: DataFrame, thresholds: Mapping[str, float]) -> None:
    absent = [name for name in thresholds if name not in metrics.columns]
    if absent:
        raise GateError(f"gated metrics were not computed: {absent}")
