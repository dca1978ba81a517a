"""Checks that stop a run before a wrong result is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A table does not have the property an operator relies on."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail if a join on ``keys`` would fan out; returns ``df`` unchanged."""
    example = duplicate_keys(df, keys).first()
    if example is not None:
        raise QualityError(f"duplicate key {list(keys)}: {example.asDict()}")
    return df


def unique_for_join(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` for a join on ``keys`` that must not repeat the rows of the other side.

    A key that several rows hold is an error once the result is computed; no job
    of its own is run. Copies meet after a map-side combine, so a key with a third
    of all rows is no long task. Rows with a null in a key, which join nothing,
    may repeat; those of one key come out as one.
    """
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("__rows"), F.any_value(F.struct(F.lit(0), *others)).alias("__row")
    )
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    values = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
    message = F.concat(F.lit(f"{what}: duplicate key {list(keys)}: "), F.concat_ws(", ", *values))
    repeated = complete & (F.col("__rows") > 1)
    checked = grouped.where(F.when(repeated, F.raise_error(message)).otherwise(F.lit(True)))
    return checked.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def assert_non_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise QualityError(f"{what} is empty")
    return df
