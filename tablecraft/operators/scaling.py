"""Standard scaling with the population standard deviation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Means and population standard deviations of the fitted columns."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def expressions(self, suffix: str = "") -> list[Column]:
        return [
            # A constant column has nothing to scale by and becomes 0.
            ((F.col(c).cast("double") - F.lit(m)) / F.lit(s if s > 0 else 1.0)).alias(c + suffix)
            for c, m, s in zip(self.columns, self.means, self.stds)
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the fitted columns scaled in place."""
        scaled = dict(zip(self.columns, self.expressions()))
        return df.select(*[scaled.get(c, F.col(c)) for c in df.columns])


def moments(columns: Sequence[str]) -> list[Column]:
    """Aggregates that one pass over the table needs to fit a scaler."""
    return [
        aggregate(F.col(c).cast("double")).alias(f"{name}_{position}")
        for position, c in enumerate(columns)
        for name, aggregate in (("mean", F.avg), ("std", F.stddev_pop))
    ]


def scaler_from(columns: Sequence[str], row: dict[str, float]) -> Scaler:
    positions = range(len(columns))
    return Scaler(
        tuple(columns),
        tuple(row[f"mean_{i}"] for i in positions),
        tuple(row[f"std_{i}"] for i in positions),
    )


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Fit on all rows; the only data that reaches the driver is one row."""
    row = df.agg(F.count("*").alias("n"), *moments(columns)).first().asDict()
    empty = [c for i, c in enumerate(columns) if row[f"mean_{i}"] is None]
    if row["n"] == 0 or empty:
        raise ValueError(f"cannot scale: no values in {empty or list(columns)}")
    return scaler_from(columns, row)
