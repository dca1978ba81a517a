"""Aggregate expressions. All of them combine map-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: Column, scale: int = 2) -> Column:
    return value.cast(f"decimal(18,{scale})")


def sum_if(condition: Column, value: Column) -> Column:
    """Sum over the matching rows; 0 where none matches."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
