"""Scalar expressions: built-in functions only, so they stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """``a / b`` as double; NULL when ``b`` is 0 or either side is NULL."""
    return F.try_divide(to_double(numerator), to_double(denominator))


def null_if(value: Column, other: object) -> Column:
    return F.nullif(value, _literal(other))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def log1p(value: Column) -> Column:
    """``ln(1 + x)``, accurate near 0; NULL outside the domain (``x <= -1``)."""
    return F.log1p(value)


def to_double(value: Column) -> Column:
    return value.cast("double")


def tier(value: Column, low: float = 10, medium: float = 50) -> Column:
    """LOW below ``low``, MEDIUM below ``medium``, else HIGH (also for NULL)."""
    return F.when(value < low, "LOW").when(value < medium, "MEDIUM").otherwise("HIGH")


def flag(condition: Column) -> Column:
    """1 where the condition is true, else 0; a NULL condition gives 0."""
    return F.when(condition, 1).otherwise(0)


def map_value(key: Column, mapping: Mapping[object, object], default: object) -> Column:
    """Look ``key`` up in a small fixed mapping, ``default`` where it is absent."""
    result = None
    for source, target in mapping.items():
        result = (F if result is None else result).when(key == F.lit(source), F.lit(target))
    return F.lit(default) if result is None else result.otherwise(F.lit(default))


def rounded(value: Column, digits: int = 4) -> Column:
    return F.round(value, digits)


def at_threshold(score: Column, threshold: float = 0.5) -> Column:
    """Class 1 for scores strictly above the threshold."""
    return (score > threshold).cast("int")


def _literal(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
