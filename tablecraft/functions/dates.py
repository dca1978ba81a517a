"""Date arithmetic and date-range predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DAYS = {"DAY": 1, "WEEK": 7}
_MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def as_date(value: str | dt.date) -> dt.date:
    """A calendar date from an ISO string or a date; anything else is rejected."""
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def shift_date(value: Column, amount: int, unit: str = "DAY") -> Column:
    """Move a date by ``amount`` units; months clamp to the month's last day.

    Negative amounts go back, so this is both date addition and subtraction.
    """
    day = value.cast("date")
    unit = unit.upper()
    if unit in _DAYS:
        return F.date_add(day, amount * _DAYS[unit])
    if unit in _MONTHS:
        return F.add_months(day, amount * _MONTHS[unit])
    raise ValueError(f"unsupported date unit {unit!r}; use {sorted([*_DAYS, *_MONTHS])}")


def within_dates(
    df: DataFrame, column: str, start: str | dt.date | None, end: str | dt.date | None
) -> Column:
    """Calendar dates ``start..end``, both included; ``None`` leaves a side open.

    On a timestamp column the bounds become a half-open range on the column
    itself, so the last day is whole and the predicate still reaches the
    Parquet scan (a cast around the column would keep it out).
    """
    kind = df.schema[column].dataType
    ref = F.col(column)
    bounds = []
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if start is not None:
            bounds.append(ref >= F.lit(str(as_date(start))).cast(kind))
        if end is not None:
            after = as_date(end) + dt.timedelta(days=1)
            bounds.append(ref < F.lit(str(after)).cast(kind))
    else:
        if not isinstance(kind, T.DateType):
            ref = ref.cast("date")
        if start is not None:
            bounds.append(ref >= F.lit(as_date(start)))
        if end is not None:
            bounds.append(ref <= F.lit(as_date(end)))
    condition = F.lit(True)
    for position, bound in enumerate(bounds):
        condition = bound if position == 0 else condition & bound
    return condition
