from tablecraft.functions.aggregates import (
    count_if,
    money,
    sum_if,
)
from tablecraft.functions.dates import as_date, shift_date, within_dates
from tablecraft.functions.scalars import (
    at_threshold,
    flag,
    log1p,
    map_value,
    null_if,
    or_zero,
    rounded,
    safe_divide,
    tier,
    to_double,
)

__all__ = [
    "as_date",
    "at_threshold",
    "count_if",
    "flag",
    "log1p",
    "map_value",
    "money",
    "null_if",
    "or_zero",
    "rounded",
    "safe_divide",
    "shift_date",
    "sum_if",
    "tier",
    "to_double",
    "within_dates",
]
