import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecraft import functions as fn


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_safe_divide(spark):
    lit = F.lit
    assert value(spark, fn.safe_divide(lit(100), lit(100))) == 1.0
    assert value(spark, fn.safe_divide(lit(1), lit(2))) == 0.5
    assert value(spark, fn.safe_divide(lit(2), lit(0))) is None
    assert value(spark, fn.safe_divide(lit(0.0), lit(0.0))) is None
    assert value(spark, fn.safe_divide(lit(None), lit(3))) is None
    assert value(spark, fn.safe_divide(lit(3), lit(None))) is None


def test_null_handling(spark):
    assert value(spark, fn.null_if(F.lit(0), 0)) is None
    assert value(spark, fn.null_if(F.lit(3), 0)) == 3
    assert value(spark, fn.or_zero(F.lit(None).cast("double"))) == 0.0
    assert value(spark, fn.flag(F.lit(None).cast("boolean"))) == 0
    assert value(spark, fn.flag(F.lit(True))) == 1


def test_log1p(spark):
    assert value(spark, fn.log1p(F.lit(0.0))) == 0.0
    assert value(spark, fn.log1p(F.lit(1.0))) == pytest.approx(0.6931471805599453)
    assert value(spark, fn.log1p(F.lit(-1.0))) is None
    assert value(spark, fn.log1p(F.lit(-2.0))) is None
    assert value(spark, fn.log1p(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize(
    "stock, level", [(9, "LOW"), (10, "MEDIUM"), (49, "MEDIUM"), (50, "HIGH"), (None, "HIGH")]
)
def test_tier(spark, stock, level):
    assert value(spark, fn.tier(F.lit(stock).cast("bigint"))) == level


@pytest.mark.parametrize(
    "start, amount, unit, expected",
    [
        ("2024-01-01", -90, "DAY", "2023-10-03"),
        ("2024-02-28", 2, "day", "2024-03-01"),
        ("2024-01-10", -1, "WEEK", "2024-01-03"),
        ("2024-03-31", -1, "MONTH", "2024-02-29"),
        ("2024-11-30", 1, "QUARTER", "2025-02-28"),
        ("2024-02-29", -1, "YEAR", "2023-02-28"),
    ],
)
def test_shift_date(spark, start, amount, unit, expected):
    got = value(spark, fn.shift_date(F.lit(start), amount, unit))
    assert got == dt.date.fromisoformat(expected)


def test_shift_date_rejects_other_units(spark):
    with pytest.raises(ValueError, match="HOUR"):
        fn.shift_date(F.lit("2024-01-01"), 1, "HOUR")


def test_map_value(spark):
    weights = {"view": 1, "purchase": 3}
    assert value(spark, fn.map_value(F.lit("purchase"), weights, 1)) == 3
    assert value(spark, fn.map_value(F.lit("signup"), weights, 1)) == 1
    assert value(spark, fn.map_value(F.lit(None).cast("string"), weights, 1)) == 1
    assert value(spark, fn.map_value(F.lit("x"), {}, 7)) == 7


def test_threshold_is_strict(spark):
    assert value(spark, fn.at_threshold(F.lit(0.5))) == 0
    assert value(spark, fn.at_threshold(F.lit(0.5000001))) == 1


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "string"])
def test_within_dates_includes_both_days(spark, kind):
    stamps = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    df = spark.createDataFrame([(s,) for s in stamps], "d string").select(
        F.col("d").cast(kind).alias("d")
    )
    kept = df.where(fn.within_dates(df, "d", "2024-01-02", dt.date(2024, 1, 3)))
    assert kept.count() == 2
    assert df.where(fn.within_dates(df, "d", "2024-01-02", None)).count() == 3
    assert df.where(fn.within_dates(df, "d", None, "2024-01-02")).count() == 2
    assert df.where(fn.within_dates(df, "d", None, None)).count() == 4


def test_as_date():
    assert fn.as_date("2024-01-02") == dt.date(2024, 1, 2)
    assert fn.as_date(dt.datetime(2024, 1, 2, 3)) == dt.date(2024, 1, 2)
    with pytest.raises(ValueError):
        fn.as_date("01/02/2024")
