import datetime as dt
import math

import pytest
import retail_data as data
from results import rows
from pyspark.sql import functions as F

from tablecraft.operators.quality import QualityError, assert_non_empty, assert_unique
from tablecraft.plans import retail
from tablecraft.sources.schemas import RAW_ORDERS, RAW_RETURNS


def composite(orders, inventory, returns, start, end=None):
    staged_orders = retail.extract_orders(orders, start, end)
    staged_returns = retail.extract_returns(returns, start, end)
    return retail.build_report(
        retail.agg_revenue(staged_orders),
        retail.check_stock(retail.extract_inventory(inventory)),
        retail.agg_refunds(staged_returns, staged_orders),
    )


EXPECTED = [
    ("Clothing", "US-East", 7, 484.93, 69.2757, 620, 5, 274.95),
    ("Electronics", "US-West", 7, 3349.93, 478.5614, 455, 0, 0.0),
    ("Home", "EU-West", 6, 929.94, 154.99, 133, 3, 179.97),
]


@pytest.mark.parametrize("report", [composite, retail.daily_report])
def test_known_day(spark, report):
    result = report(data.orders(spark), data.inventory(spark), data.returns(spark), data.DAY)
    # Amounts are doubles, and so is their exact sum: to the cent it is the known one.
    cents = {c: F.round(c, 2) for c in ("total_revenue", "total_refunds")}
    average = F.round("avg_order_value", 4)
    got = rows(result.withColumns({**cents, "avg_order_value": average}), "category")
    assert got == EXPECTED


@pytest.mark.parametrize("report", [composite, retail.daily_report])
def test_other_day_is_empty(spark, report):
    result = report(data.orders(spark), data.inventory(spark), data.returns(spark), "2026-03-02")
    assert result.count() == 0


def test_refund_aggregate(spark):
    refunds = retail.agg_refunds(data.returns(spark), data.orders(spark))
    result = refunds.withColumn("avg_refund", F.round("avg_refund", 4))
    assert rows(result) == [("Clothing", 5, 274.95, 54.99), ("Home", 3, 179.97, 59.99)]


def test_stock_levels(spark):
    result = retail.check_stock(data.inventory(spark))
    assert rows(result) == [
        ("Clothing", "EU-West", 120, "HIGH"),
        ("Clothing", "US-East", 300, "HIGH"),
        ("Clothing", "US-West", 200, "HIGH"),
        ("Electronics", "EU-West", 25, "MEDIUM"),
        ("Electronics", "US-East", 80, "HIGH"),
        ("Electronics", "US-West", 350, "HIGH"),
        ("Home", "EU-West", 50, "HIGH"),
        ("Home", "US-East", 8, "LOW"),
        ("Home", "US-West", 75, "HIGH"),
    ]


def test_revenue_order(spark):
    ranked = retail.by_revenue(retail.agg_revenue(data.orders(spark)))
    assert [r.category for r in ranked.collect()] == ["Electronics", "Home", "Clothing"]


def _order(n, category, region="R1", day="2026-03-01", amount=10.0):
    return (f"O{n}", "C", category, amount, region, dt.date.fromisoformat(day))


def _return(n, order, amount=1.0, day="2026-03-01"):
    return (f"T{n}", f"O{order}", "x", amount, dt.date.fromisoformat(day))


def test_edge_categories(spark):
    """Two regions repeat the category totals; NULL and stockless categories get 0."""
    orders = spark.createDataFrame(
        [
            _order(1, "Clothing"),
            _order(2, "Clothing", "R2"),
            _order(3, "Unstocked"),
            _order(4, None),
            _order(5, "Home", amount=None),
        ],
        RAW_ORDERS,
    )
    returns = spark.createDataFrame(
        [_return(1, 1), _return(2, 4), _return(3, 5, None), _return(4, 99)], RAW_RETURNS
    )
    args = (orders, data.inventory(spark), returns, "2026-03-01")
    expected = [
        (None, "R1", 1, 10.0, 10.0, 0, 0, 0.0),
        ("Clothing", "R1", 1, 10.0, 10.0, 620, 1, 1.0),
        ("Clothing", "R2", 1, 10.0, 10.0, 620, 1, 1.0),
        ("Home", "R1", 1, None, None, 133, 1, 0.0),
        ("Unstocked", "R1", 1, 10.0, 10.0, 0, 0, 0.0),
    ]
    assert rows(composite(*args), "category", "region") == expected
    assert rows(retail.daily_report(*args), "category", "region") == expected


def test_refund_needs_both_dates_in_range(spark):
    orders = spark.createDataFrame([_order(1, "A", day="2026-03-01")], RAW_ORDERS)
    returns = spark.createDataFrame([_return(1, 1, day="2026-03-04")], RAW_RETURNS)
    args = (orders, data.inventory(spark), returns)
    assert retail.daily_report(*args, "2026-03-01").first().refund_count == 0
    assert retail.daily_report(*args, "2026-03-01", "2026-03-04").first().refund_count == 1


@pytest.mark.parametrize("report", [composite, retail.daily_report])
def test_reports_agree_on_odd_amounts(spark, report):
    """Amounts below a cent, with endless fractions, very large, NaN and infinite."""
    amounts = {"A": [1 / 3, 1e14, 0.004], "B": [float("nan"), 1.0], "C": [float("inf")]}
    orders, returns = [], []
    for category, values in amounts.items():
        for value in values:
            n = len(orders)
            orders.append(_order(n, category, f"R{n % 2}", amount=value))
            returns += [_return(n, n, value / 3), _return(100 + n, n, 0.004)]
    args = (
        spark.createDataFrame(orders, RAW_ORDERS),
        data.inventory(spark),
        spark.createDataFrame(returns, RAW_RETURNS),
        "2026-03-01",
    )
    got = {(r.category, r.region): r for r in report(*args).collect()}
    assert got["A", "R0"].total_revenue == math.fsum([1 / 3, 0.004])
    refunds = [v / 3 for v in amounts["A"]] + [0.004] * 3
    assert got["A", "R1"].total_refunds == got["A", "R0"].total_refunds == math.fsum(refunds)
    assert got["B", "R1"].total_revenue != got["B", "R1"].total_revenue  # NaN
    assert got["B", "R0"].total_refunds != got["B", "R0"].total_refunds
    assert got["C", "R1"].total_revenue == got["C", "R1"].total_refunds == float("inf")


def test_order_with_a_third_of_all_returns(spark):
    returns = spark.range(30_000).select(
        F.col("id").cast("string").alias("return_id"),
        F.when(F.col("id") % 3 == 0, "ORD001")
        .otherwise(F.format_string("ORD%03d", F.col("id") % 20 + 1))
        .alias("order_id"),
        F.lit("x").alias("reason"),
        F.lit(0.1).alias("refund_amount"),
    )
    refunds = retail.agg_refunds(returns, data.orders(spark))
    result = refunds.withColumn("avg_refund", F.round("avg_refund", 4))
    plain = (
        returns.join(data.orders(spark), "order_id")
        .groupBy("category")
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum("refund_amount"), 2).alias("total"),
            F.lit(0.1).alias("average"),
        )
    )
    assert rows(result) == rows(plain)


def test_timestamp_day_is_whole(spark):
    orders = data.orders(spark).withColumn(
        "order_date", F.lit("2026-03-01 23:59:59.5").cast("timestamp_ntz")
    )
    staged = retail.extract_orders(orders, data.DAY)
    assert staged.count() == 20
    assert dict(staged.dtypes)["order_date"] == "date"


def test_quality_checks(spark):
    orders = data.orders(spark)
    assert assert_unique(orders, ["order_id"]) is orders
    with pytest.raises(QualityError, match="duplicate key"):
        assert_unique(orders, ["category"])
    with pytest.raises(QualityError, match="orders is empty"):
        assert_non_empty(orders.where("false"), "orders")


def test_repeated_keys_are_an_error_before_they_fan_out(spark):
    orders = spark.createDataFrame(
        [(1, "a"), (2, "b"), (None, "a"), (None, "b")], "order_id long, category string"
    )
    returns = spark.createDataFrame(
        [(1, 5.0), (1, 2.5), (None, 7.0)], "order_id long, refund_amount double"
    )
    refunds = retail.agg_refunds(returns, orders)
    assert [tuple(r) for r in refunds.collect()] == [("a", 2, 7.5, 3.75)]
    with pytest.raises(Exception, match="orders: duplicate key .*order_id.*: 1"):
        retail.agg_refunds(returns, orders.union(orders)).collect()

    stock = spark.createDataFrame([("a", "w", 3)], "category string, warehouse string, total_stock long")
    revenue = spark.createDataFrame(
        [("a", "r", 1, 2.0, 2.0)],
        "category string, region string, order_count long, total_revenue double, avg_order_value double",
    )
    assert retail.build_report(revenue, stock, refunds).first().total_refunds == 7.5
    with pytest.raises(Exception, match="refunds: duplicate key .*category.*: a"):
        retail.build_report(revenue, stock, refunds.union(refunds)).collect()
