"""Retail sales report: extracts, aggregates, and the fan-in report.

A refund counts only if its order and its return both fall in the extracted
dates. Stock and refunds join by category, so each region of a category repeats
the category's totals: do not add those columns up over regions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.functions import or_zero, tier, within_dates
from tablecraft.operators.exact import add_up, digits, exact_totals, total
from tablecraft.operators.quality import unique_for_join


def extract_orders(
    orders: DataFrame, run_date: str | dt.date, end_date: str | dt.date | None = None
) -> DataFrame:
    """Orders of one day, or of ``run_date..end_date`` inclusive."""
    return orders.where(within_dates(orders, "order_date", run_date, end_date or run_date)).select(
        "order_id",
        "customer_id",
        "category",
        "amount",
        "region",
        F.to_date("order_date").alias("order_date"),
    )


def extract_returns(
    returns: DataFrame, run_date: str | dt.date, end_date: str | dt.date | None = None
) -> DataFrame:
    """Returns of one day, or of ``run_date..end_date`` inclusive."""
    in_range = within_dates(returns, "return_date", run_date, end_date or run_date)
    return returns.where(in_range).select(
        "return_id",
        "order_id",
        "reason",
        "refund_amount",
        F.to_date("return_date").alias("return_date"),
    )


def extract_inventory(inventory: DataFrame) -> DataFrame:
    return inventory.select("item_id", "category", "stock_count", "warehouse")


def agg_revenue(staged_orders: DataFrame) -> DataFrame:
    """Order count, revenue and average order value by category and region.

    Unsorted: a stored table has no row order. Sort with ``by_revenue`` to present.
    """
    amount = F.col("amount")
    return exact_totals(
        staged_orders,
        ["category", "region"],
        sums={"total_revenue": amount},
        averages={"avg_order_value": amount},
        counts={"order_count": F.count("*")},
    )


def by_revenue(revenue: DataFrame) -> DataFrame:
    return revenue.orderBy(F.desc("total_revenue"))


def agg_refunds(staged_returns: DataFrame, staged_orders: DataFrame) -> DataFrame:
    """Refund count, total and average by the category of the returned order.

    Returns are summed per order before the join, so an order with very many
    returns reaches the join as one row, or a few if amounts differ widely in size.
    A repeated order would count its refunds again, and is an error.
    """
    orders = unique_for_join(staged_orders.select("order_id", "category"), ["order_id"], "orders")
    joined = orders.join(_refunds_per_order(staged_returns), "order_id")
    counts = {"refund_count": F.sum("refunds"), "amounts": F.sum("amounts")}
    per_band = add_up(joined, ["category"], ["refunded"], counts)
    totals = per_band.groupBy("category").agg(
        F.sum("refund_count").alias("refund_count"),
        F.sum("amounts").cast("double").alias("amounts"),
        F.collect_list("refunded").alias("refunded"),
    )
    totals = totals.withColumn("total_refunds", total("refunded"))
    return totals.select(
        "category",
        "refund_count",
        "total_refunds",
        F.try_divide("total_refunds", "amounts").alias("avg_refund"),
    )


def check_stock(staged_inventory: DataFrame, low: int = 10, medium: int = 50) -> DataFrame:
    """Stock by category and warehouse with its LOW / MEDIUM / HIGH label."""
    return (
        staged_inventory.groupBy("category", "warehouse")
        .agg(F.sum("stock_count").alias("total_stock"))
        .withColumn("stock_level", tier(F.col("total_stock"), low, medium))
    )


def build_report(revenue: DataFrame, stock: DataFrame, refunds: DataFrame) -> DataFrame:
    """Revenue rows with the stock and refunds of their category (0 if none).

    Stock is aggregated to one row per category first; joining it per warehouse
    would repeat the revenue rows. So would refunds that hold a category twice,
    which are an error.
    """
    refunds = refunds.select("category", "refund_count", "total_refunds")
    return (
        revenue.join(_stock_per_category(stock), "category", "left")
        .join(unique_for_join(refunds, ["category"], "refunds"), "category", "left")
        .select(*_REVENUE_COLUMNS, *_filled("total_stock", "refund_count", "total_refunds"))
    )


def daily_report(
    orders: DataFrame,
    inventory: DataFrame,
    returns: DataFrame,
    run_date: str | dt.date,
    end_date: str | dt.date | None = None,
) -> DataFrame:
    """The whole report in one pass over the orders.

    Gives what ``build_report`` gives on the three aggregates, for unique
    ``order_id``. Refunds, reduced to one row per order, ride along with the
    orders: each order becomes a row for its amount and one for each band of its
    refunds, and both are added up by the same aggregate. So orders are scanned
    and shuffled once; the category totals come from the small aggregated table.
    """
    staged_orders = extract_orders(orders, run_date, end_date)
    refunds = _refunds_per_order(extract_returns(returns, run_date, end_date))
    refunds = refunds.groupBy("order_id").agg(
        F.collect_list(F.struct("refunded", "refunds")).alias("bands")
    )
    own = F.struct(
        F.lit(True).alias("sold"),
        digits("amount").alias("value"),
        F.lit(0).cast("bigint").alias("refunds"),
    )
    paid_back = F.transform(
        F.coalesce("bands", F.array()),
        lambda r: F.struct(
            F.lit(False).alias("sold"), r["refunded"].alias("value"), r["refunds"].alias("refunds")
        ),
    )
    facts = (
        staged_orders.select("order_id", "category", "region", "amount")
        .join(refunds, "order_id", "left")
        .select("category", "region", F.explode(F.concat(F.array(own), paid_back)).alias("fact"))
        .select("category", "region", "fact.*")
    )
    per_band = add_up(
        facts,
        ["category", "region", "sold"],
        ["value"],
        {
            "orders": F.count_if("sold"),
            "amounts": F.count_if(F.col("sold") & F.col("value.band").isNotNull()),
            "refunds": F.sum("refunds"),
        },
    )
    per_region = per_band.groupBy("category", "region").agg(
        F.sum("orders").alias("order_count"),
        F.sum("amounts").cast("double").alias("amounts"),
        F.sum("refunds").alias("refunds"),
        F.collect_list(F.when(F.col("sold"), F.col("value"))).alias("sold"),
        F.collect_list(F.when(~F.col("sold"), F.col("value"))).alias("refunded"),
    )
    category = Window.partitionBy("category")
    # A NULL category joins nothing, so it has no refunds either.
    named = F.col("category").isNotNull()
    with_category = per_region.withColumns(
        {
            "total_revenue": total("sold"),
            "refund_count": F.sum("refunds").over(category),
            "refunded": F.flatten(F.collect_list("refunded").over(category)),
        }
    )
    revenue = with_category.withColumn(
        "avg_order_value", F.try_divide("total_revenue", "amounts")
    ).select(
        *_REVENUE_COLUMNS,
        F.when(named, F.col("refund_count")).alias("refund_count"),
        F.when(named, total("refunded")).alias("total_refunds"),
    )
    stock = inventory.groupBy("category").agg(F.sum("stock_count").alias("total_stock"))
    return revenue.join(stock, "category", "left").select(
        *_REVENUE_COLUMNS, *_filled("total_stock", "refund_count", "total_refunds")
    )


_REVENUE_COLUMNS = ("category", "region", "order_count", "total_revenue", "avg_order_value")


def _refunds_per_order(staged_returns: DataFrame) -> DataFrame:
    """Counts and digit sums of the refunds of each order, a row for each band."""
    split = staged_returns.select("order_id", digits("refund_amount").alias("refunded"))
    counts = {"refunds": F.count("*"), "amounts": F.count("refunded.band")}
    return add_up(split, ["order_id"], ["refunded"], counts)


def _stock_per_category(stock: DataFrame) -> DataFrame:
    return stock.groupBy("category").agg(F.sum("total_stock").alias("total_stock"))


def _filled(*columns: str):
    return [or_zero(F.col(c)).alias(c) for c in columns]
