"""Canonical inputs derived from a star schema of orders, parts and events.

The library's plans take ``raw_orders``, ``raw_returns``, ``raw_inventory``,
``raw_interactions`` and event tables. This module maps the generic tables the
checks and the benchmark run on to those inputs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.functions import as_date, money, within_dates
from tablecraft.operators.behavior import user_behavioral


# Declared, so that opening a table starts no job to read file footers.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


class StarSchema:
    """Lazy access to the tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.directory}/{name}.parquet")

    def raw_orders(
        self, start: str | dt.date | None = None, end: str | dt.date | None = None
    ) -> DataFrame:
        """One row per order with lines; category is the type of its lowest part key.

        The line table is reduced to one row per order before the join, with a
        map-side combine, so an order with very many lines costs no more than
        any other. The join on the order comes last: the result is partitioned
        by order, which later joins on the order reuse.

        With ``start`` or ``end``, orders of these dates only (``end`` included). Their
        keys then thin out the lines before these are reduced; it takes another
        scan of the keys and dates, and is meant for few of the orders.
        """
        dated = self.table("orders")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        if start is not None or end is not None:
            dated = dated.where(within_dates(dated, "o_orderdate", start, end))
            wanted = dated.select(F.col("o_orderkey").alias("l_orderkey"))
            lines = lines.join(wanted, "l_orderkey", "left_semi")
        first_part = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.min("l_partkey").alias("p_partkey")
        )
        parts = self.table("part").select("p_partkey", F.col("p_type").alias("category"))
        categories = first_part.join(parts, "p_partkey").select("order_id", "category")
        regions = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("customer_id"), F.col("r_name").alias("region"))
        )
        orders = dated.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderdate").alias("order_date"),
        )
        return (
            orders.join(regions, "customer_id")
            .join(categories, "order_id")
            .select("order_id", "customer_id", "category", "amount", "region", "order_date")
        )

    def raw_returns(self) -> DataFrame:
        """Returned lines; the refund is the discounted price, to the cent."""
        price = money(F.col("l_extendedprice"))
        refund = price * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
        return (
            self.table("lineitem")
            .where(F.col("l_returnflag") == "R")
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("return_id"),
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linestatus").alias("reason"),
                money(refund).cast("double").alias("refund_amount"),
                F.col("l_shipdate").alias("return_date"),
            )
        )

    def raw_inventory(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_type").alias("category"),
            F.col("p_size").cast("bigint").alias("stock_count"),
            F.col("p_brand").alias("warehouse"),
        )

    def raw_interactions(self) -> DataFrame:
        return self.table("events").select(
            "user_id",
            F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
            F.col("event_type").alias("interaction_type"),
            "ts",
        )

    def raw_user_events(
        self, snapshot_dates: Sequence[str | dt.date], churn_days: int = 2
    ) -> DataFrame:
        """Behaviour snapshots labelled by "no purchase in the next ``churn_days`` days"."""
        dates = [as_date(value) for value in snapshot_dates]
        events = self.table("events")
        snapshots = user_behavioral(events, dates)
        horizon_end = max(dates) + dt.timedelta(days=churn_days)
        event_date = F.to_date("ts")
        buyers = (
            events.where(within_dates(events, "ts", min(dates), horizon_end))
            .where(F.col("event_type") == "purchase")
            .select(
                "user_id",
                event_date.alias("bought_on"),
                F.explode(F.array(*[F.lit(d) for d in dates])).alias("feature_date"),
            )
            .where(
                (F.col("bought_on") > F.col("feature_date"))
                & (F.col("bought_on") <= F.date_add("feature_date", churn_days))
            )
            .groupBy("user_id", "feature_date")
            .agg(F.lit(False).alias("bought_nothing"))
        )
        return snapshots.join(buyers, ["user_id", "feature_date"], "left").select(
            "user_id",
            "session_count_7d",
            "session_count_30d",
            "total_purchases_30d",
            "days_since_last_login",
            "support_tickets_90d",
            "avg_session_duration_s",
            F.coalesce("bought_nothing", F.lit(True)).alias("churned_within_30d"),
            F.col("feature_date").alias("event_date"),
        )
