"""Item engagement kept fresh from a stream of interactions.

The stream keeps counts per item and calendar day, and stores the days that
changed. A window of days is a sum over stored days, so one store answers every
``as_of`` and every window length, and the state holds each event once, not once
for each window it falls in.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.functions import as_date, count_if, safe_divide, within_dates
from tablecraft.operators.quality import QualityError
from tablecraft.session import materialize
from tablecraft.sources.versioned import read_version, write_version

_DAY_SECONDS = 86_400


def daily_counts(interactions: DataFrame, lateness: str) -> DataFrame:
    """``item_id, day_start, views, purchases`` of a stream, per item and calendar day.

    ``day_start`` is the day as a UTC midnight whatever the session's time zone.
    A day leaves the state once the newest day seen is ``lateness`` past it; rows
    that come even later are dropped. Rows without an item or a time take no part.
    """
    day_start = F.timestamp_seconds(F.unix_date(F.to_date("ts")) * _DAY_SECONDS)
    kind = F.col("interaction_type")
    return (
        interactions.where(F.col("item_id").isNotNull() & F.col("ts").isNotNull())
        .withColumn("day_start", day_start)
        .withWatermark("day_start", lateness)
        .groupBy("item_id", "day_start")
        .agg(count_if(kind == "view").alias("views"), count_if(kind == "purchase").alias("purchases"))
    )


def sync_item_engagement(
    spark: SparkSession,
    interactions: DataFrame,
    view: str,
    checkpoint: str,
    lateness: str = "7 days",
) -> None:
    """Count what is new in a stream of ``item_id, interaction_type, ts``, then return.

    A batch gives the whole count of each item and day it changes, and only those
    days are rewritten, as a new version. So a batch that is repeated after a
    failure stores the same counts again.
    """
    day = F.date_from_unix_date((F.unix_seconds("day_start") / _DAY_SECONDS).cast("int"))

    def store(batch: DataFrame, batch_id: int) -> None:
        changed = materialize(
            batch.select("item_id", "views", "purchases", day.alias("day")), "engagement-batch"
        )
        if not changed.isEmpty():
            write_version(changed, view, ["item_id", "day"], "day", "WRITE_APPEND")

    query = (
        daily_counts(interactions, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_item_engagement(
    spark: SparkSession, view: str, as_of: str | dt.date, version: int | None = None
) -> DataFrame:
    """What ``item_engagement`` gives for all interactions synced so far.

    The dates are a partition column, so other days are not read.
    """
    days = read_version(spark, view, version)
    if days is None:
        raise QualityError(f"nothing was synced into {view} yet")
    last = as_date(as_of)
    week = F.col("day") > F.lit(last - dt.timedelta(days=7))
    totals = (
        days.where(within_dates(days, "day", last - dt.timedelta(days=29), last))
        .groupBy("item_id")
        .agg(
            F.sum(F.when(week, F.col("views")).otherwise(0)).alias("view_count_7d"),
            F.sum("views").alias("views"),
            F.sum("purchases").alias("purchase_count_30d"),
        )
    )
    return totals.select(
        "item_id",
        "view_count_7d",
        "purchase_count_30d",
        safe_divide(F.col("purchase_count_30d"), F.col("views")).alias("conversion_rate_30d"),
    )
