"""Rolling features of users and items, computed from raw events.

An n-day window at ``as_of`` covers the event dates ``d`` with
``as_of - n < d <= as_of``: exactly n calendar dates.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.functions import as_date, count_if, safe_divide, within_dates
from tablecraft.operators.exact import digits, total

LOOKBACK_DAYS = 90
PURCHASE_DAYS = 30
SESSION_DAYS = 7
SESSION_GAP_SECONDS = 6 * 3600
# With a longer gap, a session that the lookback cuts could start anew inside
# the days in which sessions are counted.
LONGEST_GAP_SECONDS = (LOOKBACK_DAYS - PURCHASE_DAYS - 1) * 86_400


def user_behavioral(
    events: DataFrame,
    as_of: str | dt.date | Sequence[str | dt.date],
    session_gap_seconds: int = SESSION_GAP_SECONDS,
    login_types: Sequence[str] = ("view", "click"),
    ticket_types: Sequence[str] = ("error",),
    purchase_type: str = "purchase",
) -> DataFrame:
    """Sessions, purchases, last login and tickets per user and snapshot date.

    ``events`` has user_id, ts, event_type, value. A session ends after
    ``session_gap_seconds`` without an event; it belongs to the date it starts.
    Every user with an event up to the snapshot has a row, however long ago it
    was; the last login is looked for in the whole history.

    Two events of one user inside the same slot of ``session_gap_seconds`` are
    always in the same session, so events are first reduced to one row per
    user, date and slot with a map-side combine (and to one per user for all
    dates before the lookback). The session window then sees a number of rows
    per user bounded by the calendar, however active the user.

    Sessions are found once, whatever the number of snapshots: counts, tickets
    and purchases of a snapshot are sums over the days of its window. A session
    that is open at a snapshot counts as long as it has lasted by then. For
    that, each day of a session adds its seconds on that day, and takes them
    back when the session's start leaves the window.
    """
    if not 0 < session_gap_seconds <= LONGEST_GAP_SECONDS:
        raise ValueError(f"a session gap has from 1 to {LONGEST_GAP_SECONDS} seconds")
    single = isinstance(as_of, (str, dt.date))
    dates = sorted({as_date(value) for value in ([as_of] if single else as_of)})
    slots = _slots(events, dates, session_gap_seconds, login_types, ticket_types, purchase_type)
    days = _user_days(slots, session_gap_seconds)
    return _at_snapshots(days, dates)


def _slots(
    events: DataFrame,
    dates: Sequence[dt.date],
    gap_seconds: int,
    login_types: Sequence[str],
    ticket_types: Sequence[str],
    purchase_type: str,
) -> DataFrame:
    """One row per user, date, slot and band of amounts; ``day`` counts from 1970.

    All events before the lookback of the first snapshot are one row of a user
    without date, which keeps the last login only.
    """
    oldest = dates[0] - dt.timedelta(days=LOOKBACK_DAYS - 1)
    date = F.to_date("ts")
    inside = date >= F.lit(oldest)
    known = events.where(within_dates(events, "ts", None, dates[-1])).select(
        "user_id",
        "ts",
        date.alias("date"),
        F.when(inside, date).alias("event_date"),
        F.when(inside, _slot_of_day(events, gap_seconds)).alias("slot"),
        (inside & F.col("event_type").isin(*ticket_types)).alias("ticket"),
        F.col("event_type").isin(*login_types).alias("login"),
        F.when(inside & (F.col("event_type") == purchase_type), F.col("value")).alias("paid"),
    )
    split = known.withColumn("paid", digits("paid"))
    parts = ("high", "middle", "low")
    return split.groupBy(
        "user_id", "event_date", "slot", F.col("paid.band").alias("band")
    ).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("date").alias("first_date"),
        F.max(F.when(F.col("login"), F.col("date"))).alias("last_login"),
        count_if(F.col("ticket")).alias("tickets"),
        *[F.sum(f"paid.{part}").alias(part) for part in parts],
    )


def _user_days(slots: DataFrame, gap_seconds: int) -> DataFrame:
    """What each day of a session adds, and one row for a user's earlier events."""
    timeline = Window.partitionBy("user_id").orderBy("first_ts", "last_ts", "band")
    before = timeline.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("event_date").isNotNull(), F.col("last_ts"))
    idle = F.col("first_ts") - F.max(seen).over(before)
    gap = F.expr(f"INTERVAL '{gap_seconds}' SECOND")
    opens = F.col("event_date").isNotNull() & F.coalesce(idle >= gap, F.lit(True))
    so_far = timeline.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = slots.withColumns(
        {"opens": opens.cast("int"), "leads": F.row_number().over(timeline) == 1}
    )
    numbered = marked.withColumn("session_no", F.sum("opens").over(so_far))
    paid = F.when(F.col("band").isNotNull(), F.struct("band", "high", "middle", "low"))
    days = numbered.groupBy("user_id", "session_no", "event_date").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min("first_date").alias("first_date"),
        F.max("last_login").alias("last_login"),
        F.max("leads").alias("leads"),
        F.sum("tickets").alias("tickets"),
        F.collect_list(paid).alias("paid"),
    )
    session = Window.partitionBy("user_id", "session_no").orderBy(F.asc_nulls_last("event_date"))
    whole = session.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    started = F.min(F.when(F.col("event_date").isNotNull(), F.col("first_ts"))).over(whole)
    last = F.coalesce(F.lag("last_ts").over(session), "first_ts")
    return days.withColumns(
        {"started_on": F.to_date(started), "seconds": _seconds(F.col("last_ts") - last)}
    ).drop("first_ts", "last_ts")


def _at_snapshots(days: DataFrame, dates: Sequence[dt.date]) -> DataFrame:
    """Windows over the days of a user, read off at the snapshots."""
    none, nothing = F.lit(0).cast("bigint"), F.lit(0).cast("decimal(20,6)")
    no_date = F.lit(None).cast("date")
    empty = F.array().cast(days.schema["paid"].dataType)

    def row(day: Column, date: Column = no_date, **known: Column) -> Column:
        fields = {"started": none, "tickets": none, "seconds": nothing, "paid": empty,
                  "last_login": no_date, "first_date": no_date} | known
        columns = [value.alias(name) for name, value in fields.items()]
        return F.struct(F.unix_date(day).alias("day"), date.alias("feature_date"), *columns)

    # Rows from before the lookback lie before every window of days.
    long_ago = F.lit(dates[0] - dt.timedelta(days=2 * LOOKBACK_DAYS))
    on = F.coalesce("event_date", long_ago)
    dated = F.col("event_date").isNotNull()
    first = dated & (F.col("event_date") == F.col("started_on"))
    gone_on = F.date_add("started_on", SESSION_DAYS)
    counted = dated & (F.col("event_date") < gone_on)
    own = row(
        on,
        started=F.when(first, 1).otherwise(0).cast("bigint"),
        tickets=F.col("tickets"),
        seconds=F.when(counted, F.col("seconds")).otherwise(nothing),
        paid=F.col("paid"),
        last_login=F.col("last_login"),
        first_date=F.col("first_date"),
    )
    back = row(gone_on, seconds=-F.col("seconds"))
    asked = F.array(*[row(F.lit(date), F.lit(date)) for date in dates])
    taken_back = F.when(counted, F.array(back))
    questions = F.when(F.col("leads"), asked)
    rows = F.flatten(F.array_compact(F.array(F.array(own), taken_back, questions)))
    events = days.select("user_id", F.explode(rows).alias("r")).select("user_id", "r.*")

    by_day = Window.partitionBy("user_id").orderBy("day")

    def within(count: int) -> Window:
        return by_day.rangeBetween(1 - count, 0)

    so_far = by_day.rangeBetween(Window.unboundedPreceding, 0)
    recent = F.sum("started").over(within(SESSION_DAYS))
    read = events.select(
        "user_id",
        "feature_date",
        recent.alias("session_count_7d"),
        F.sum("started").over(within(PURCHASE_DAYS)).alias("session_count_30d"),
        F.flatten(F.collect_list("paid").over(within(PURCHASE_DAYS))).alias("paid"),
        F.datediff("feature_date", F.max("last_login").over(so_far))
        .cast("bigint")
        .alias("days_since_last_login"),
        F.sum("tickets").over(within(LOOKBACK_DAYS)).alias("support_tickets_90d"),
        safe_divide(F.sum("seconds").over(so_far), recent).alias("avg_session_duration_s"),
        F.min("first_date").over(so_far).alias("first_date"),
    )
    return read.where(F.col("feature_date").isNotNull() & F.col("first_date").isNotNull()).select(
        "user_id",
        "feature_date",
        "session_count_7d",
        "session_count_30d",
        F.coalesce(total("paid"), F.lit(0.0)).alias("total_purchases_30d"),
        "days_since_last_login",
        "support_tickets_90d",
        "avg_session_duration_s",
    )


def user_demographic(
    customers: DataFrame,
    orders: DataFrame,
    as_of: str | dt.date,
    premium_above: float,
) -> DataFrame:
    """Country, account age since the first order, and premium status.

    ``customers`` has user_id, country, balance; ``orders`` has user_id and
    order_date. Orders shrink to one row per user before the join.
    """
    day = F.lit(as_date(as_of))
    known = orders.where(within_dates(orders, "order_date", None, as_date(as_of)))
    first_order = known.groupBy("user_id").agg(F.to_date(F.min("order_date")).alias("since"))
    return customers.join(first_order, "user_id", "left").select(
        "user_id",
        "country",
        F.datediff(day, "since").cast("bigint").alias("account_age_days"),
        (F.col("balance") > premium_above).alias("is_premium"),
    )


def item_engagement(interactions: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Views, purchases and conversion per item, in one conditional aggregate."""
    day = as_date(as_of)
    recent = interactions.where(
        within_dates(interactions, "ts", day - dt.timedelta(days=29), day)
    )
    viewed = F.col("interaction_type") == "view"
    bought = F.col("interaction_type") == "purchase"
    last_week = F.to_date("ts") > F.lit(day - dt.timedelta(days=7))
    return recent.groupBy("item_id").agg(
        count_if(viewed & last_week).alias("view_count_7d"),
        count_if(bought).alias("purchase_count_30d"),
        safe_divide(count_if(bought), count_if(viewed)).alias("conversion_rate_30d"),
    )


def item_catalog(parts: DataFrame) -> DataFrame:
    """Catalog attributes; ``parts`` has item_id, category, price, stock."""
    return parts.select(
        "item_id",
        "category",
        F.col("price").cast("double").alias("price_usd"),
        F.col("stock").cast("bigint").alias("stock_count"),
    )


def _slot_of_day(events: DataFrame, seconds: int) -> Column:
    ts = F.col("ts")
    midnight = F.to_date(ts).cast(events.schema["ts"].dataType)
    # Whole seconds since midnight; intervals are plain longs inside Spark.
    second_of_day = (ts - midnight).cast("interval second").cast("bigint")
    return F.floor(second_of_day / F.lit(seconds))


def _seconds(interval: Column) -> Column:
    return interval.cast("interval second").cast("decimal(20,6)")
