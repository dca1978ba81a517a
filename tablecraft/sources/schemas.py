"""Declared schemas of the raw tables.

Fixed values: the column names are the ones the reports, features and models
are defined on.
"""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _DOUBLE, _DATE, _BOOLEAN = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.DateType(),
    T.BooleanType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RAW_ORDERS = _schema(
    order_id=_STRING,
    customer_id=_STRING,
    category=_STRING,
    amount=_DOUBLE,
    region=_STRING,
    order_date=_DATE,
)
RAW_RETURNS = _schema(
    return_id=_STRING,
    order_id=_STRING,
    reason=_STRING,
    refund_amount=_DOUBLE,
    return_date=_DATE,
)
RAW_INVENTORY = _schema(item_id=_STRING, category=_STRING, stock_count=_LONG, warehouse=_STRING)
RAW_USER_EVENTS = _schema(
    user_id=_STRING,
    session_count_7d=_LONG,
    session_count_30d=_LONG,
    total_purchases_30d=_DOUBLE,
    days_since_last_login=_LONG,
    support_tickets_90d=_LONG,
    avg_session_duration_s=_DOUBLE,
    churned_within_30d=_BOOLEAN,
    event_date=_DATE,
)
RAW_INTERACTIONS = _schema(user_id=_STRING, item_id=_STRING, interaction_type=_STRING, ts=_DATE)

RAW_TABLES = {
    "raw_orders": RAW_ORDERS,
    "raw_returns": RAW_RETURNS,
    "raw_inventory": RAW_INVENTORY,
    "raw_user_events": RAW_USER_EVENTS,
    "raw_interactions": RAW_INTERACTIONS,
}
