"""A small retail day whose report is known."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from tablecraft.sources.schemas import RAW_INVENTORY, RAW_ORDERS, RAW_RETURNS

DAY = "2026-03-01"
_REGION = {"Electronics": "US-West", "Clothing": "US-East", "Home": "EU-West"}

ORDERS = [
    ("ORD001", "C001", "Electronics", 299.99),
    ("ORD002", "C002", "Clothing", 59.99),
    ("ORD003", "C001", "Electronics", 149.99),
    ("ORD004", "C003", "Home", 89.99),
    ("ORD005", "C004", "Clothing", 39.99),
    ("ORD006", "C002", "Electronics", 599.99),
    ("ORD007", "C005", "Home", 199.99),
    ("ORD008", "C006", "Clothing", 79.99),
    ("ORD009", "C007", "Electronics", 449.99),
    ("ORD010", "C008", "Home", 29.99),
    ("ORD011", "C009", "Clothing", 119.99),
    ("ORD012", "C010", "Electronics", 899.99),
    ("ORD013", "C003", "Home", 149.99),
    ("ORD014", "C011", "Clothing", 69.99),
    ("ORD015", "C012", "Electronics", 199.99),
    ("ORD016", "C013", "Home", 399.99),
    ("ORD017", "C014", "Clothing", 24.99),
    ("ORD018", "C015", "Electronics", 749.99),
    ("ORD019", "C016", "Home", 59.99),
    ("ORD020", "C017", "Clothing", 89.99),
]
RETURNED = ["ORD002", "ORD004", "ORD005", "ORD008", "ORD010", "ORD014", "ORD017", "ORD019"]
STOCK = [
    ("Electronics", 150, "US-West"),
    ("Electronics", 80, "US-East"),
    ("Clothing", 300, "US-East"),
    ("Clothing", 200, "US-West"),
    ("Home", 50, "EU-West"),
    ("Home", 75, "US-West"),
    ("Electronics", 25, "EU-West"),
    ("Clothing", 120, "EU-West"),
    ("Home", 8, "US-East"),
    ("Electronics", 200, "US-West"),
]


def orders(spark: SparkSession):
    day = dt.date.fromisoformat(DAY)
    data = [(o, c, g, a, _REGION[g], day) for o, c, g, a in ORDERS]
    return spark.createDataFrame(data, RAW_ORDERS)


def returns(spark: SparkSession):
    day = dt.date.fromisoformat(DAY)
    amount = {o: a for o, _, _, a in ORDERS}
    data = [
        (f"RET{n:03d}", order, "Defective", amount[order], day)
        for n, order in enumerate(RETURNED, start=1)
    ]
    return spark.createDataFrame(data, RAW_RETURNS)


def inventory(spark: SparkSession):
    data = [(f"INV{n:03d}", g, s, w) for n, (g, s, w) in enumerate(STOCK, start=1)]
    return spark.createDataFrame(data, RAW_INVENTORY)
