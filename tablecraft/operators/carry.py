"""Running values over a total order, in as many tasks as the data needs.

Rows are stored in ranges of an order, each range is scanned by a task of its
own, and what a range takes over from all earlier ones enters it as one more
row, before its first. Ranges follow the rows and not the keys, so a key with a
third of all rows is cut like any other stretch. What is summed up per range is
one row for each, whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tablecraft.session import materialize

PART = "__part"
# Makes equal rows differ, so that ranges may cut between them.
TIE = "__tie"


def store_in_ranges(df: DataFrame, *order: str, label: str, parts: int | None = None) -> DataFrame:
    """``df`` stored with its range in ``PART``; ranges ascend with ``order``.

    Ranges are of about equal size. There are ``parts`` of them, by default as
    many as Spark makes of a shuffle of this size. They are stored because the
    borders come from a sample: computed twice, they need not agree.
    """
    columns = [F.col(c) for c in order]
    placed = df.repartitionByRange(*([parts] if parts else []), *columns)
    return materialize(placed.withColumn(PART, F.spark_partition_id()), label)


def earlier_ranges() -> WindowSpec:
    """Over one row for each range: the rows of all ranges before."""
    return Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
