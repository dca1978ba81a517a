"""SQL written by the caller."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Available to callers' SQL under the name their queries already use.
_SQL_FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION safe_divide(a DOUBLE, b DOUBLE) "
    "RETURNS DOUBLE RETURN try_divide(a, b)",
)


def register_functions(spark: SparkSession) -> None:
    """Make SAFE_DIVIDE callable; it is inlined, so it optimises like built-ins."""
    for statement in _SQL_FUNCTIONS:
        spark.sql(statement)


def run_sql(
    spark: SparkSession,
    sql: str | None = None,
    sql_file: str | Path | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    args: Mapping[str, object] | None = None,
) -> DataFrame:
    """Run inline SQL, or SQL from a file, over named DataFrames.

    Tables are written ``{name}`` in the text and values ``:name``; both are
    bound by Spark, so nothing is pasted into the text. Inline SQL wins when
    both are given.
    """
    if not sql and not sql_file:
        raise ValueError("run_sql needs sql or sql_file")
    text = sql or Path(sql_file).read_text()
    register_functions(spark)
    return spark.sql(text, args=dict(args or {}), **dict(tables or {}))
