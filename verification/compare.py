"""Run registered queries beside their SQL and compare rows, types and values.

    python -m verification.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tablecraft.session import build_session
from verification.oracles import TABLES, oracle_sql
from verification.queries import queries

_SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def differences(spark_df, connection, sql: str) -> list[str]:
    """Reasons why a query and its SQL disagree; empty when they agree."""
    found = []
    columns = sorted(spark_df.columns)
    cursor = connection.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    if columns != sorted(sql_types):
        return [f"columns {columns} != {sorted(sql_types)}"]
    for name, kind in spark_df.dtypes:
        if _SAME_TYPE.get(kind) != sql_types[name]:
            found.append(f"type of {name}: {kind} != {sql_types[name]}")
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()), key=repr)
    actual = sorted(
        (tuple(_plain(v) for v in row) for row in spark_df.select(*columns).collect()), key=repr
    )
    if len(expected) != len(actual):
        found.append(f"rows {len(actual)} != {len(expected)}")
    unequal = [(a, e) for a, e in zip(actual, expected) if a != e]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first: {unequal[0][0]} != {unequal[0][1]}")
    return found


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session(
        "compare", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false",
                     "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sql = oracle_sql()
    failures = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            result = run(spark, sf_dir)
            if name in sql:
                found = differences(result, connection, sql[name])
                verdict = "ok" if not found else "; ".join(found)
            else:
                found = []
                verdict = f"rows only: {result.count()}"
        except Exception as error:  # noqa: BLE001
            found = [str(error)]
            verdict = f"error: {type(error).__name__}: {str(error)[:600]}"
        failures += bool(found)
        print(f"{name:28s} {time.time() - started:6.2f}s  {verdict}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
