"""Scans: CSV, Parquet, whole directories and globs."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CSV = {"header": True, "mode": "FAILFAST", "enforceSchema": False}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row. A declared schema costs one pass over the files;
    without one the types are inferred (two passes) and integers widen to bigint.

    A value that does not fit its type, or a header that does not match the
    schema, stops the read instead of turning into NULLs.
    """
    reader = spark.read.options(**_CSV)
    if schema is not None:
        return reader.schema(schema).csv(path)
    inferred = reader.option("inferSchema", True).csv(path)
    widened = [
        F.col(f"`{field.name}`").cast("bigint").alias(field.name)
        if isinstance(field.dataType, T.IntegerType)
        else F.col(f"`{field.name}`")
        for field in inferred.schema
    ]
    return inferred.select(*widened)


def load_dir(
    spark: SparkSession, directory: str, schemas: Mapping[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    """Every CSV and Parquet table of a directory as ``{stem: DataFrame}``.

    A table is a file ``name.csv`` or ``name.parquet``, or a folder of that name
    with part files in it. Other suffixes are skipped and a missing directory
    gives no tables. The listing goes through Spark's own file index, so any file
    system works; only the tables' names reach the driver.
    """
    base = re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?|^\./", "", directory.rstrip("/"))
    top = F.regexp_extract("path", re.escape(base) + r"/([^/]+\.(csv|parquet))(/|$)", 1)
    try:
        listing = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    tables = {}
    for row in sorted(listing.select(top.alias("name")).distinct().collect()):
        name = PurePosixPath(row["name"])
        path = f"{directory.rstrip('/')}/{name}"
        if name.suffix == ".csv":
            tables[name.stem] = read_csv(spark, path, (schemas or {}).get(name.stem))
        elif name.suffix == ".parquet":
            tables[name.stem] = read_parquet(spark, path)
    return tables


def stage_files(
    spark: SparkSession,
    root: str,
    glob: str,
    destination: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Land all files under ``root`` whose name matches ``glob`` in a staging folder.

    The tree is read recursively, so equal base names in different folders do
    not overwrite one another.
    """
    reader = (
        spark.read.format(fmt)
        .options(**(_CSV if fmt == "csv" else {}))
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
    )
    if schema is not None:
        reader = reader.schema(schema)
    staged = reader.load(root)
    staged.write.mode("overwrite").parquet(destination)
    return spark.read.schema(staged.schema).parquet(destination)


def table_digest(df: DataFrame) -> DataFrame:
    """``column_name, row_count, value_count, checksum`` of every column.

    The checksum adds the first 32 bits of each value's MD5, so it depends on
    neither the order nor the partitioning of the rows, and repeated rows count.
    Fractions are taken as whole ten-thousandths, timestamps as microseconds.
    One pass, combined map-side.
    """
    sums = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        text = _text_of(column, field.dataType).cast("binary")
        code = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
        sums += [F.count(column), F.coalesce(F.sum(code), F.lit(0))]
    names = [f"{kind}_{i}" for i in range(len(df.columns)) for kind in ("values", "checksum")]
    totals = df.agg(F.count("*").alias("row_count"), *[s.alias(n) for s, n in zip(sums, names)])
    rows = F.array(
        *[
            F.struct(
                F.lit(column).alias("column_name"),
                F.col("row_count"),
                F.col(f"values_{i}").alias("value_count"),
                F.col(f"checksum_{i}").alias("checksum"),
            )
            for i, column in enumerate(df.columns)
        ]
    )
    return totals.select(F.inline(rows))


def _text_of(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.rint(column.cast("double") * 10_000).cast("bigint").cast("string")
    if isinstance(kind, T.TimestampNTZType):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, column).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(column, lambda x: _text_of(x, kind.elementType)), ",", "null")
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")
