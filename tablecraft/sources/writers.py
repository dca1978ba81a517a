"""Sinks: tables with a write disposition, models, discarded results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tablecraft.operators.factorize import Factorization

# The disposition names callers use, and the Spark save mode of each.
DISPOSITIONS = {
    "WRITE_TRUNCATE": "overwrite",
    "WRITE_APPEND": "append",
    "WRITE_EMPTY": "errorifexists",
}


def write_table(
    df: DataFrame,
    path: str,
    disposition: str = "WRITE_TRUNCATE",
    partition_by: Sequence[str] = (),
    replace_partitions_only: bool = False,
) -> None:
    """Write a Parquet table.

    A partitioned write is rebalanced first: adaptive execution then merges
    small date partitions and splits a large one over several tasks, which a
    plain ``repartition(date)`` would pin to one. ``replace_partitions_only``
    makes a re-run replace just the partitions it produces.
    """
    if disposition not in DISPOSITIONS:
        raise ValueError(f"unknown disposition {disposition!r}; use {sorted(DISPOSITIONS)}")
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(DISPOSITIONS[disposition])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if replace_partitions_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def extract(df: DataFrame, path: str, disposition: str = "WRITE_TRUNCATE") -> DataFrame:
    """Store a query result as Parquet and continue from the stored table."""
    write_table(df, path, disposition)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Run a query whose result nobody reads."""
    df.write.format("noop").mode("overwrite").save()


def model_path(base: str, pipeline: str, run_id: str) -> str:
    return f"{base.rstrip('/')}/{pipeline}/{run_id}"


def save_model(
    model: PipelineModel,
    base: str,
    pipeline: str,
    run_id: str,
    eval_data: DataFrame | None = None,
) -> str:
    """Save a model under ``base/pipeline/run_id`` with its evaluation snapshot."""
    path = model_path(base, pipeline, run_id)
    model.write().overwrite().save(f"{path}/model")
    if eval_data is not None:
        write_table(eval_data, f"{path}/eval_data")
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def save_factors(
    result: Factorization, base: str, pipeline: str, run_id: str, source: str | None = None
) -> str:
    """Save both factor tables under ``base/pipeline/run_id``, and a manifest last.

    The manifest holds the rank, the error after every iteration and, as
    ``source``, what the factors were made from. A folder without one is not a
    finished run. Factors are stored sorted by id within each file, so a lookup
    by id skips most of a file.
    """
    path = model_path(base, pipeline, run_id)
    for side, table in (("user", result.user_factors), ("item", result.item_factors)):
        by_id = table.repartitionByRange(f"{side}_id").sortWithinPartitions(f"{side}_id")
        write_table(by_id, f"{path}/{side}_factors")
    spark = result.user_factors.sparkSession
    manifest = spark.createDataFrame([(result.rank, list(result.errors), source)], _FACTOR_MANIFEST)
    write_table(manifest.coalesce(1), f"{path}/factor_manifest")
    return path


def load_factors(spark: SparkSession, path: str) -> Factorization:
    """The factors saved under ``path``; an unfinished run is an error."""
    found = spark.read.schema(_FACTOR_MANIFEST).parquet(f"{path}/factor_manifest").first()
    tables = (spark.read.parquet(f"{path}/{side}_factors") for side in ("user", "item"))
    return Factorization(*tables, tuple(found["errors"]), found["rank"])


_FACTOR_MANIFEST = "rank int, errors array<double>, source string"
