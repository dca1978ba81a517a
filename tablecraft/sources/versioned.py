"""Keyed tables in versions: merged by key, switched in one step.

A write puts the rows of the parts (dates, or numbered buckets) it touches beside
the old ones, in a folder of its own, and then adds a manifest that says which
folder holds which part.
The manifest is a single file, so a reader sees all of a version or nothing of
it, and a reader of an older version isn't disturbed. Folders are never
rewritten.

    <path>/rows/<version>/<partition>=<date or bucket>/...
    <path>/manifests/version=<n>/...
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.operators.quality import QualityError, assert_unique
from tablecraft.session import materialize
from tablecraft.sources.writers import DISPOSITIONS

_MANIFEST = "version int, writer string, day date, bucket int, folder string"


def rows_path(path: str) -> str:
    return f"{path.rstrip('/')}/rows"


def read_manifest(
    spark: SparkSession, path: str, version: int | None = None
) -> tuple[int, dict[object, str]]:
    """Newest (or the given) version and the folder of each of its parts.

    A table that nobody has written yet has version 0 and no parts. Two writers
    that made the same version at once are an error: neither has seen the
    other's rows.
    """
    try:
        manifests = spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    if version is None:
        version = manifests.agg(F.max("version")).first()[0] or 0
    # One row for each part of the table.
    entries = manifests.where(F.col("version") == version).collect()
    if version and not entries:
        raise QualityError(f"{path} has no version {version}")
    if len({entry["writer"] for entry in entries}) > 1:
        raise QualityError(f"{path} was written twice as version {version}")
    return version, {
        entry["day"] if entry["bucket"] is None else entry["bucket"]: entry["folder"]
        for entry in entries
        if entry["folder"]
    }


def read_version(
    spark: SparkSession,
    path: str,
    version: int | None = None,
    parts: Collection[object] | None = None,
) -> DataFrame | None:
    """The rows of the newest (or the given) version; None if it has none.

    With ``parts``, only the folders of these are looked at.
    """
    _, folders = read_manifest(spark, path, version)
    if parts is not None:
        folders = {part: folders[part] for part in parts if part in folders}
    if not folders:
        return None
    return _read(spark, path, folders)


def write_version(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    part: str,
    disposition: str,
    whole_parts: bool = False,
) -> int:
    """Write ``df`` as a new version of the table and return its number.

    ``keys`` are unique in the table, and ``part`` (a date column, or an int of few
    values) is a function of them. WRITE_APPEND merges: a row replaces the stored
    one with its key, and only the parts that ``df`` touches are rewritten; with
    ``whole_parts`` the rows of ``df`` are all that these parts have from now on.
    WRITE_TRUNCATE makes ``df`` the whole table. WRITE_EMPTY is an error if the
    table has rows. A repeated key in ``df`` is an error.
    """
    if disposition not in DISPOSITIONS:
        raise ValueError(f"unknown disposition {disposition!r}; use {sorted(DISPOSITIONS)}")
    spark = df.sparkSession
    version, folders = read_manifest(spark, path)
    if disposition == "WRITE_EMPTY" and folders:
        raise QualityError(f"{path} is not empty")
    rows = assert_unique(materialize(df, "version-rows"), keys)
    touched = [row[0] for row in rows.select(part).distinct().collect()]
    kept = {} if disposition == "WRITE_TRUNCATE" else dict(folders)
    before = {value: kept.pop(value) for value in touched if value in kept}
    if before and not whole_parts:
        old = _read(spark, path, before).join(rows.select(*keys), list(keys), "left_anti")
        rows = old.unionByName(rows, allowMissingColumns=True).select(*df.columns)
    writer = uuid.uuid4().hex
    folder = f"{version + 1:06d}-{writer}"
    # Rebalancing merges small parts and splits large ones over several tasks.
    rows.hint("rebalance", part).write.partitionBy(part).parquet(f"{rows_path(path)}/{folder}")
    kept |= {value: folder for value in touched}
    entries = [
        (writer, None, value, name) if isinstance(value, int) else (writer, value, None, name)
        for value, name in kept.items()
    ]
    manifest = spark.createDataFrame(
        entries or [(writer, None, None, None)], _MANIFEST.removeprefix("version int, ")
    )
    manifest.coalesce(1).write.parquet(
        f"{path.rstrip('/')}/manifests/version={version + 1}", mode="append"
    )
    return version + 1


def _read(spark: SparkSession, path: str, folders: dict[object, str]) -> DataFrame:
    """The wanted parts of each folder; columns that a folder lacks are null."""
    found = None
    for folder in sorted(set(folders.values())):
        wanted = [part for part, name in folders.items() if name == folder]
        rows = spark.read.parquet(f"{rows_path(path)}/{folder}")
        column = rows.columns[-1]  # Spark puts the partition column last
        rows = rows.where(F.col(column).isin(wanted))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found
