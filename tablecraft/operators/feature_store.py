"""Offline feature tables: publish and read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.operators.feature_schema import Entity, assert_conforms, require_columns
from tablecraft.session import materialize
from tablecraft.sources.versioned import read_version, write_version


_DAY = "feature_date_of"


def feature_table(root: str, entity: str, group: str) -> str:
    return f"{root.rstrip('/')}/feat_{entity}_{group}"


def publish_features(
    df: DataFrame,
    root: str,
    entity: Entity,
    group_name: str,
    feature_ts: str = "feature_timestamp",
    entity_id: str | None = None,
    feature_ids: Sequence[str] = (),
    disposition: str = "WRITE_TRUNCATE",
) -> DataFrame:
    """Check a table against its feature group, store it, return the input.

    The stored table has one row per entity and time, in versions that are
    partitioned by date (see ``sources/versioned.py``). ``WRITE_APPEND`` merges:
    a new row replaces the stored one with its key, other dates stay as they
    are. ``WRITE_TRUNCATE`` makes the new rows the whole table, ``WRITE_EMPTY``
    is an error if there are rows. Readers see the old version until the new one
    is complete. The features are computed once: both the check and the write
    read the materialised rows.
    """
    group = entity.groups[group_name]
    if feature_ids:
        group = group.select(feature_ids)
    require_columns(df, entity, group, feature_ts, entity_id)
    rows = materialize(df.select(entity_id or entity.id_column, feature_ts, *group.ids), "publish")
    checked = assert_conforms(rows, entity, group, feature_ts, entity_id)
    write_version(
        checked.withColumn(_DAY, F.to_date(feature_ts)),
        feature_table(root, entity.name, group_name),
        [entity.id_column, feature_ts],
        _DAY,
        disposition,
    )
    return df


def read_features(
    spark: SparkSession,
    root: str,
    entity: Entity,
    group_name: str,
    feature_ids: Sequence[str] = (),
    feature_ts: str | None = None,
    version: int | None = None,
) -> DataFrame:
    """Entity key plus the requested features (all declared ones by default).

    Reads the newest version, or the given one. A table nobody has published yet
    reads as empty, with the same columns.
    """
    group = entity.groups[group_name]
    if feature_ids:
        group = group.select(feature_ids)
    columns = [entity.id_column, *([feature_ts] if feature_ts else []), *group.ids]
    table = read_version(spark, feature_table(root, entity.name, group_name), version)
    if table is None:
        fields = [T.StructField(entity.id_column, entity.id_type)]
        if feature_ts:
            fields.append(T.StructField(feature_ts, T.TimestampType()))
        fields += list(group.schema)
        return spark.createDataFrame([], T.StructType(fields))
    return table.select(*columns)
