"""Point-in-time feature lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.operators.carry import PART, TIE, earlier_ranges, store_in_ranges

_ENTITY, _AT, _ASKED = "_entity", "_at", "_asked"
_SPINE, _FEATURE = "_spine", "_feature"


def asof_features(
    spine: DataFrame,
    features: DataFrame,
    entity_id: str,
    spine_ts: str,
    feature_ts: str,
    feature_ids: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """For each spine row, the entity's last feature row at or before its time.

    Spine rows without an earlier feature row keep NULL features. ``features``
    holds one row per entity and time (see ``conform``). Times given as strings
    are read as timestamps; a string that is none is an error.

    Both inputs are stored once as one timeline in ranges of entity and time,
    and the last feature row is carried forward in each range; a range starts
    from the last feature row of the ranges before. No range join, and no row
    is treated otherwise for the number of rows beside it: many rows of an
    entity, also at one instant, are as many ranges as they fill.
    """
    ids = list(feature_ids) or [c for c in features.columns if c not in (entity_id, feature_ts)]
    feature_rows = features.select(
        F.col(entity_id).alias(_ENTITY),
        _instant(features, feature_ts).alias(_AT),
        F.struct(feature_ts, *ids).alias(_FEATURE),
    ).where(F.col(_ENTITY).isNotNull() & F.col(_AT).isNotNull())
    spine_rows = spine.select(
        F.col(entity_id).alias(_ENTITY),
        _instant(spine, spine_ts).alias(_AT),
        F.struct(*spine.columns).alias(_SPINE),
    )
    # Spine rows without entity or time match nothing: they skip the shuffle.
    placed = F.col(_ENTITY).isNotNull() & F.col(_AT).isNotNull()
    placed_rows, unplaced_rows = spine_rows.where(placed), spine_rows.where(~placed)

    timeline = feature_rows.unionByName(placed_rows, allowMissingColumns=True).withColumns(
        {_ASKED: F.col(_SPINE).isNotNull(), TIE: F.monotonically_increasing_id()}
    )
    # Feature rows sort before spine rows of the same time: the bound is inclusive.
    order = (_ENTITY, _AT, _ASKED, TIE)
    timeline = store_in_ranges(timeline, *order, label="asof-timeline", parts=parts)
    started = timeline.unionByName(_carried(timeline), allowMissingColumns=True)
    so_far = (
        Window.partitionBy(PART, _ENTITY)
        .orderBy(F.asc_nulls_first(_AT), _ASKED, TIE)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = started.withColumn(_FEATURE, F.last(_FEATURE, ignorenulls=True).over(so_far))
    matched = matched.where(_ASKED).select(_SPINE, _FEATURE)
    everything = matched.unionByName(unplaced_rows.select(_SPINE), allowMissingColumns=True)
    return everything.select(
        *[F.col(_SPINE)[c].alias(c) for c in spine.columns],
        *([] if feature_ts in spine.columns else [F.col(_FEATURE)[feature_ts].alias(feature_ts)]),
        *[F.col(_FEATURE)[c].alias(c) for c in ids],
    )


def _carried(timeline: DataFrame) -> DataFrame:
    """The last feature row before each range, if the range goes on with its entity.

    Only the first entity of a range can have rows in an earlier one. So one row
    for each range says all: its first entity, and its last feature row.
    """
    known = F.col(_FEATURE).isNotNull()
    place = F.when(known, F.struct(_ENTITY, _AT, TIE))
    ranges = timeline.groupBy(PART).agg(
        F.min(_ENTITY).alias(_ENTITY),
        F.max(place).alias("_last"),
        F.max_by(_FEATURE, place).alias(_FEATURE),
    )
    before = earlier_ranges()
    latest = ranges.select(
        PART,
        _ENTITY,
        F.max("_last").over(before)[_ENTITY].alias("_of"),
        F.max_by(_FEATURE, "_last").over(before).alias(_FEATURE),
    )
    return latest.where(F.col("_of") == F.col(_ENTITY)).drop("_of")


def _instant(df: DataFrame, column: str) -> Column:
    text = isinstance(df.schema[column].dataType, T.StringType)
    return F.col(column).cast("timestamp") if text else F.col(column)
