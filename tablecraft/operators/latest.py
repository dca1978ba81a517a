"""Latest row per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_features(
    features: DataFrame, entity_id: str, feature_ts: str, tie_break: Sequence[str] | None = None
) -> DataFrame:
    """The newest feature row of each entity.

    A maximum that combines map-side, so an entity with a very long history sends
    one row per task. Of rows with the newest time the one with the largest
    ``tie_break`` columns stays, so that every run gives the same row; without
    them all other columns decide, which must then be of ordered types.
    """
    others = [c for c in features.columns if c not in (entity_id, feature_ts)]
    order = F.struct(feature_ts, *(others if tie_break is None else tie_break))
    row = F.struct(*(c for c in features.columns if c != entity_id))
    newest = features.groupBy(entity_id).agg(F.max_by(row, order).alias("newest"))
    return newest.select(
        *[F.col(c) if c == entity_id else F.col("newest")[c].alias(c) for c in features.columns]
    )
