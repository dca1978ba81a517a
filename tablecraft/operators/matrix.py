"""User-item interaction matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions import map_value

# The weight of an interaction; any other type counts 1.
INTERACTION_WEIGHTS = {"view": 1, "purchase": 3}
DEFAULT_WEIGHT = 1


def interaction_matrix(
    interactions: DataFrame,
    weights: Mapping[str, float] = INTERACTION_WEIGHTS,
    default: float = DEFAULT_WEIGHT,
) -> DataFrame:
    """Non-zero cells ``(user_id, item_id, score)``; absent cells are zero."""
    weight = map_value(F.col("interaction_type"), weights, default)
    return interactions.groupBy("user_id", "item_id").agg(
        F.sum(weight).cast("double").alias("score")
    )


def interaction_matrix_wide(
    interactions: DataFrame,
    items: Sequence[object],
    weights: Mapping[str, float] = INTERACTION_WEIGHTS,
    default: float = DEFAULT_WEIGHT,
    keep_other: bool = False,
) -> DataFrame:
    """One row per user with a zero-filled column per listed item.

    The caller gives the items, so no pass is spent on finding them and the
    width is known. An interaction with another item, or none, is an error, or
    with ``keep_other`` adds to the column ``item_other``. Use the long form for
    an open item set.
    """
    weight = map_value(F.col("interaction_type"), weights, default)
    item = F.col("item_id").cast("string")
    unlisted = F.raise_error(
        F.concat(F.lit("item is not listed: "), F.coalesce(item, F.lit("NULL")))
    ).cast("string")
    other = F.lit("other") if keep_other else unlisted
    column = F.when(F.col("item_id").isin(list(items)), item).otherwise(other)
    names = [*map(str, items), *(["other"] if keep_other else [])]
    marked = interactions.withColumns({"__column": column, "__weight": weight})
    wide = marked.groupBy("user_id").pivot("__column", names).agg(F.sum("__weight"))
    return wide.select(
        "user_id",
        *[
            F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)).alias(f"item_{name}")
            for name in names
        ],
    )
