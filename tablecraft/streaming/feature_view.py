"""Feature views: the latest row per entity, refreshed on a schedule.

A scheduler starts ``sync_feature_view`` every few hours. Structured Streaming
remembers which files of the offline feature table it has seen, so a sync reads
only what was published since the last one and merges it into the view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.operators.latest import latest_features
from tablecraft.operators.quality import QualityError
from tablecraft.session import materialize
from tablecraft.sources.versioned import read_version, write_version

_SYNCED_IN, _BUCKETS, _BUCKET = "_synced_in", "_buckets", "_bucket"


def sync_feature_view(
    spark: SparkSession,
    feature_table: str,
    view: str,
    checkpoint: str,
    entity_id: str,
    feature_ts: str,
    buckets: int = 256,
) -> None:
    """Merge newly published feature rows into the view, then return.

    The newest ``feature_ts`` wins, whatever order rows arrive in; of rows with
    the same time the one published last wins. Entities are spread over buckets
    by a hash; a sync reads and rewrites the buckets of its entities only, as a
    new version, so readers of the version before aren't disturbed, and a batch
    that is repeated after a failure gives the same view. The number of buckets
    is fixed by the first sync; another one is an error.
    """
    schema = spark.read.parquet(feature_table).schema
    bucket = F.pmod(F.hash(entity_id), F.lit(buckets))

    def newest(rows: DataFrame) -> DataFrame:
        # (time, sync) is the order; the pair is taken apart again afterwards.
        ordered = rows.withColumn("_order", F.struct(feature_ts, _SYNCED_IN))
        latest = latest_features(ordered.drop(feature_ts, _SYNCED_IN), entity_id, "_order")
        return latest.select("*", "_order.*").drop("_order")

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = materialize(
            newest(batch.withColumn(_SYNCED_IN, F.lit(batch_id).cast("bigint"))).withColumns(
                {_BUCKETS: F.lit(buckets), _BUCKET: bucket}
            ),
            "view-batch",
        )
        touched = [row[0] for row in fresh.select(_BUCKET).distinct().collect()]
        if not touched:
            return
        first = read_version(spark, view)
        found = first and first.select(_BUCKETS).first()[0]
        if found not in (None, buckets):
            raise QualityError(f"{view} has {found} buckets, not {buckets}")
        stored = read_version(spark, view, parts=touched)
        if stored is not None:
            fresh = newest(stored.unionByName(fresh).drop(_BUCKETS, _BUCKET)).withColumns(
                {_BUCKETS: F.lit(buckets), _BUCKET: bucket}
            )
        write_version(fresh, view, [entity_id], _BUCKET, "WRITE_APPEND", whole_parts=True)

    query = (
        spark.readStream.schema(schema)
        .parquet(feature_table)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_feature_view(spark: SparkSession, view: str, version: int | None = None) -> DataFrame:
    """The newest (or the given) version of a view."""
    rows = read_version(spark, view, version)
    if rows is None:
        raise QualityError(f"nothing was synced into {view} yet")
    return rows.drop(_SYNCED_IN, _BUCKETS, _BUCKET)
