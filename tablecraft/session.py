"""Session settings and the shared scratch area that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for. All are plain Spark options, so a
# cluster can also put them in spark-defaults.conf.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

# A shuffle partition of this size sorts in executor memory without spilling
# on common 4-8 GiB-per-core executors.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(shuffle_bytes: int, cores: int) -> int:
    """Initial shuffle partition count for an expected shuffle volume.

    Adaptive execution merges small partitions but cannot split ordinary ones,
    so start from the volume (never fewer than the cores) and let it coalesce.
    """
    by_volume = -(-shuffle_bytes // TARGET_PARTITION_BYTES)
    return max(cores, by_volume, 1)


def build_session(app_name: str = "tablecraft", **conf: object) -> SparkSession:
    """A session with the recommended settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this application.

    Comes from ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    is made in local mode only: on a cluster executors could not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tablecraft-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(
    df: DataFrame, label: str, path: str | None = None, codec: str | None = None
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several jobs: lineage ends at the files, an
    executor loss re-reads instead of re-computing, and later joins are planned
    from the real size of the table. ``codec`` is the Parquet compression where the
    session's own won't do, such as for copies of long texts.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
