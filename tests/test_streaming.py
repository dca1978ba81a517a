import os

import pytest
from results import rows

from tablecraft.operators.behavior import item_engagement
from tablecraft.operators.latest import latest_features
from tablecraft.operators.quality import QualityError
from tablecraft.sources.versioned import read_manifest
from tablecraft.streaming.engagement import read_item_engagement, sync_item_engagement
from tablecraft.streaming.feature_view import read_feature_view, sync_feature_view

SCHEMA = "user_id string, ts timestamp_ntz, score int"
EVENTS = "/root/testdata/sf0.001/events.parquet"


INTERACTIONS = "item_id long, interaction_type string, ts timestamp_ntz"


def publish(spark, table, data):
    df = spark.createDataFrame(data, "user_id string, ts string, score int")
    df = df.selectExpr("user_id", "CAST(ts AS timestamp_ntz) ts", "score")
    df.write.mode("append").parquet(table)


def test_view_follows_the_table(spark, tmp_path):
    table, view = str(tmp_path / "table"), str(tmp_path / "view")
    sync = (spark, table, view, str(tmp_path / "checkpoint"), "user_id", "ts")

    publish(spark, table, [("a", "2024-01-01", 9), ("a", "2024-01-03", 1), ("b", "2024-01-02", 5)])
    sync_feature_view(*sync)
    first = latest_features(spark.read.parquet(table), "user_id", "ts")
    assert rows(read_feature_view(spark, view).select("user_id", "ts", "score")) == rows(first)

    # A late row loses, a newer one wins, a corrected one replaces its equal.
    publish(spark, table, [("a", "2024-01-02", 7), ("b", "2024-01-05", 6), ("c", "2024-01-01", 8)])
    sync_feature_view(*sync)
    publish(spark, table, [("c", "2024-01-01", 2)])
    sync_feature_view(*sync)
    got = {r.user_id: r.score for r in read_feature_view(spark, view).collect()}
    assert got == {"a": 1, "b": 6, "c": 2}

    # Nothing new: the view stays as it is.
    sync_feature_view(*sync)
    assert {r.user_id: r.score for r in read_feature_view(spark, view).collect()} == got


@pytest.mark.skipif(not os.path.exists(EVENTS), reason="test tables not present")
def test_view_equals_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS).drop("props")
    table, view = str(tmp_path / "table"), str(tmp_path / "view")
    for day in ("2024-01-10", "2024-01-31"):
        part = events.where(f"ts < timestamp_ntz'{day}'")
        part.write.mode("append").parquet(table)
        sync_feature_view(spark, table, view, str(tmp_path / "cp"), "user_id", "ts")
    got = read_feature_view(spark, view).select(*events.columns)
    assert rows(got, "user_id") == rows(latest_features(events, "user_id", "ts"), "user_id")


def test_a_sync_rewrites_the_buckets_it_touches(spark, tmp_path):
    table, view = str(tmp_path / "table"), str(tmp_path / "view")
    sync = (spark, table, view, str(tmp_path / "checkpoint"), "user_id", "ts", 32)
    publish(spark, table, [(f"u{i}", "2024-01-01", i) for i in range(40)] + [(None, "2024-01-01", 1)])
    sync_feature_view(*sync)
    _, before = read_manifest(spark, view)
    publish(spark, table, [("u7", "2024-01-02", 700), (None, "2024-01-02", 2)])
    sync_feature_view(*sync)
    version, after = read_manifest(spark, view)
    changed = {bucket for bucket in after if after[bucket] != before.get(bucket)}
    assert version == 2 and set(after) == set(before) and 1 <= len(changed) <= 2
    got = {r.user_id: r.score for r in read_feature_view(spark, view).collect()}
    assert got == {f"u{i}": i for i in range(40)} | {"u7": 700, None: 2}
    # A reader of the version before still has all of it.
    old = {r.user_id: r.score for r in read_feature_view(spark, view, 1).collect()}
    assert old == {f"u{i}": i for i in range(40)} | {None: 1}

    publish(spark, table, [("u1", "2024-01-03", 5)])
    with pytest.raises(Exception, match="32 buckets, not 8"):
        sync_feature_view(*sync[:-1], 8)


def test_reading_a_view_nobody_synced_is_an_error(spark, tmp_path):
    with pytest.raises(QualityError, match="nothing was synced"):
        read_feature_view(spark, str(tmp_path / "none"))
    with pytest.raises(QualityError, match="nothing was synced"):
        read_item_engagement(spark, str(tmp_path / "none"), "2024-01-30")


def test_engagement_follows_late_and_repeated_files(spark, tmp_path):
    table, view = str(tmp_path / "table"), str(tmp_path / "view")

    def published(data):
        df = spark.createDataFrame(data, "item_id long, interaction_type string, ts string")
        df = df.withColumn("ts", df.ts.cast("timestamp_ntz"))
        df.write.mode("append").parquet(table)
        stream = spark.readStream.schema(INTERACTIONS).parquet(table)
        sync_item_engagement(spark, stream, view, str(tmp_path / "checkpoint"), "7 days")

    def expect(condition="true"):
        seen = spark.read.schema(INTERACTIONS).parquet(table).where(condition)
        for as_of in ("2024-01-20", "2024-01-29"):
            wanted = item_engagement(seen.where("item_id IS NOT NULL"), as_of)
            assert rows(read_item_engagement(spark, view, as_of)) == rows(wanted)

    published([(1, "view", "2024-01-20 23:59:59"), (1, "purchase", "2024-01-20"),
               (2, "click", "2024-01-19"), (None, "view", "2024-01-20"), (3, "view", None)])
    _, first = read_manifest(spark, view)
    # Six days late, and the same row once more: both are counted.
    published([(1, "view", "2024-01-14"), (2, "view", "2024-01-14 05:00:00"),
               (1, "purchase", "2024-01-20")])
    expect()
    # Days without news keep their folder.
    _, second = read_manifest(spark, view)
    assert {d.day for d in first if first[d] == second[d]} == {19}

    published([(2, "view", "2024-01-29")])
    expect()
    # Later than the watermark: left out, as promised.
    published([(2, "view", "2024-01-10")])
    expect("ts > '2024-01-11'")
    # Nothing new: no new version.
    version, _ = read_manifest(spark, view)
    stream = spark.readStream.schema(INTERACTIONS).parquet(table)
    sync_item_engagement(spark, stream, view, str(tmp_path / "checkpoint"), "7 days")
    assert read_manifest(spark, view)[0] == version
