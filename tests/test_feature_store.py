import datetime as dt

import pytest
from results import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.operators import feature_schema as fs
from tablecraft.operators.feature_store import feature_table, publish_features, read_features
from tablecraft.operators.quality import QualityError
from tablecraft.plans import churn
from tablecraft.sources.schemas import RAW_USER_EVENTS
from tablecraft.sources.versioned import read_manifest

DECLARED = {
    "entity": "shop",
    "id_column": "shop_id",
    "feature_groups": {
        "size": {
            "description": "how big",
            "features": [
                {"name": "rooms", "type": "INT64"},
                {"name": "tags", "type": "STRING_ARRAY", "description": "labels"},
            ],
        },
        "place": {"features": [{"name": "lat", "type": "DOUBLE"}]},
    },
}


def test_declared_entity():
    entity = fs.declared_entity(DECLARED)
    assert entity.id_type == T.StringType()
    assert {name: g.ids for name, g in entity.groups.items()} == {
        "size": ["rooms", "tags"],
        "place": ["lat"],
    }
    assert entity.groups["size"].schema["tags"].dataType == T.ArrayType(T.StringType())


def test_faults_are_listed_with_their_place():
    broken = {
        "id_column": "id",
        "feature_groups": {
            "g": {"features": [{"name": "x", "type": "UUID"}, {"name": "x", "type": "BOOL"}]},
            "h": {"features": [{"type": "BOOL"}]},
        },
    }
    with pytest.raises(QualityError) as error:
        fs.declared_entity(broken)
    for part in ("entity is missing", "feature_groups.g.features[0] has the unknown type 'UUID'",
                 "feature_groups.g.features[1] repeats 'x'",
                 "feature_groups.h.features[0].name is missing"):
        assert part in str(error.value)


def test_read_entities(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "shop.yaml").write_text(yaml.safe_dump(DECLARED))
    assert list(fs.read_entities(spark, str(tmp_path))) == ["shop"]


def test_changed_numbers_and_lost_ids_are_counted(spark):
    df = spark.createDataFrame([("1", 1, 3.7), ("2", 1, 3.0), ("x", 1, None)],
                               "id string, ts int, x double")
    entity = fs.Entity("e", "id", {"g": GROUP}, T.LongType())
    counts = fs.violations(df, entity, GROUP, "ts").first().asDict()
    assert (counts["bad_values"], counts["null_ids"]) == (1, 1)
    assert rows(fs.conform(df.where("id <> '1'"), entity, GROUP, "ts"), "x") == [
        (None, 1, None), (2, 1, 3),
    ]


def test_declared_groups():
    assert len(fs.USER.groups["behavioral"].ids) == 6
    assert len(fs.USER.groups["demographic"].ids) == 3
    assert [len(g.ids) for g in fs.ITEM.groups.values()] == [3, 3]


GROUP = fs.group("g", x="INT64")
ENTITY = fs.Entity("e", "id", {"g": GROUP})


def test_violations_are_counted(spark):
    df = spark.createDataFrame(
        [("a", 1, "5"), ("a", 1, "6"), (None, 1, "7"), ("b", None, "8"), ("c", 1, "bad"),
         ("d", 1, None)],
        "id string, ts int, x string",
    )
    counts = fs.violations(df, ENTITY, GROUP, "ts").first().asDict()
    assert counts == {
        "row_count": 6,
        "null_ids": 1,
        "null_times": 1,
        "duplicate_keys": 1,
        "bad_values": 1,
    }
    with pytest.raises(QualityError) as error:
        fs.assert_conforms(df, ENTITY, GROUP, "ts")
    for kind in ("null_ids", "null_times", "duplicate_keys", "bad_values"):
        assert kind in str(error.value)


def test_conform_casts_and_requires_columns(spark):
    df = spark.createDataFrame([(1, 1, "5", "extra")], "id int, ts int, x string, other string")
    conformed = fs.assert_conforms(df, ENTITY, GROUP, "ts")
    assert conformed.dtypes == [("id", "string"), ("ts", "int"), ("x", "bigint")]
    with pytest.raises(QualityError, match="columns missing"):
        fs.conform(df.drop("x"), ENTITY, GROUP, "ts")
    with pytest.raises(QualityError, match="not declared"):
        GROUP.select(["y"])


def test_empty_table_has_no_violations(spark):
    empty = spark.createDataFrame([], "id string, ts int, x string")
    assert set(fs.violations(empty, ENTITY, GROUP, "ts").first()) == {0}


def _user_rows(spark):
    day = dt.date(2023, 12, 20)
    data = [
        ("u1", 12, 45, 3.0, 2, 0, 320.5, False, day),
        ("u2", 3, 0, 0.0, 15, 2, 95.0, True, day),
        (None, 1, 1, 0.0, 1, 1, 1.0, True, day),
        ("u3", 1, 4, -1.0, 1, 1, 1.0, None, dt.date(2024, 1, 1)),
        ("u4", 1, 4, 2.0, 1, 1, 1.0, True, dt.date(2023, 10, 3)),
        ("u5", 1, 4, 2.0, 1, 1, 1.0, True, dt.date(2023, 10, 2)),
    ]
    return spark.createDataFrame(data, RAW_USER_EVENTS)


def test_churn_features(spark):
    """Both ends of the 90 days belong; NULL users go; NULL churn is label 0."""
    raw = churn.churn_training_raw(_user_rows(spark), "2024-01-01")
    assert raw.count() == 5
    features = churn.churn_features(raw, "2024-01-01").select(
        "user_id", F.round("session_trend", 6), F.round("log_purchases_30d", 6), "label"
    )
    assert rows(features, "user_id") == [
        ("u1", 0.266667, 1.386294, 0),
        ("u2", None, 0.0, 1),
        ("u3", 0.25, None, 0),
        ("u4", 0.25, 1.098612, 1),
    ]


def test_feature_time_defaults_to_the_query_start(spark):
    raw = churn.churn_training_raw(_user_rows(spark), "2024-01-01")
    now = churn.churn_features(raw).select("feature_timestamp").distinct().collect()
    assert len(now) == 1 and now[0][0].year >= 2024


def test_publish_and_read(spark, tmp_path):
    features = churn.churn_features(
        churn.churn_training_raw(_user_rows(spark), "2024-01-01"), "2024-01-01"
    )
    assert churn.publish_churn_features(features, str(tmp_path)) is features
    stored = read_features(spark, str(tmp_path), fs.USER, "behavioral", ["session_count_7d"])
    assert rows(stored) == [("u1", 12), ("u2", 3), ("u3", 1), ("u4", 1)]

    newer = churn.churn_features(
        churn.churn_training_raw(_user_rows(spark), "2024-01-01").limit(1), "2024-01-02"
    )
    churn.publish_churn_features(newer, str(tmp_path), "WRITE_APPEND")
    table = read_features(spark, str(tmp_path), fs.USER, "behavioral", feature_ts="feature_timestamp")
    assert table.select("feature_timestamp").distinct().count() == 2
    assert read_features(spark, str(tmp_path), fs.USER, "behavioral").columns == [
        "user_id",
        *fs.USER.groups["behavioral"].ids,
    ]


def test_unpublished_table_reads_empty(spark, tmp_path):
    df = read_features(spark, str(tmp_path), fs.USER, "demographic", ["is_premium"])
    assert df.dtypes == [("user_id", "string"), ("is_premium", "boolean")]
    assert df.count() == 0


def _group_rows(spark, *values):
    rows = [(i, dt.datetime(2024, 1, day), x) for i, day, x in values]
    return spark.createDataFrame(rows, "id string, ts timestamp_ntz, x long")


def _stored(spark, root, **options):
    table = read_features(spark, root, ENTITY, GROUP.name, feature_ts="ts", **options)
    return sorted((r["id"], r["ts"].day, r["x"]) for r in table.collect())


def test_append_merges_by_key_and_touches_its_dates_only(spark, tmp_path):
    root = str(tmp_path)

    def publish(disposition, *values):
        publish_features(_group_rows(spark, *values), root, ENTITY, GROUP.name, "ts",
                         disposition=disposition)

    publish("WRITE_TRUNCATE", ("a", 1, 1), ("b", 1, 2), ("a", 2, 3))
    slow_reader = read_features(spark, root, ENTITY, GROUP.name, feature_ts="ts")
    publish("WRITE_APPEND", ("b", 1, 20), ("c", 1, 4), ("a", 3, 5))
    merged = [("a", 1, 1), ("a", 2, 3), ("a", 3, 5), ("b", 1, 20), ("c", 1, 4)]
    assert _stored(spark, root) == merged
    # The reader from before still sees its version, and so can anyone.
    first = [("a", 1, 1), ("a", 2, 3), ("b", 1, 2)]
    assert sorted((r["id"], r["ts"].day, r["x"]) for r in slow_reader.collect()) == first
    assert _stored(spark, root, version=1) == first

    table = feature_table(root, ENTITY.name, GROUP.name)
    version, folders = read_manifest(spark, table)
    assert version == 2
    assert folders[dt.date(2024, 1, 2)] == read_manifest(spark, table, 1)[1][dt.date(2024, 1, 2)]

    publish("WRITE_TRUNCATE", ("z", 9, 9))
    assert _stored(spark, root) == [("z", 9, 9)]
    with pytest.raises(QualityError, match="not empty"):
        publish("WRITE_EMPTY", ("y", 1, 1))
    publish("WRITE_TRUNCATE")
    assert _stored(spark, root) == []
    publish("WRITE_EMPTY", ("y", 1, 1))
    assert _stored(spark, root) == [("y", 1, 1)]
    with pytest.raises(QualityError, match="no version"):
        _stored(spark, root, version=99)


def test_writers_of_the_same_version_are_found_out(spark, tmp_path):
    root = str(tmp_path)
    publish_features(_group_rows(spark, ("a", 1, 1)), root, ENTITY, GROUP.name, "ts")
    table = feature_table(root, ENTITY.name, GROUP.name)
    rival = spark.createDataFrame(
        [("other", None, None)], "writer string, day date, folder string"
    )
    rival.write.mode("append").parquet(f"{table}/manifests/version=1")
    with pytest.raises(QualityError, match="written twice"):
        _stored(spark, root)


def test_an_unfinished_write_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    publish_features(_group_rows(spark, ("a", 1, 1)), root, ENTITY, GROUP.name, "ts")
    table = feature_table(root, ENTITY.name, GROUP.name)
    _group_rows(spark, ("b", 1, 2)).withColumn("d", F.to_date("ts")).write.partitionBy(
        "d"
    ).parquet(f"{table}/rows/000002-lost")
    assert _stored(spark, root) == [("a", 1, 1)]
