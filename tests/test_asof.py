import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import asof
from tablecraft.operators.latest import latest_features


def make(seed, n_spine, n_features, span=2000):
    """Whole seconds in a short span, so equal times on both sides are common."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)

    def pick():
        user = rng.choice(["hot", "hot", "a", "b", "c", None])
        return user, start + dt.timedelta(seconds=rng.randrange(span))

    spine = [(i, *pick()) for i in range(n_spine)]
    spine.append((n_spine, "hot", None))
    keyed = {pick() for _ in range(n_features)}
    features = [
        (user, ts, None if rng.random() < 0.1 else rng.random(), i)
        for i, (user, ts) in enumerate(sorted(keyed, key=repr))
    ]
    return spine, features


def expected(spine, features):
    result = []
    for row_id, user, ts in spine:
        past = [
            f for f in features if user is not None and ts is not None and f[0] == user
            and f[1] <= ts
        ]
        last = max(past, key=lambda f: f[1]) if past else (None, None, None, None)
        result.append((row_id, user, ts, *last[1:]))
    return result


def frames(spark, spine, features, kind="timestamp_ntz"):
    spine_df = spark.createDataFrame(spine, "row_id int, user string, ts timestamp_ntz")
    feature_df = spark.createDataFrame(
        features, "user string, seen timestamp_ntz, score double, version int"
    )
    return (
        spine_df.withColumn("ts", F.col("ts").cast(kind)),
        feature_df.withColumn("seen", F.col("seen").cast(kind)),
    )


@pytest.mark.parametrize("parts", [None, 2, 17, 200])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, parts):
    spine, features = make(seed, 150, 80)
    result = asof.asof_features(
        *frames(spark, spine, features), "user", "ts", "seen", parts=parts
    )
    assert [tuple(r) for r in result.orderBy("row_id").collect()] == expected(spine, features)


def test_ranges_of_timestamps_and_dates(spark):
    spine, features = make(3, 60, 30)
    frames_tz = frames(spark, spine, features, "timestamp")
    result = asof.asof_features(*frames_tz, "user", "ts", "seen", parts=20)
    assert [r.version for r in result.orderBy("row_id").collect()] == [
        e[-1] for e in expected(spine, features)
    ]

    days = spark.range(40).select(
        F.lit("u").alias("user"),
        F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("d"),
    )
    weekly = days.where(F.dayofweek("d") == 2).select("user", F.col("d").alias("monday"))
    matched = asof.asof_features(
        days, weekly.withColumn("n", F.dayofmonth("monday")), "user", "d", "monday",
        parts=7,
    )
    wrong = matched.where((F.datediff("d", "monday") >= 7) | F.col("monday").isNull())
    assert matched.count() == 40 and wrong.count() == 0


def test_selected_features_only(spark):
    spine, features = make(4, 10, 10)
    result = asof.asof_features(
        *frames(spark, spine, features), "user", "ts", "seen", feature_ids=["version"]
    )
    assert result.columns == ["row_id", "user", "ts", "seen", "version"]


def test_times_as_strings(spark):
    spine, features = make(6, 80, 40)
    texts = frames(spark, spine, features, "string")
    want = [e[-1] for e in expected(spine, features)]
    stamps = frames(spark, spine, features, "timestamp")
    for pair in (texts, (texts[0], stamps[1])):
        result = asof.asof_features(*pair, "user", "ts", "seen", parts=9)
        assert dict(result.dtypes)["ts"] == "string"
        assert [r.version for r in result.orderBy("row_id").collect()] == want


def test_features_of_any_type_are_carried(spark):
    """A map can't be ordered; null features of a known row stay null."""
    features = spark.createDataFrame(
        [("u", 1, {"x": 1}), ("u", 2, None), ("v", 1, {"y": 2})],
        "user string, seen int, m map<string,int>",
    )
    spine = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("user"),
        (F.col("id") / 100).cast("int").alias("t"),
    )
    result = asof.asof_features(spine, features, "user", "t", "seen", parts=40)
    got = {(r.user, r.t, str(r.m)) for r in result.collect()}
    assert got == {
        ("u", 0, "None"), ("u", 1, "{'x': 1}"), ("u", 2, "None"),
        ("v", 0, "None"), ("v", 1, "{'y': 2}"), ("v", 2, "{'y': 2}"),
    }


@pytest.mark.parametrize("seconds_apart", [60.0, 0.001, 0.0])
def test_no_range_holds_a_whole_burst(spark, monkeypatch, seconds_apart):
    """20,000 rows of one entity, close together or at one instant, in 20 ranges."""
    stored = []
    keep = asof.store_in_ranges

    def spied(*args, **options):
        stored.append(keep(*args, **options))
        return stored[-1]

    monkeypatch.setattr(asof, "store_in_ranges", spied)
    step = F.make_dt_interval(secs=(F.col("id") * seconds_apart).cast("decimal(18,6)"))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    spine = spark.range(20_000).select(F.lit("hot").alias("user"), (start + step).alias("t"))
    features = spine.limit(1).select("user", F.col("t").alias("seen"), F.lit(5).alias("v"))
    result = asof.asof_features(spine, features, "user", "t", "seen", parts=20)
    assert result.where("v = 5").count() == 20_000
    sizes = [r["count"] for r in stored[0].groupBy("__part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3 * 20_000 / 20


def test_many_spine_rows_at_few_instants(spark):
    """Instants are looked up once, so they need no cut of their own."""
    days = F.date_add(F.lit("2024-01-01"), (F.col("id") % 4).cast("int"))
    spine = spark.range(6_000).select("id", F.lit("hot").alias("user"), days.alias("d"))
    features = spark.createDataFrame(
        [("hot", "2024-01-02", 1), ("hot", "2024-01-04", 2)], "user string, seen string, v int"
    ).withColumn("seen", F.to_date("seen"))
    result = asof.asof_features(spine, features, "user", "d", "seen", parts=60)
    got = {(str(r.d), r.v): r.n for r in result.groupBy("d", "v").agg(F.count("*").alias("n"))
           .collect()}
    assert got == {
        ("2024-01-01", None): 1500,
        ("2024-01-02", 1): 1500,
        ("2024-01-03", 1): 1500,
        ("2024-01-04", 2): 1500,
    }


def test_latest(spark):
    features = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 5, "p"), ("b", 5, "q")],
        "id string, ts int, v string",
    )
    result = latest_features(features, "id", "ts")
    assert result.columns == ["id", "ts", "v"]
    assert [tuple(r) for r in result.orderBy("id").collect()] == [("a", 3, "y"), ("b", 5, "q")]


def test_latest_row_with_a_map_and_a_tie(spark):
    features = spark.createDataFrame(
        [("a", 1, 1, {"x": 1}), ("a", 2, 1, {"x": 2}), ("a", 2, 3, {"x": 3}), ("b", 1, 1, None)],
        "id string, ts int, n int, m map<string,int>",
    )
    found = {r["id"]: r["m"] for r in latest_features(features, "id", "ts", ["n"]).collect()}
    assert found == {"a": {"x": 3}, "b": None}
