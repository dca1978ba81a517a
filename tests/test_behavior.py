import datetime as dt
import math
import random

import pytest
from results import rows
from pyspark.sql import functions as F

from tablecraft.operators import behavior

AS_OF = dt.date(2024, 3, 31)
SCHEMA = "user_id string, ts timestamp_ntz, event_type string, value double"


def brute_force(events, as_of, gap_seconds):
    """Walk every event of every user; no slots, no windows."""
    by_user = {}
    for user, ts, kind, amount in events:
        if ts.date() <= as_of:
            by_user.setdefault(user, []).append((ts, kind, amount))
    result = []
    for user, seen in by_user.items():
        seen.sort(key=lambda e: e[0])
        logins = [ts.date() for ts, kind, _ in seen if kind in ("view", "click")]
        seen = [e for e in seen if as_of - dt.timedelta(days=90) < e[0].date()]
        sessions = []
        for ts, _, _ in seen:
            if sessions and (ts - sessions[-1][1]).total_seconds() < gap_seconds:
                sessions[-1][1] = ts
            else:
                sessions.append([ts, ts])

        def age(day):
            return (as_of - day).days

        week = [s for s in sessions if age(s[0].date()) < 7]
        paid = math.fsum(
            amount for ts, kind, amount in seen if kind == "purchase" and age(ts.date()) < 30
        )
        result.append(
            (
                user,
                as_of,
                len(week),
                sum(age(s[0].date()) < 30 for s in sessions),
                paid,
                age(max(logins)) if logins else None,
                sum(kind == "error" for _, kind, _ in seen),
                pytest.approx(sum((e - s).total_seconds() for s, e in week) / len(week))
                if week
                else None,
            )
        )
    return sorted(result, key=lambda r: r[0])


def random_events(seed, users, n, days=100):
    rng = random.Random(seed)
    start = dt.datetime(2024, 4, 1) - dt.timedelta(days=days - 1)
    kinds = ["view", "click", "purchase", "error", "signup"]
    events = []
    for _ in range(n):
        # A third of all events belong to one user.
        user = "hot" if rng.random() < 1 / 3 else f"u{rng.randrange(users)}"
        ts = start + dt.timedelta(microseconds=rng.randrange(days * 86_400_000_000))
        events.append((user, ts, rng.choice(kinds), round(rng.random() * 100, 2)))
    return events


@pytest.mark.parametrize("gap", [1800, 6 * 3600, 40 * 3600])
def test_matches_brute_force(spark, gap):
    events = random_events(gap, 12, 3000)
    result = behavior.user_behavioral(spark.createDataFrame(events, SCHEMA), AS_OF, gap)
    assert rows(result, "user_id") == brute_force(events, AS_OF, gap)


def test_several_snapshots_equal_single_ones(spark):
    events = spark.createDataFrame(random_events(5, 6, 800), SCHEMA)
    dates = ["2024-02-10", "2024-03-01", "2024-03-31"]
    together = behavior.user_behavioral(events, dates)
    single = behavior.user_behavioral(events, dates[0])
    for day in dates[1:]:
        single = single.unionByName(behavior.user_behavioral(events, day))
    assert rows(together, "user_id", "feature_date") == rows(single, "user_id", "feature_date")


def test_daily_snapshots_cut_long_sessions(spark):
    """Sessions of many days, open at most snapshots; a snapshot for each of 90 days."""
    start = dt.datetime(2024, 1, 1, 20)
    events = [
        (user, start + dt.timedelta(hours=5 * i), kind, 0.1 * i)
        for user, kind, steps in (("a", "purchase", 400), ("b", "view", 17), ("c", "error", 150))
        for i in range(steps)
        if i % 59 and not (user == "c" and i % 20 == 3)
    ]
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    found = behavior.user_behavioral(spark.createDataFrame(events, SCHEMA), dates).collect()
    for date in dates[::7] + dates[-1:]:
        of_date = sorted((tuple(r) for r in found if r.feature_date == date))
        assert of_date == brute_force(events, date, 6 * 3600)


def test_snapshots_make_no_rows_before_the_shuffle(spark):
    events = spark.createDataFrame([], SCHEMA)
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    plan = behavior.user_behavioral(events, dates)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1
    assert "Exchange" not in plan[: plan.index("Generate")]
    assert plan.count("Exchange hashpartitioning") == 2


def test_odd_amounts_do_not_stop_a_run(spark):
    day = dt.datetime(2024, 3, 30)
    amounts = {"a": [1 / 3, 1e14, 1e-9], "b": [float("inf"), 1.0], "c": [None], "d": [math.nan]}
    events = [(u, day, "purchase", x) for u, values in amounts.items() for x in values]
    found = behavior.user_behavioral(spark.createDataFrame(events, SCHEMA), AS_OF).collect()
    paid = {r.user_id: r.total_purchases_30d for r in found}
    assert paid["a"] == math.fsum(amounts["a"]) and paid["b"] == math.inf and paid["c"] == 0.0
    assert math.isnan(paid["d"])


@pytest.mark.parametrize("gap", [0, behavior.LONGEST_GAP_SECONDS + 1])
def test_gaps_out_of_range_are_errors(spark, gap):
    with pytest.raises(ValueError, match="session gap"):
        behavior.user_behavioral(spark.createDataFrame([], SCHEMA), AS_OF, gap)


def test_gap_and_window_edges(spark):
    def at(text):
        return dt.datetime.fromisoformat(text)

    events = [
        ("a", at("2024-03-31 10:00:00"), "view", 0.0),
        ("a", at("2024-03-31 15:59:59.999999"), "view", 0.0),  # just inside the gap
        ("a", at("2024-03-31 21:59:59.999999"), "view", 0.0),  # exactly the gap: new session
        ("b", at("2024-03-25 00:00:00"), "purchase", 5.0),  # first day of the 7
        ("b", at("2024-03-24 23:59:59"), "purchase", 5.0),  # same session, starts before
        ("c", at("2024-01-02 00:00:00"), "error", 0.0),  # first day of the 90
        ("c", at("2024-01-01 23:59:59"), "error", 0.0),  # outside
        ("d", at("2024-04-01 00:00:00"), "view", 0.0),  # after the snapshot
    ]
    result = behavior.user_behavioral(spark.createDataFrame(events, SCHEMA), AS_OF)
    got = {r.user_id: r for r in result.collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert got["a"].session_count_7d == 2
    assert got["a"].avg_session_duration_s == pytest.approx(21599.999999 / 2)
    assert (got["b"].session_count_7d, got["b"].session_count_30d) == (0, 1)
    assert got["b"].total_purchases_30d == 10.0
    assert got["b"].days_since_last_login is None
    assert got["c"].support_tickets_90d == 1


def test_long_absent_users_keep_their_rows(spark):
    events = [
        ("gone", dt.datetime(2023, 12, 2), "view", 0.0),
        ("back", dt.datetime(2023, 12, 2), "click", 0.0),
        ("back", dt.datetime(2024, 3, 31), "purchase", 7.0),
        ("later", dt.datetime(2024, 4, 1), "view", 0.0),
    ]
    result = behavior.user_behavioral(spark.createDataFrame(events, SCHEMA), AS_OF)
    assert rows(result, "user_id") == [
        ("back", AS_OF, 1, 1, 7.0, 120, 0, 0.0),
        ("gone", AS_OF, 0, 0, 0.0, 120, 0, None),
    ]


def test_hot_user_is_reduced_before_the_session_window(spark):
    """The rows a user sends to the window are bounded by slots, not by events."""
    start = F.lit("2024-03-30").cast("timestamp_ntz")
    events = spark.range(50_000).select(
        F.lit("hot").alias("user_id"),
        (start + F.make_dt_interval(secs=F.col("id"))).alias("ts"),
        F.lit("view").alias("event_type"),
        F.lit(0.0).alias("value"),
    )
    result = behavior.user_behavioral(events, AS_OF).first()
    assert result.session_count_7d == 1
    assert result.avg_session_duration_s == 49_999.0


def test_item_engagement(spark):
    interactions = spark.createDataFrame(
        [
            ("i", "view", "2024-03-31 23:59:59"),
            ("i", "view", "2024-03-25 00:00:00"),
            ("i", "view", "2024-03-24 23:59:59"),
            ("i", "purchase", "2024-03-02 00:00:00"),
            ("i", "purchase", "2024-03-01 23:59:59"),
            ("j", "purchase", "2024-03-31 00:00:00"),
            ("k", "click", "2024-03-31 00:00:00"),
        ],
        "item_id string, interaction_type string, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert rows(behavior.item_engagement(interactions, AS_OF), "item_id") == [
        ("i", 2, 1, 1 / 3),
        ("j", 0, 1, None),
        ("k", 0, 0, None),
    ]


def test_user_demographic(spark):
    customers = spark.createDataFrame(
        [("a", "DE", 10.0), ("b", "FR", 5.0)], "user_id string, country string, balance double"
    )
    orders = spark.createDataFrame(
        [("a", "2024-03-01"), ("a", "2024-03-21"), ("b", "2024-04-02")],
        "user_id string, order_date string",
    ).withColumn("order_date", F.to_date("order_date"))
    result = behavior.user_demographic(customers, orders, AS_OF, premium_above=5.0)
    assert rows(result, "user_id") == [("a", "DE", 30, True), ("b", "FR", None, False)]
