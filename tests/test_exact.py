import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablecraft.operators.exact import add_up, digits, exact_totals, total

INF = float("inf")


def summed(spark, values, parts=3):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return exact_totals(df, [], {"s": F.col("x")}).first().s


def exact(values):
    """The double nearest to the sum as a fraction."""
    return float(sum(map(Fraction, values)))


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


CASES = [
    [1 / 3] * 7,
    [0.1] * 10,
    [1e14, 1 / 3, -1e14, 0.004, 1e-9],
    [1e308, 1e308, -1e308],
    [1e308, 1.0, -1e308, 5e-324],
    [5e-324] * 3,
    [2.2250738585072014e-308, -5e-324, 1e-320],
    [1.7976931348623157e308],
    [2.0**53, 1.0, 2.0**-60],  # rounds up, just above the tie
    [2.0**53, 1.0],  # a tie goes to even
    [2.0**53, 1.0, -(2.0**-1074)],
    [-0.0, 0.0],
    [-1.5, 1.5],
    [-7.25, -1e-3],
    [None, 2.5, None],
    [2.0**k for k in range(-1074, 1023, 7)],
]


@pytest.mark.parametrize("values", CASES)
def test_sum_is_the_nearest_double_to_the_exact_sum(spark, values):
    assert summed(spark, values) == exact(v for v in values if v is not None)


def test_random_doubles_of_all_sizes(spark):
    rng = random.Random(4)
    groups = []
    for g in range(40):
        bits = [rng.getrandbits(64) for _ in range(rng.randrange(1, 60))]
        values = [struct.unpack("<d", struct.pack("<Q", b))[0] for b in bits]
        values = [v for v in values if math.isfinite(v) and abs(v) < 1e300]
        groups += [(g, v) for v in values]
    df = spark.createDataFrame(groups, "g int, x double").repartition(5)
    found = {r.g: r.s for r in exact_totals(df, ["g"], {"s": F.col("x")}).collect()}
    for g, s in found.items():
        assert s == exact(v for k, v in groups if k == g)


@pytest.mark.parametrize(
    "values, expected",
    [
        ([1.5, float("nan")], float("nan")),
        ([1.5, INF], INF),
        ([-INF, 2.0], -INF),
        ([INF, -INF], float("nan")),
        ([None], None),
        ([1.7e308, 1.7e308], INF),
    ],
)
def test_odd_values_decide_the_sum(spark, values, expected):
    assert same(summed(spark, values), expected)


def test_order_and_partitioning_make_no_difference(spark):
    df = spark.range(100_000).select((F.col("id") % 7 * 0.1 / 3).alias("x"))
    up = exact_totals(df.repartition(7), [], {"s": F.col("x")}).first().s
    down = exact_totals(df.orderBy(F.desc("x")).coalesce(1), [], {"s": F.col("x")}).first().s
    assert up == down == math.fsum(i % 7 * 0.1 / 3 for i in range(100_000))


def test_several_amounts_averages_and_counts(spark):
    rows = [("a", 1.0, 1e20), ("a", None, 1.0), ("a", 2.0, -1e20), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    found = exact_totals(
        df, ["k"], {"sx": F.col("x"), "sy": F.col("y")}, {"ax": F.col("x")}, {"n": F.count("*")}
    )
    assert found.columns == ["k", "n", "sx", "sy", "ax"]
    assert sorted(map(tuple, found.collect())) == [
        ("a", 3, 3.0, 1.0, 1.5),
        ("b", 1, None, None, None),
    ]


def test_partial_sums_add_up_further(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") % 50).alias("j"), (F.col("id") / 7).alias("x")
    )
    fine = add_up(df.withColumn("x", digits("x")), ["k", "j"], ["x"])
    coarse = add_up(fine, ["k"], ["x"]).groupBy("k").agg(F.collect_list("x").alias("x"))
    for k, s in coarse.select("k", total("x")).collect():
        assert s == math.fsum(i / 7 for i in range(3000) if i % 3 == k)
