from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablecraft.llm import mixing
from tablecraft.llm.oracles import oracle_sql
from tablecraft.llm.queries import queries
from verification.compare import connect, differences


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by repeated resharing, as the definition says."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 10, "c": 10},
        {"a": 1000, "b": 3, "c": 50, None: 7, "é": 400, "Z": 0},
        {"s%02d" % i: 7 ** (i % 5) for i in range(20)},
        {"only": 5},
        {"zero": 0},
    ],
)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    rows = mixing.source_targets(frame).collect()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(filled(sizes))


def test_query_equals_sql(spark, small):
    name = "op9_mixing_sources"
    assert differences(queries()[name](spark, small), connect(small), oracle_sql()[name]) == []


def test_sources_come_near_their_targets(spark, small):
    rows = mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).collect()
    taken, target, largest = defaultdict(int), {}, max(r["size"] for r in rows)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert sum(taken.values()) <= sum(target.values())


def test_edge_cases(edge_docs, no_docs):
    rows = mixing.mix(edge_docs)
    assert rows.count() == edge_docs.count()
    assert rows.where("size = 0 AND taken > 0").count() == 0
    assert rows.where("doc_id IS NULL").count() == 2
    again = mixing.mix(edge_docs)
    assert rows.exceptAll(again).count() == 0
    assert mixing.mix(no_docs).count() == 0
    repeated = mixing.repeat_rows(edge_docs, rows)
    assert repeated.columns == edge_docs.columns
    per_id = rows.groupBy("doc_id").agg(F.max("copies").alias("n"), F.count("*").alias("rows"))
    expected = per_id.where("doc_id IS NOT NULL").agg(F.sum(F.col("n") * F.col("rows"))).first()[0]
    assert repeated.count() == expected


def test_blank_texts_only(spark, edge_docs):
    blank = edge_docs.where("doc_id IN (3, 4, 5)")
    assert {r["taken"] for r in mixing.mix(blank).collect()} == {0}
