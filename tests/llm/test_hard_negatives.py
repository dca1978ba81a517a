import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import hard_negatives
from tablecraft.llm.queries import queries
from tablecraft.llm.text import table

SCHEMA = "vec_id long, label long, vector array<long>, cell long, query string, score long"


def plain_mine(rows, every, positives=5, negatives=10, low=30, high=90):
    top = hard_negatives.LARGEST
    rows = {
        (i, label, tuple(v))
        for i, label, v in rows
        if None not in (i, label, v) and all(x is not None and abs(x) < top for x in v)
    }
    found = set()
    for anchor in rows:
        if anchor[0] % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(anchor[2], row[2])), row[0], row[1])
            for row in rows
            if row != anchor
        )
        same = [(-s, i) for s, i, label in scored if label == anchor[1]][:positives]
        for p, positive in same:
            ok = [(-s, i) for s, i, label in scored
                  if label != anchor[1] and low * p <= -100 * s <= high * p]
            for rank, (s, i) in enumerate(ok[:negatives], 1):
                found.add((anchor[0], positive, rank, i, p, s))
    return sorted(found)


def mined(spark, rows, every, **options):
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    found = hard_negatives.mine(frame, F.col("vec_id") % every == 0, **options)
    assert found.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    return sorted({tuple(r) for r in found.collect()})


def clustered(seed, count, dims=6, labels=4, spread=30):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-200, 200, (7, dims))
    return [
        (i, int(rng.integers(labels)), (centers[i % 7] + rng.integers(-spread, spread, dims)).tolist())
        for i in range(count)
    ]


@pytest.mark.parametrize("block, first", [(32_768, 4096), (7, 20)])  # small: many rounds
def test_results_equal_brute_force(spark, monkeypatch, block, first):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ASKED", 5)
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", first)
    rows = clustered(1, 300) + [(i, i % 3, [5, 5, 5, 5, 5, 5]) for i in range(300, 380)]
    assert mined(spark, rows, 9) == plain_mine(rows, 9)


def test_edge_cases(spark):
    """Nulls, empty and short vectors, ties, repeated rows and ids, huge components."""
    random.seed(3)
    rows = [
        (None, 1, [1, 2]), (1, None, [1, 2]), (2, 1, None), (3, 1, [1, None]), (4, 1, [2**40, 1]),
        (10, 1, []), (20, 1, [7]), (20, 1, [7]), (20, 2, [7, 7]), (-10, 1, [3, -9, 4]),
        (30, 1, [2**26, 2**26]), (40, 2, [2**26, 2**25, 2**24]), (50, 1, [2**26, 2**26 - 1]),
    ]
    rows += [(i, i % 2 + 1, [i % 5, i % 3, 0]) for i in range(60, 160)]
    assert mined(spark, rows, 10) == plain_mine(rows, 10)
    assert mined(spark, rows, 5, positives=2, negatives=3) == plain_mine(rows, 5, 2, 3)


def test_empty_and_single_tables(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(0, 1, [1, 1])], 1) == []
    assert mined(spark, [(0, 1, [1, 1]), (1, 1, [2, 2])], 1) == []


def test_visits_bound_every_later_score():
    rng = np.random.default_rng(2)
    rows = rng.integers(-99, 99, (400, 8)).astype(float)
    books = hard_negatives.fit_codebook(rows[:, :4], 5), hard_negatives.fit_codebook(rows[:, 4:], 5)
    one, near = hard_negatives._nearest(rows[:, :4], books[0])
    two, far = hard_negatives._nearest(rows[:, 4:], books[1])
    counts, radii = np.zeros((5, 5), int), (np.zeros((5, 5)), np.zeros((5, 5)))
    np.add.at(counts, (one, two), 1)
    np.maximum.at(radii[0], (one, two), near)
    np.maximum.at(radii[1], (one, two), far)
    directory = hard_negatives.Directory(4, 8, books, counts, radii)
    for query in rows[:20]:
        scores = rows @ query
        visits = list(directory.visits(query))
        assert sorted(cell for _, cell, _, _ in visits) == sorted(np.unique(one * 5 + two).tolist())
        left = set(range(25))
        for order, cell, upper, lower in visits:
            inside = scores[one * 5 + two == cell]
            assert lower <= inside.min() and inside.max() <= upper
            assert scores[np.isin(one * 5 + two, list(left))].max() <= order
            left.discard(cell)


def test_query_over_the_small_table(spark, small):
    rows = [
        (r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"],
         [int(np.floor(256 * float(x))) for x in r["embedding"]])
        for r in table(spark, small, "embeddings").collect()
    ]
    found = queries()["op11_hard_negatives"](spark, small)
    assert sorted(tuple(r) for r in found.collect()) == plain_mine(rows, 100)
