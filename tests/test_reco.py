import numpy as np
import pytest
from pyspark.errors import AnalysisException
from results import rows
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.sql import functions as F

from tablecraft import sources
from tablecraft.operators import factorize, matrix, ranking
from tablecraft.operators.quality import QualityError
from tablecraft.plans import reco

SCHEMA = "user_id string, item_id string, interaction_type string, ts string"
EVENTS = [
    ("u1", "a", "view", "2026-03-01"),
    ("u1", "a", "view", "2026-03-01"),
    ("u1", "b", "purchase", "2026-03-01"),
    ("u2", "a", "purchase", "2026-03-02"),
    ("u2", "c", "signup", "2026-03-02"),
    ("u2", "c", None, "2026-02-28"),
]


@pytest.fixture(scope="module")
def interactions(spark):
    return spark.createDataFrame(EVENTS, SCHEMA).withColumn("ts", F.to_timestamp_ntz("ts"))


def test_extract(interactions):
    assert reco.extract_interactions(interactions, "2026-03-01").count() == 5
    assert reco.training_prepared(interactions).count() == 6


def test_counts_and_profiles(interactions):
    counts = reco.user_item_features(interactions)
    assert ("u1", "a", "view", 2) in rows(counts)
    assert rows(reco.user_profiles(counts)) == [("u1", 2, 3, 1), ("u2", 2, 3, 1)]


def test_matrix(interactions):
    assert rows(matrix.interaction_matrix(interactions)) == [
        ("u1", "a", 2.0),
        ("u1", "b", 3.0),
        ("u2", "a", 3.0),
        ("u2", "c", 2.0),
    ]
    wide = matrix.interaction_matrix_wide(interactions, ["a", "b", "c", "z"])
    assert wide.columns == ["user_id", "item_a", "item_b", "item_c", "item_z"]
    assert rows(wide) == [("u1", 2.0, 3.0, 0.0, 0.0), ("u2", 3.0, 0.0, 2.0, 0.0)]


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 4, (25, 12)) * (rng.random((25, 12)) < 0.4)
    cells = [(f"u{u}", int(i), float(v)) for (u, i), v in np.ndenumerate(dense)]
    return spark.createDataFrame(cells, "user_id string, item_id int, score double")


def _dense(scores, result):
    v = scores.toPandas().pivot(index="user_id", columns="item_id", values="score")
    w = result.user_factors.toPandas().set_index("user_id").factors
    h = result.item_factors.toPandas().set_index("item_id").factors
    v = v.loc[sorted(w.index), sorted(h.index)].to_numpy()
    return v, np.stack(w.sort_index().to_list()), np.stack(h.sort_index().to_list()).T


def _descend(v, w, h):
    """One dense pass over the components of ``w``, in place."""
    gram, target = h @ h.T, v @ h.T
    for j in range(w.shape[1]):
        slope = w @ gram[:, j] - target[:, j]
        w[:, j] = np.maximum(w[:, j] - slope / gram[j, j], 0)


def test_factorization_matches_dense_descent(scores):
    start = factorize.factorize(scores, 4, max_iter=0)
    v, w, h = _dense(scores, start)
    assert start.error == pytest.approx(np.linalg.norm(v - w @ h))
    for _ in range(3):
        _descend(v, w, h)
        transposed = h.T.copy()
        _descend(v.T, transposed, w.T)
        h = transposed.T
    result = factorize.factorize(scores, 4, max_iter=3, tol=0.0)
    _, got_w, got_h = _dense(scores, result)
    assert np.allclose(got_w, w) and np.allclose(got_h, h)
    assert result.error == pytest.approx(np.linalg.norm(v - w @ h))
    assert all(a >= b - 1e-9 for a, b in zip(result.errors, result.errors[1:]))
    assert (got_w >= 0).all() and (got_h >= 0).all()
    again = factorize.reconstruction_error(
        scores, result.user_factors, result.item_factors, result.rank
    )
    assert again.first().error == pytest.approx(result.error)


def test_rank_is_bounded_and_tol_stops(scores):
    few = scores.where("item_id < 3")
    result = factorize.factorize(few, 10, max_iter=30, tol=1.0)
    assert result.rank == 3
    assert result.iterations == 1
    assert len(result.user_factors.first().factors) == 3


def test_starting_rows_without_a_cell_are_kept(spark, scores):
    """They count in the error, and are pulled towards zero."""
    start = factorize.factorize(scores, 2, max_iter=0)
    idle = spark.createDataFrame([("idle", [3.0, 2.0])], start.user_factors.schema)
    init = (start.user_factors.unionByName(idle), start.item_factors)
    before = factorize.factorize(scores, 2, max_iter=0, init=init)
    after = factorize.factorize(scores, 2, max_iter=2, tol=0.0, init=init)
    factors = {r.user_id: r.factors for r in after.user_factors.collect()}
    assert len(factors) == start.user_factors.count() + 1
    assert factors["idle"] == [0.0, 0.0] and before.error > start.error
    plain = factorize.factorize(
        scores, 2, max_iter=2, tol=0.0, init=(start.user_factors, start.item_factors)
    )
    assert after.error == pytest.approx(plain.error)
    with pytest.raises(QualityError, match="lacks a user"):
        factorize.factorize(scores, 2, init=(start.user_factors.limit(1), start.item_factors))


def test_factors_are_stored_with_their_manifest(spark, scores, tmp_path):
    result = factorize.factorize(scores, 3, max_iter=2, tol=0.0)
    path = sources.save_factors(result, str(tmp_path), "reco", "r1", source="interactions")
    assert path == f"{tmp_path}/reco/r1"
    stored = sources.load_factors(spark, path)
    assert (stored.rank, stored.errors, stored.iterations) == (3, result.errors, 2)
    assert rows(stored.user_factors) == rows(result.user_factors)
    assert rows(stored.item_factors) == rows(result.item_factors)
    manifest = sources.read_parquet(spark, f"{path}/factor_manifest")
    assert manifest.first().source == "interactions"
    with pytest.raises(AnalysisException):
        sources.load_factors(spark, f"{tmp_path}/reco/unfinished")


def test_unlisted_items_are_an_error_or_a_column(spark):
    data = [("u", 1, "view"), ("u", 999, "purchase"), ("v", None, "view")]
    seen = spark.createDataFrame(data, "user_id string, item_id int, interaction_type string")
    with pytest.raises(Exception, match="item is not listed"):
        matrix.interaction_matrix_wide(seen, [1, 2]).collect()
    wide = matrix.interaction_matrix_wide(seen, [1, 2], keep_other=True)
    assert wide.columns == ["user_id", "item_1", "item_2", "item_other"]
    assert rows(wide) == [("u", 1.0, 0.0, 3.0), ("v", 0.0, 0.0, 1.0)]


def test_empty_matrix_is_rejected(scores):
    with pytest.raises(QualityError, match="no non-zero cell"):
        factorize.factorize(scores.where("score = 0"))


def test_unknown_hyperparameters_are_rejected(interactions):
    with pytest.raises(TypeError):
        reco.train_recommender(interactions, embedding_dim=64, epochs=50)


def test_train_recommender(interactions):
    result = reco.train_recommender(interactions, 10, max_iter=2)
    assert result.rank == 2
    assert result.user_factors.count() == 2 and result.item_factors.count() == 3


def test_ranking_equals_the_spark_evaluator(spark):
    rng = np.random.default_rng(5)
    recommended = spark.createDataFrame(
        [(u, i, float(s)) for u in range(12) for i, s in enumerate(rng.permutation(40))],
        "user_id int, item_id int, score double",
    )
    relevant = spark.createDataFrame(
        [(u, int(i)) for u in range(14) for i in rng.choice(40, 1 + u % 9, replace=False)],
        "user_id int, item_id int",
    )
    for k in (1, 5, 20):
        lists = (
            recommended.groupBy("user_id")
            .agg(F.expr("transform(array_sort(collect_list((-score, item_id))), x -> x.item_id)"))
            .toDF("user_id", "predicted")
            .join(
                relevant.groupBy("user_id").agg(F.collect_set("item_id").alias("actual")),
                "user_id",
                "right",
            )
            .select(
                F.expr("transform(coalesce(predicted, array()), x -> double(x)) AS prediction"),
                F.expr("transform(actual, x -> double(x)) AS label"),
            )
        )
        got = ranking.ranking_metrics(recommended, relevant, k).first()
        assert got.users == 14
        for name, metric in (("ndcg_at_k", "ndcgAtK"), ("map_at_k", "meanAveragePrecisionAtK")):
            want = RankingEvaluator(metricName=metric, k=k).evaluate(lists)
            assert got[name] == pytest.approx(want, abs=1e-6)


def test_hot_user_keeps_only_k_rows(spark):
    recommended = spark.range(20_000).select(
        F.when(F.col("id") >= 0, "hot").alias("user_id"),
        F.col("id").alias("item_id"),
        F.col("id").alias("score"),
    )
    plan = ranking.top_k(recommended, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert [r.item_id for r in ranking.top_k(recommended, 3).orderBy("rank").collect()] == [
        19999, 19998, 19997
    ]
