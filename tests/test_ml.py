import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tablecraft import sources
from tablecraft.operators import classify, metrics, scaling
from tablecraft.operators.quality import QualityError
from tablecraft.plans import churn

SEPARABLE = [
    (1, 0.1, 10, 0), (2, 0.9, 90, 1), (3, 0.2, 20, 0), (4, 0.8, 80, 1), (5, 0.15, 15, 0),
    (6, 0.85, 85, 1), (7, 0.25, 25, 0), (8, 0.75, 75, 1), (9, 0.3, 30, 0), (10, 0.7, 70, 1),
]


@pytest.fixture(scope="module")
def separable(spark):
    return spark.createDataFrame(
        SEPARABLE, "user_id bigint, feature_a double, feature_b bigint, label int"
    )


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(0)
    data = []
    for i in range(400):
        x, y = rng.gauss(5, 3), rng.gauss(-100, 40)
        p = 1 / (1 + np.exp(-(0.5 * (x - 5) - 0.02 * (y + 100) + 0.3)))
        data.append((i, x, y, 7.0, int(rng.random() < p)))
    return spark.createDataFrame(
        data, "user_id int, x double, y double, constant double, label int"
    )


def test_scaler_uses_population_std(spark, noisy):
    columns = ["x", "y", "constant"]
    scaled = scaling.fit_scaler(noisy, columns).transform(noisy)
    assert scaled.columns == noisy.columns
    data = np.array([[r.x, r.y, r.constant] for r in noisy.orderBy("user_id").collect()])
    want = (data - data.mean(0)) / np.where(data.std(0) > 0, data.std(0), 1)
    got = np.array([[r.x, r.y, r.constant] for r in scaled.orderBy("user_id").collect()])
    assert np.allclose(got, want, atol=1e-12)


def test_scaler_needs_rows(noisy):
    with pytest.raises(ValueError, match="cannot scale"):
        scaling.fit_scaler(noisy.where("false"), ["x"])


@pytest.mark.parametrize("C", [0.1, 1.0, 20.0])
def test_solution_is_a_stationary_point(noisy, C):
    """Gradient of 0.5|w|^2 + C sum(loss) is 0, the intercept unpenalised."""
    model = classify.fit_logistic(noisy, ["x", "y", "constant"], C=C, tol=1e-10)
    fitted = model.stages[-1]
    data = np.array([[r.x, r.y, r.constant, r.label] for r in noisy.collect()])
    features = data[:, :3]
    scale = np.where(features.std(0) > 0, features.std(0), 1)
    z = (features - features.mean(0)) / scale
    w, b = fitted.coefficients.toArray(), fitted.intercept
    residual = 1 / (1 + np.exp(-(z @ w + b))) - data[:, 3]
    assert np.allclose(w + C * z.T @ residual, 0, atol=1e-4)
    assert abs(residual.sum()) < 1e-4


def test_features_are_the_remaining_columns(separable):
    stamped = separable.withColumn("feature_timestamp", F.current_timestamp())
    assert classify.feature_columns(stamped) == ["feature_a", "feature_b"]


def test_train_and_gate(spark, separable, tmp_path):
    run = churn.train_and_gate(separable, model_base=str(tmp_path), run_id="r1")
    assert run.metrics == {"auc": 1.0, "f1": 1.0}
    assert run.path == f"{tmp_path}/churn_prediction/r1"
    snapshot = sources.read_parquet(spark, f"{run.path}/eval_data")
    assert snapshot.count() == 10
    again = classify.score(sources.load_model(run.path), snapshot)
    assert again.orderBy("user_id").collect() == run.scores.orderBy("user_id").collect()
    assert again.where("probability < 0 OR probability > 1").count() == 0


def test_gate_stops_a_poor_model(noisy):
    with pytest.raises(metrics.GateError, match="auc="):
        churn.train_and_gate(noisy, {"auc": 0.999})


def test_holdout_scores_only_unseen_users(noisy):
    run = churn.train_and_gate(noisy, {"auc": 0.5}, holdout_percent=30)
    held_out = noisy.where(F.pmod(F.xxhash64("user_id"), F.lit(100)) < 30).count()
    assert 0 < run.scores.count() == held_out < 400


def test_training_rejects_bad_input(spark, separable):
    with pytest.raises(QualityError, match="single class"):
        classify.fit_logistic(separable.where("label = 1"))
    with pytest.raises(QualityError, match="no rows"):
        classify.fit_logistic(separable.where("false"))
    holey = separable.withColumn("feature_a", F.expr("IF(user_id = 3, NULL, feature_a)"))
    with pytest.raises(QualityError, match="1 training rows"):
        classify.fit_logistic(holey)
    assert classify.fit_logistic(holey, invalid="skip")
    with pytest.raises(TypeError):
        classify.fit_logistic(separable, epochs=3)
    with pytest.raises(ValueError, match="saga"):
        classify.fit_logistic(separable, solver="saga")


def scored(spark, seed, n, distinct):
    rng = random.Random(seed)
    data = [(rng.randrange(distinct) / distinct, int(rng.random() < 0.4)) for _ in range(n)]
    return data, spark.createDataFrame(data, "probability double, label int")


@pytest.mark.parametrize("n, distinct", [(300, 1), (300, 7), (500, 400), (60, 10_000)])
@pytest.mark.parametrize("scores_per_range", [1, 100, 500_000])
def test_auc_with_ties(spark, n, distinct, scores_per_range):
    data, df = scored(spark, n + distinct, n, distinct)
    positives = [p for p, y in data if y]
    negatives = [p for p, y in data if not y]
    pairs = sum((a > b) + (a == b) / 2 for a in positives for b in negatives)
    want = round(pairs / len(positives) / len(negatives), 4)
    found = metrics.evaluate(df, ["auc"], scores_per_range=scores_per_range)
    assert found.first().auc == pytest.approx(want)


def test_ranges_follow_the_distinct_scores(spark, monkeypatch):
    """2,000,000 scores: no range holds many more than the target."""
    stored = []
    keep = metrics.store_in_ranges

    def spied(*args, **options):
        stored.append(keep(*args, **options))
        return stored[-1]

    monkeypatch.setattr(metrics, "store_in_ranges", spied)
    df = spark.range(2_000_000).select(
        (F.col("id") / 2_000_000).alias("probability"), (F.col("id") % 3 == 0).cast("int").alias("label")
    )
    found = metrics.evaluate(df, ["auc"], scores_per_range=100_000).first()
    assert found.auc == pytest.approx(0.5, abs=1e-4)
    sizes = [r["count"] for r in stored[0].groupBy("__part").count().collect()]
    assert len(sizes) >= 18 and max(sizes) <= 150_000

def test_auc_equals_the_spark_evaluator(spark):
    _, df = scored(spark, 9, 2000, 150)
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="probability", labelCol="label", numBins=0
    )
    assert metrics.evaluate(df, ["auc"]).first().auc == pytest.approx(
        evaluator.evaluate(df), abs=6e-5
    )


def test_one_score_holds_a_third_of_the_rows(spark):
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / 90_000.0).alias("probability"),
        (F.col("id") % 2).alias("label"),
    )
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="probability", labelCol="label", numBins=0
    )
    got = metrics.evaluate(df, ["auc"]).first().auc
    assert got == pytest.approx(evaluator.evaluate(df), abs=6e-5)


@pytest.mark.parametrize("with_auc", [True, False])
def test_threshold_metrics(spark, with_auc):
    data, df = scored(spark, 4, 200, 20)
    tp = sum(p > 0.5 and y == 1 for p, y in data)
    fp = sum(p > 0.5 and y == 0 for p, y in data)
    fn = sum(p <= 0.5 and y == 1 for p, y in data)
    tn = len(data) - tp - fp - fn
    names = (["auc"] if with_auc else []) + ["f1", "accuracy", "precision", "recall"]
    row = metrics.evaluate(df, names).first()
    assert list(row.asDict()) == names
    assert row.f1 == round(2 * tp / (2 * tp + fp + fn), 4)
    assert row.accuracy == round((tp + tn) / len(data), 4)
    assert row.precision == round(tp / (tp + fp), 4)
    assert row.recall == round(tp / (tp + fn), 4)


def test_undefined_metrics(spark):
    none_above = spark.createDataFrame([(0.5, 0), (0.1, 0)], "probability double, label int")
    row = metrics.evaluate(none_above, metrics.METRICS).first()
    assert row.asDict() == {
        "auc": None, "f1": 0.0, "accuracy": 1.0, "precision": 0.0, "recall": 0.0
    }
    with pytest.raises(ValueError, match="ndcg"):
        metrics.evaluate(none_above, ["ndcg"])


def test_gate(spark):
    row = spark.createDataFrame([(0.5, 0.7)], "auc double, f1 double")
    assert metrics.gate(row, {"auc": 0.5, "f1": 0.4}) == {"auc": 0.5, "f1": 0.7}
    with pytest.raises(metrics.GateError) as error:
        metrics.gate(row, {"auc": 0.9, "f1": 0.8})
    assert "auc=0.5 < 0.9" in str(error.value) and "f1=0.7 < 0.8" in str(error.value)
    with pytest.raises(metrics.GateError, match="not computed"):
        metrics.gate(row, {"recall": 0.1})
    with pytest.raises(metrics.GateError, match="no metrics"):
        metrics.gate(row.where("false"), {"auc": 0.1})
    report = metrics.gate_report(row, {"auc": 0.5, "f1": 0.8}).collect()
    assert [(r.metric, r.passed) for r in report] == [("auc", True), ("f1", False)]


def test_label_distribution(separable):
    assert sorted(map(tuple, churn.label_distribution(separable).collect())) == [(0, 5), (1, 5)]


@pytest.mark.parametrize("row", [(None, 1), (0.3, None), (0.3, 2)])
def test_unusable_rows_are_errors(spark, row):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), row], "probability double, label int")
    with pytest.raises(Exception, match="score is missing"):
        metrics.evaluate(df, ["accuracy"]).collect()
    with pytest.raises(Exception, match="score is missing"):
        metrics.evaluate(df, ["auc"]).collect()
