import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from daymark.functions import scalars as S
from daymark.operators import ensemble, metrics

# Published cells and the figures they imply.
CELLS = (3871, 1710, 2427, 3409)
FIGURES = {
    "accuracy": 0.6376456161863887,
    "f1_score": 0.6367232520954996,
    "up_precision": 0.6659503809337761,
    "down_precision": 0.6146395681168625,
    "up_recall": 0.5841329677861549,
    "down_recall": 0.6936032969001971,
}


def scored(spark, actual, probability):
    rows = [(int(a), int(p > 0.5), float(p)) for a, p in zip(actual, probability)]
    return spark.createDataFrame(rows, "actual int, predicted int, probability_up double")


def test_golden_figures(spark):
    cells = spark.createDataFrame([CELLS], "tn bigint, fp bigint, fn bigint, tp bigint")
    row = metrics.metrics_from_cells(cells).first()
    assert row.test_samples == 11417
    for name, value in FIGURES.items():
        assert row[name] == pytest.approx(value, abs=1e-15), name


def test_single_class_has_zero_cells(spark):
    frame = scored(spark, [1, 1, 1], [0.9, 0.8, 0.2])
    row = metrics.classification_metrics(frame).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (0, 0, 1, 2)
    assert (row.down_precision, row.down_recall) == (0.0, 0.0)
    assert metrics.roc_auc(frame).first().roc_auc is None
    matrix = metrics.confusion_matrix(frame).collect()
    assert [(r.actual, r.predicted_down, r.predicted_up) for r in matrix] == [(0, 0, 0), (1, 1, 2)]


def brute_auc(actual, score):
    up, down = score[actual == 1], score[actual == 0]
    diff = up[:, None] - down[None, :]
    return (np.sum(diff > 0) + 0.5 * np.sum(diff == 0)) / diff.size


@pytest.mark.parametrize("digits", [1, 2, 12])
def test_auc_is_exact(spark, digits):
    rng = np.random.default_rng(digits)
    actual = (rng.random(500) < 0.4).astype(int)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * actual, 0.2), 0, 1), digits)
    frame = scored(spark, actual, score).repartition(5)
    auc = metrics.roc_auc(frame).first()
    assert auc.roc_auc == pytest.approx(brute_auc(actual, score), abs=1e-12)
    assert (auc.n_up, auc.n_down) == (actual.sum(), 500 - actual.sum())
    squashed = frame.withColumn("probability_up", F.pow("probability_up", 3))
    assert metrics.roc_auc(squashed).first().roc_auc == pytest.approx(auc.roc_auc, abs=1e-12)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="probability_up", labelCol="actual", numBins=0)
    assert evaluator.evaluate(frame) == pytest.approx(auc.roc_auc, abs=1e-12)


def test_f1_agrees_with_spark_ml(spark):
    rng = np.random.default_rng(4)
    frame = scored(spark, rng.integers(0, 2, 200), rng.random(200))
    evaluator = MulticlassClassificationEvaluator(metricName="f1", labelCol="actual", predictionCol="predicted")
    doubles = frame.select(F.col("actual").cast("double"), F.col("predicted").cast("double"))
    assert metrics.classification_metrics(frame).first().f1_score == pytest.approx(evaluator.evaluate(doubles))


@pytest.mark.parametrize(
    "accuracy, verdict",
    [(0.71, "overfit_warning"), (0.70, None), (0.66, None), (0.65, "realistic"), (0.55, "realistic"), (0.54, "needs_tuning")],
)
def test_verdict_bands(spark, accuracy, verdict):
    frame = spark.createDataFrame([(accuracy,)], "accuracy double")
    assert metrics.accuracy_verdict(frame).first().verdict == verdict


def test_vote_weights_and_tie(spark):
    frame = spark.createDataFrame([(0.8, 0.2, 0.4), (0.5, 0.5, 0.5)], "a double, b double, c double")
    p = ensemble.soft_vote(F.col("a"), F.col("b"), F.col("c"))
    rows = frame.select(p.alias("p"), ensemble.voted_class(p).alias("k")).collect()
    assert rows[0].p == pytest.approx((2 * 0.8 + 0.2 + 0.4) / 4)
    assert [r.k for r in rows] == [1, 0]


def test_history_labels(spark):
    rows = [("s", "2024-01-01", 2024, 1, 0, 0.4), ("s", "2024-01-02", 2024, 2, 1, 0.6)]
    schema = "series_id string, date string, year int, actual int, predicted int, probability_up double"
    got = ensemble.history_report(spark.createDataFrame(rows, schema)).collect()
    assert [(r.actual_label, r.predicted_label, r.correct) for r in got] == [("UP", "DOWN", 0), (None, "UP", 0)]


def test_scalar_edges(spark):
    inf, nan = float("inf"), float("nan")
    frame = spark.createDataFrame([(inf,), (-inf,), (nan,), (None,), (2.5,)], "v double")
    assert [r.v for r in frame.select(S.finite_or_zero(F.col("v")).alias("v")).collect()] == [0, 0, 0, 0, 2.5]
    pairs = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r.v for r in pairs.select(S.ratio(F.col("a"), F.col("b")).alias("v")).collect()] == [inf, -inf, None, 0.25, None]
    text = spark.createDataFrame([(".",), ("1.5",), ("x",)], "t string")
    assert [r.v for r in text.select(S.parse_number(F.col("t")).alias("v")).collect()] == [None, 1.5, None]
