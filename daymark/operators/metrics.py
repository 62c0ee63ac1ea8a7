"""Classification metrics as one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions import scalars as S
from daymark.session import materialise

# Accuracy bands and their verdicts.
OVERFIT_ABOVE = 0.70
REALISTIC_FROM, REALISTIC_TO = 0.55, 0.65
VERDICTS = ("overfit_warning", "realistic", "needs_tuning")

CELLS = ("tn", "fp", "fn", "tp")


def _cell(actual: int, predicted: int) -> Column:
    return F.count_if((F.col("actual") == actual) & (F.col("predicted") == predicted))


def confusion_cells(df: DataFrame) -> DataFrame:
    """tn, fp, fn, tp in one row; a class that never occurs counts 0."""
    return df.agg(
        _cell(0, 0).alias("tn"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"), _cell(1, 1).alias("tp")
    )


def confusion_matrix(df: DataFrame) -> DataFrame:
    """The same cells as a 2 x 2 matrix, a row per actual class."""
    cells = confusion_cells(df)
    rows = F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_down"), F.col("fp").alias("predicted_up")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_down"), F.col("tp").alias("predicted_up")),
    )
    return cells.select(F.inline(rows))


def _f1(hit: Column, wrong: Column, missed: Column) -> Column:
    return S.guarded_ratio(2 * hit, 2 * hit + wrong + missed)


def metrics_from_cells(cells: DataFrame) -> DataFrame:
    """Accuracy, support-weighted F1, and precision and recall of both directions."""
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    n = tn + fp + fn + tp
    weighted_f1 = S.guarded_ratio((tn + fp) * _f1(tn, fn, fp) + (tp + fn) * _f1(tp, fp, fn), n)
    return cells.select(
        *CELLS,
        n.alias("test_samples"),
        S.guarded_ratio(tn + tp, n).alias("accuracy"),
        weighted_f1.alias("f1_score"),
        S.guarded_ratio(tp, tp + fp).alias("up_precision"),
        S.guarded_ratio(tn, tn + fn).alias("down_precision"),
        S.guarded_ratio(tp, tp + fn).alias("up_recall"),
        S.guarded_ratio(tn, tn + fp).alias("down_recall"),
    )


def classification_metrics(df: DataFrame) -> DataFrame:
    return metrics_from_cells(confusion_cells(df))


def sample_counts(df: DataFrame, train_years: tuple[int, int], test_years: tuple[int, int]) -> DataFrame:
    """Rows in the training and in the test years."""
    year = F.col("year")
    return df.agg(
        F.count_if(year.between(*train_years)).alias("training_samples"),
        F.count_if(year.between(*test_years)).alias("test_samples"),
    )


def class_counts(df: DataFrame) -> DataFrame:
    """Rows of each actual class and their balanced weights n / (2 n_class)."""
    counts = df.agg(
        F.count("*").alias("n_train"),
        F.count_if(F.col("actual") == 0).alias("n_down"),
        F.count_if(F.col("actual") == 1).alias("n_up"),
    )
    half = F.col("n_train") / 2.0
    return counts.select(
        "*",
        F.try_divide(half, F.col("n_down")).alias("weight_down"),
        F.try_divide(half, F.col("n_up")).alias("weight_up"),
    )


def accuracy_verdict(metrics: DataFrame) -> DataFrame:
    """Verdict on the accuracy; null between the realistic band and the overfit threshold."""
    a = F.col("accuracy")
    overfit, realistic, tune = VERDICTS
    verdict = (
        F.when(a > OVERFIT_ABOVE, overfit)
        .when(a.between(REALISTIC_FROM, REALISTIC_TO), realistic)
        .when(a < REALISTIC_FROM, tune)
    )
    return metrics.withColumn("verdict", verdict)


def roc_auc(df: DataFrame) -> DataFrame:
    """Exact area under the ROC curve: the share of (down, up) pairs ranked right, ties half.

    Scores are counted per distinct value and dealt to sorted ranges, written once. Running sums go
    through each range, and one row per range meets in the final one. Ties cannot straddle ranges
    since a score occurs once after counting. Pairs are counted in whole numbers. Null if only one
    class occurs.
    """
    actual = F.col("actual")
    by_score = df.groupBy(F.col("probability_up").alias("score")).agg(
        F.count_if(actual == 0).alias("negatives"), F.count_if(actual == 1).alias("positives")
    )
    ranged = by_score.repartitionByRange("score").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "score-ranges")
    inside = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("negatives").over(inside), F.lit(0))
    # Twice the pairs, so that halves of ties stay whole.
    doubled = F.col("positives").cast("decimal(38,0)") * (2 * F.col("below") + F.col("negatives")).cast("decimal(20,0)")
    ranges = (
        ranged.withColumn("below", below)
        .groupBy("part")
        .agg(F.sum("negatives").alias("negatives"), F.sum("positives").alias("positives"), F.sum(doubled).alias("doubled"))
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    right = F.col("doubled") + 2 * F.col("positives").cast("decimal(20,0)") * F.col("earlier").cast("decimal(20,0)")
    return (
        ranges.withColumn("earlier", F.coalesce(F.sum("negatives").over(earlier), F.lit(0)))
        .agg(F.sum(right).alias("right"), F.sum("positives").alias("n_up"), F.sum("negatives").alias("n_down"))
        .select(
            "n_up",
            "n_down",
            F.try_divide(F.col("right").cast("double") / 2, F.col("n_up") * F.col("n_down").cast("double")).alias("roc_auc"),
        )
    )
