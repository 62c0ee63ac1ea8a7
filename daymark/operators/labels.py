"""Next-move labels: 0 no change, 1 decrease, 2 increase; binary form 0 DOWN, 1 UP."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from daymark.functions import scalars as S

# Label codes and their binary recoding.
NO_CHANGE, DECREASE, INCREASE = 0, 1, 2
TO_BINARY = {1: 0, 2: 1}


def move_class(change: Column) -> Column:
    """Class of a change; a null change (first row of a series) is no change."""
    return F.when(change > 0, INCREASE).when(change < 0, DECREASE).otherwise(NO_CHANGE).cast("int")


def add_target(
    df: DataFrame,
    value: str = "price",
    keys: Sequence[str] = ("series_id",),
    order: str = "date",
) -> DataFrame:
    """Label every row of a date-grain series by the difference from the row before it."""
    return label_over(df, Window.partitionBy(*keys).orderBy(order), value)


def label_over(df: DataFrame, w: WindowSpec, value: str = "price") -> DataFrame:
    """Label by the difference from the row before in ``w``."""
    changed = df.withColumn("_change", F.col(value) - F.lag(value, 1).over(w))
    return changed.withColumn("target", move_class(F.col("_change"))).drop("_change")


def binary_target(df: DataFrame) -> DataFrame:
    """Drop the no-change rows and recode the rest to DOWN 0 / UP 1."""
    return df.filter(F.col("target") != NO_CHANGE).withColumn("target", S.mapped(F.col("target"), TO_BINARY))


def target_distribution(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per class, ordered by class."""
    return df.groupBy(*keys, "target").agg(F.count("*").alias("n_rows")).orderBy(*keys, "target")


def target_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same counts side by side, in one pass."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col("target") == NO_CHANGE).alias("n_no_change"),
        F.count_if(F.col("target") == DECREASE).alias("n_decrease"),
        F.count_if(F.col("target") == INCREASE).alias("n_increase"),
        F.countDistinct("target").alias("n_classes"),
    )
