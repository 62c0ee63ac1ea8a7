"""Expanding-window folds: train on everything before the test year, test on that year.

Fold statistics are built from per-year partial statistics. A fold is a union of whole years,
so the rows are read once and only the small per-year table is repeated per fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions import scalars as S


@dataclass(frozen=True)
class Years:
    """Seed training years (inclusive) and the years that are tested in turn."""

    # Default year ranges.
    train_from: int = 1960
    train_to: int = 1980
    test_from: int = 1981
    test_to: int = 9999

    def in_train(self, year: Column) -> Column:
        return year.between(self.train_from, self.train_to)

    def in_test(self, year: Column) -> Column:
        return year.between(self.test_from, self.test_to)


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("date"))


def split_rows(df: DataFrame, years: Years) -> DataFrame:
    """Tag rows ``train`` or ``test`` by year; rows of neither range are left out."""
    year = F.col("year")
    part = F.when(years.in_train(year), "train").when(years.in_test(year), "test")
    return df.withColumn("part", part).filter(F.col("part").isNotNull())


def test_years(df: DataFrame, years: Years) -> DataFrame:
    """Distinct test years in order."""
    return df.select("year").filter(years.in_test(F.col("year"))).distinct().orderBy("year")


def fold_list(df: DataFrame, years: Years) -> list[int]:
    """The test years on the driver: one number per calendar year."""
    found = [row.year for row in test_years(df, years).collect()]
    if not found:
        raise ValueError(f"no rows in the test years {years.test_from}-{years.test_to}")
    return found


def _folds_of(year: Column, folds: Sequence[int], years: Years) -> Column:
    """Folds in which a row of ``year`` takes part, as test row or as training row."""
    every = F.array(*[F.lit(f) for f in folds])
    takes_part = years.in_train(year) | year.isin(*folds)
    return F.when(takes_part, F.filter(every, lambda fold: fold >= year))


def membership(df: DataFrame, folds: Sequence[int], years: Years) -> DataFrame:
    """A row per (row, fold) with its role. Narrow: no join, no shuffle."""
    year = F.col("year")
    return df.withColumn("fold_year", F.explode(_folds_of(year, folds, years))).withColumn(
        "role", F.when(year == F.col("fold_year"), "test").otherwise("train")
    )


def fold_counts(df: DataFrame, folds: Sequence[int], years: Years) -> DataFrame:
    """Rows, classes and date range per fold and role, from per-year counts."""
    per_year = df.groupBy("year").agg(
        F.count("*").alias("n"),
        F.sum("target").alias("up"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    )
    return (
        membership(per_year, folds, years)
        .groupBy("fold_year", "role")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("up").alias("n_up"),
            F.min("first").alias("first_date"),
            F.max("last").alias("last_date"),
        )
    )


def expanding_train(df: DataFrame, years: Years, test_year: int | Column) -> DataFrame:
    """Seed training rows plus every earlier test year, as a bag union.

    The training loop does not use this form: it reads the year-partitioned frame with one
    range filter, which prunes directories.
    """
    year = F.col("year")
    seed = df.filter(years.in_train(year))
    earlier = df.filter(years.in_test(year) & (year < test_year))
    return seed.unionByName(earlier)


def train_filter(years: Years, test_year: int) -> Column:
    year = F.col("year")
    return years.in_train(year) | (years.in_test(year) & (year < test_year))


def class_weights(df: DataFrame, folds: Sequence[int], years: Years) -> DataFrame:
    """Balanced weights n / (2 n_class) of each fold's training rows."""
    counts = fold_counts(df, folds, years).filter("role = 'train'")
    n, up = F.col("n_rows"), F.col("n_up")
    half = n / F.lit(2.0)
    return counts.select(
        "fold_year",
        n.alias("n_train"),
        (n - up).alias("n_down"),
        up.alias("n_up"),
        F.try_divide(half, n - up).alias("weight_down"),
        F.try_divide(half, up).alias("weight_up"),
    )


def year_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, squared deviations and range of each column in each year.

    A year's columns are summarised as one vector, with a map-side combine that merges means and
    deviations; only the small result has a row for each column. Values are taken from the columns'
    overall means, a scalar subquery, so that large ones do not cost digits of the deviations.
    """
    usable = {c: S.finite_or_zero(F.col(c).cast("double")) for c in columns}
    centre = df.agg(F.array(*[F.avg(v) for v in usable.values()]).alias("c")).scalar()
    placed = df.select("year", *[v.alias(f"_{i}") for i, v in enumerate(usable.values())], centre.alias("_centre"))
    shifted = F.array(*[F.col(f"_{i}") - F.col("_centre")[i] for i in range(len(columns))])
    wanted = Summarizer.metrics("mean", "variance", "min", "max").summary(array_to_vector(shifted))
    per_year = placed.groupBy("year").agg(
        F.count("*").alias("n"), wanted.alias("found"), F.first("_centre").alias("centre")
    )
    parts = {"mean": "mean", "var": "variance", "lo": "min", "hi": "max"}
    arrays = [vector_to_array(F.col(f"found.{c}")).alias(a) for a, c in parts.items()]
    named = F.array(*[F.lit(c) for c in columns]).alias("feature")
    rows = per_year.select("year", "n", *arrays, named, "centre")
    rows = rows.select("year", "n", F.inline(F.arrays_zip("feature", *parts, "centre")))
    back = {c: F.col(c) + F.col("centre") for c in ("mean", "lo", "hi")}
    # The summary's variance is the sample's.
    return rows.withColumns({**back, "m2": F.col("var") * (F.col("n") - 1)}).drop("centre")


def scaler_stats(df: DataFrame, columns: Sequence[str], folds: Sequence[int], years: Years) -> DataFrame:
    """Mean and population deviation of each fold's training rows; a constant column scales by 1.

    Years merge by the parallel-variance rule, deviations taken from the merged mean, which
    does not cancel the way a difference of large squares does.
    """
    rows = membership(year_moments(df, columns), folds, years).filter("role = 'train'")
    fold = Window.partitionBy("fold_year", "feature")
    merged_mean = F.sum(F.col("n") * F.col("mean")).over(fold) / F.sum("n").over(fold)
    shift = F.col("mean") - F.col("merged")
    merged = (
        rows.withColumn("merged", merged_mean)
        .groupBy("fold_year", "feature")
        .agg(
            F.sum("n").alias("n_train"),
            F.max("merged").alias("mean"),
            F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    )
    std = F.sqrt(F.col("m2") / F.col("n_train"))
    constant = (F.col("lo") == F.col("hi")) | (std == 0)
    return merged.select(
        "fold_year", "feature", "n_train", "mean", F.when(constant, F.lit(1.0)).otherwise(std).alias("scale")
    )


def standardised_test_rows(
    df: DataFrame, columns: Sequence[str], folds: Sequence[int], years: Years
) -> DataFrame:
    """Test rows of every fold, standardised with that fold's training statistics."""
    entry = F.struct("feature", F.struct("mean", "scale"))
    per_fold = (
        scaler_stats(df, columns, folds, years)
        .groupBy("fold_year")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("stats"))
        .withColumnRenamed("fold_year", "year")
    )
    # One row per test year with a fixed number of features: small by the calendar.
    joined = df.join(F.broadcast(per_fold), "year")
    return joined.select(
        *[c for c in ("series_id", "date", "year", "target") if c in df.columns],
        *[
            (
                (S.finite_or_zero(F.col(c).cast("double")) - F.col("stats")[c]["mean"]) / F.col("stats")[c]["scale"]
            ).alias(c)
            for c in columns
        ],
    )
