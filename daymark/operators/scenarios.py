"""Monte-Carlo scenarios for the days after the last observation.

Every horizon day restarts from the last price and takes a fresh path of that many returns.
Days and simulations come from generators, the returns of a path from an array expression, so
a series expands to its scenarios without any join or shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.functions import draws, scalars as S
from daymark.operators import align, features

# Forecast geometry.
HISTORY_ROWS = 100
RETURN_ROWS = 60
CONTEXT_ROWS = 50
SIMULATIONS = 10
HORIZON_DAYS = 7


def return_stats(df: DataFrame, keys: Sequence[str] = ("series_id",), rows: int = RETURN_ROWS) -> DataFrame:
    """Last date and price of each series, mean and sample deviation of its recent returns."""
    w = features.series_window(keys)
    recent = align.recent_rows(df.select(*keys, "date", "price"), rows, keys)
    moved = recent.withColumn("ret", S.ratio(F.col("price"), F.lag("price", 1).over(w)) - 1.0)
    return moved.groupBy(*keys).agg(
        F.max("date").alias("last_date"),
        F.max_by("price", "date").alias("last_price"),
        F.count("ret").alias("n_returns"),
        F.avg("ret").alias("mean_return"),
        F.stddev_samp("ret").alias("std_return"),
    )


def forecast_calendar(stats: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:
    """The next calendar days of each series, weekends included."""
    horizon = stats.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    return horizon.withColumns(
        {"date": S.days_after(F.col("last_date"), F.col("day")), "day_label": S.day_label(F.col("day"))}
    )


def paths(
    stats: DataFrame,
    seed: int,
    days: int = HORIZON_DAYS,
    simulations: int = SIMULATIONS,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """One simulated price per (series, day, simulation): last price times compounded returns."""
    grid = forecast_calendar(stats, days).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
    identity = [F.col(k) for k in keys] + [F.col("day"), F.col("sim")]

    def step_growth(step):
        draw = draws.keyed_normal(*identity, step, F.lit(seed))
        return F.lit(1.0) + F.col("mean_return") + F.col("std_return") * draw

    growth = F.aggregate(
        F.sequence(F.lit(1), F.col("day")), F.lit(1.0), lambda acc, step: acc * step_growth(step)
    )
    return grid.withColumn("sim_price", F.col("last_price") * growth)


def scenario_context(engineered: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Feature values of the row right after the history, one row per series.

    The synthetic row always directly follows the history, so its lagged features do not depend
    on the horizon day or the simulated price: computed once per series, not per scenario.
    """
    raw = [c for c in engineered.columns if c in (*keys, "date", *features.RAW_FEATURES)]
    history = align.recent_rows(engineered.select(*raw), CONTEXT_ROWS, keys)
    extended = align.append_future_row(history, 1, {}, keys)
    return align.last_row(features.engineer(extended, keys), keys)


def scenario_rows(
    engineered: DataFrame,
    simulated: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Model input per scenario: the series' constant features and the simulated price."""
    context = scenario_context(engineered, keys).drop("date", "price")
    joined = simulated.join(context, list(keys))
    kept = [c for c in columns if c != "price"]
    present = set(joined.columns)
    return joined.select(
        *keys,
        "day",
        "day_label",
        "sim",
        "date",
        "last_price",
        "sim_price",
        F.col("sim_price").alias("price"),
        *[F.col(c) if c in present else F.lit(0.0).alias(c) for c in kept],
    )


def summarise(scored: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Per day: majority class (tie DOWN), mean probabilities in percent, median price, change.

    ``confidence`` is the mean probability of the voted class and can fall below 50, because
    votes and mean probabilities may disagree. The median sees one price per simulation.
    """
    up_votes, n = F.sum("predicted"), F.count("*")
    votes = scored.groupBy(*keys, "day", "date").agg(
        n.alias("n_sims"),
        up_votes.alias("n_up_votes"),
        F.when(up_votes * 2 > n, 1).otherwise(0).alias("vote"),
        (F.avg(1.0 - F.col("probability_up")) * 100).alias("prob_down"),
        (F.avg("probability_up") * 100).alias("prob_up"),
        F.median("sim_price").alias("estimated_price"),
        F.max("last_price").alias("last_price"),
    )
    return votes.select(
        *keys,
        "day",
        "date",
        S.day_label(F.col("day")).alias("day_label"),
        "n_sims",
        "n_up_votes",
        "vote",
        S.direction_label(F.col("vote")).alias("predicted_movement"),
        F.when(F.col("vote") == 1, F.col("prob_up")).otherwise(F.col("prob_down")).alias("confidence"),
        "prob_down",
        "prob_up",
        "estimated_price",
        (F.col("estimated_price") - F.col("last_price")).alias("price_change"),
    )


def forecast_records(summary: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The eight published forecast fields per series and day."""
    return summary.select(
        *keys,
        "date",
        F.col("day_label").alias("day"),
        "predicted_movement",
        "confidence",
        "prob_down",
        "prob_up",
        "estimated_price",
        "price_change",
    )
