"""One registered query per operator: each reads whole tables from ``folder``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.functions import draws, scalars as S
from daymark.operators import (
    align, asof, blocked, ensemble, features, foldfit, folds, incremental, labels, metrics, oversample, quantile, rolling, scenarios,
)
from daymark.plans import jobs
from daymark.session import materialise, scratch_path
from daymark.sources import files, sinks, tables

SERIES = "series_id"
YEARS = folds.Years(train_from=1995, train_to=1997, test_from=1998, test_to=2001)
SEED = 20240101

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round computed doubles so that engines that add in another order agree."""
    return df.withColumns({c: F.round(F.col(c), n) + 0.0 for c, n in digits.items()})


def rounded_features(df: DataFrame, std: int = 2) -> DataFrame:
    """Round sums and deviations; lags, differences and single ratios are exact in any engine.

    ``std`` decimals of a deviation: daily prices have nine digits before the point, events two.
    """
    digits = {"ma": 5, "std": std, "volatility": 8}
    found = {c: n for c in df.columns for prefix, n in digits.items() if c.startswith(prefix)}
    return rounded(df, **found)


# ---------------------------------------------------------------- shared frames


TRENDS = ["trend_a", "trend_b"]


def aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Segment prices with their side series.

    Both side series come from the line items per day. That table has a row per calendar day
    and is written once, so the largest table is scanned once and the joins know their sizes.
    """
    daily = materialise(tables.ship_daily(spark, folder), "ship-daily")
    trend = align.upsample_daily(tables.weekly_trend(daily), TRENDS)
    return align.left_align(tables.segment_price(spark, folder), tables.ship_rates(daily), trend).select(
        SERIES, "date", "price", "n_orders", "rate", "fx", *TRENDS
    )


def combined(spark: SparkSession, folder: str) -> DataFrame:
    values = ["price", "n_orders", "rate", "fx", "trend_a", "trend_b"]
    return align.fill_gaps(aligned(spark, folder), values)


def engineered(spark: SparkSession, folder: str) -> DataFrame:
    return folds.with_year(features.engineer(labels.add_target(combined(spark, folder))))


def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    return labels.binary_target(engineered(spark, folder))


def order_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels on the order count, which ties often and so has a no-change class."""
    return labels.add_target(tables.segment_price(spark, folder), "n_orders")


def _feature_group(*builders) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        base = combined(spark, folder)
        added = features.add_features(base, features.series_window(), builders)
        names = [c for c in added.columns if c not in base.columns]
        return rounded_features(added.select(SERIES, "date", *names))

    return run


# ---------------------------------------------------------------- sources and sinks


@query
def src_csv_roundtrip(spark, folder):
    path = scratch_path(spark, "price-csv")
    landed = tables.market_price(spark, folder).select(
        F.col("date").alias("Date"), F.col("n_orders").alias("Volume"), F.col("price").alias("Close")
    )
    # Two folders with different column orders.
    early = F.col("Date") < "1998-01-01"
    landed.filter(early).write.option("header", True).csv(f"{path}/a")
    landed.filter(~early).select("Close", "Date", "Volume").write.option("header", True).csv(f"{path}/b")
    return files.read_price_csv(spark, [f"{path}/a", f"{path}/b"])


@query
def src_csv_semicolon(spark, folder):
    path = scratch_path(spark, "fx-csv")
    landed = tables.ship_rates(tables.ship_daily(spark, folder)).select(F.col("date").alias("Date"), F.col("fx").alias("CLOSE"))
    early = F.col("Date") < "1998-01-01"
    landed.filter(early).write.option("header", True).option("sep", ";").csv(f"{path}/a")
    swapped = landed.filter(~early).select("CLOSE", F.col("Date").alias("DATE"))
    swapped.write.option("header", True).option("sep", ";").csv(f"{path}/b")
    return files.read_fx_csv(spark, [f"{path}/a", f"{path}/b"])


@query
def src_json_observations(spark, folder):
    """Documents of one year each, one per line; a missing value is written as a dot."""
    path = scratch_path(spark, "rate-json")
    value = F.coalesce(F.col("rate").cast("string"), F.lit("."))
    entry = F.struct(S.iso_date(F.col("date")).alias("date"), value.alias("value"))
    documents = (
        tables.ship_rates(tables.ship_daily(spark, folder))
        .groupBy(F.year("date").alias("year"))
        .agg(F.collect_list(entry).alias("observations"))
    )
    documents.select("observations").write.json(path)
    return files.read_observations_json(spark, path, multi_line=False)


@query
def src_json_timeline(spark, folder):
    path = scratch_path(spark, "trend-json")
    point = F.struct(
        F.unix_date("date").cast("bigint").alias("days"),
        (F.unix_date("date").cast("bigint") * 86400).cast("string").alias("timestamp"),
        F.array(
            F.struct(F.col("trend_a").cast("int").alias("extracted_value")),
            F.struct(F.col("trend_b").cast("int").alias("extracted_value")),
        ).alias("values"),
    )
    documents = (
        tables.weekly_trend(tables.ship_daily(spark, folder))
        .groupBy(F.year("date").alias("year"))
        .agg(F.collect_list(point).alias("timeline_data"))
        .select(F.struct("timeline_data").alias("interest_over_time"))
    )
    documents.write.json(path)
    # The scores of these tables are whole.
    return files.read_timeline_json(spark, path, multi_line=False).withColumns({c: F.col(c).cast("int") for c in TRENDS})


@query
def sink_roundtrip(spark, folder):
    shared = scratch_path(spark, "sink")
    path = sinks.write_parquet(tables.segment_price(spark, folder), shared, sinks.COMBINED)
    return spark.read.parquet(path)


@query
def sink_csv_roundtrip(spark, folder):
    labelled = order_labels(spark, folder).select(SERIES, "date", "price", "n_orders", "target")
    shared = scratch_path(spark, "sink")
    sinks.write_csv(labelled, shared, sinks.WITH_TARGET)
    return sinks.read_csv_table(spark, shared, sinks.WITH_TARGET, labelled.schema)


@query
def latest_snapshot(spark, folder):
    return jobs.latest(combined(spark, folder))


# ---------------------------------------------------------------- alignment


@query
def lookback_filter(spark, folder):
    recent = align.lookback(tables.table(spark, folder, "orders"), 3, "o_orderdate")
    return recent.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        tables.total("o_totalprice").alias("price"), F.count("*").alias("n_orders")
    )


@query
def asof_upsample_daily(spark, folder):
    return align.upsample_daily(tables.weekly_trend(tables.ship_daily(spark, folder)), TRENDS)


@query
def left_align(spark, folder):
    return aligned(spark, folder).drop("n_orders")


@query
def ffill_bfill(spark, folder):
    filled = align.fill_gaps(aligned(spark, folder), ["rate", "fx", "trend_a", "trend_b"])
    return filled.select(SERIES, "date", "rate", "fx", "trend_a", "trend_b")


@query
def combined_daily(spark, folder):
    return align.positions(combined(spark, folder)).withColumn("position", F.col("position").cast("bigint"))


@query
def recent_history(spark, folder):
    prices = tables.segment_price(spark, folder).select(SERIES, "date", "price")
    return align.recent_rows(prices, scenarios.HISTORY_ROWS)


@query
def append_future_row(spark, folder):
    prices = tables.segment_price(spark, folder).select(SERIES, "date", "price")
    drift = scenarios.return_stats(prices).select(SERIES, "mean_return")
    guess = F.round(F.col("price") * (1.0 + F.col("mean_return")), 2)
    extended = align.append_future_row(prices.join(drift, SERIES), 1, {"price": guess})
    return extended.select(SERIES, "date", "price")


@query
def series_profile(spark, folder):
    return align.series_profile(combined(spark, folder))


# ---------------------------------------------------------------- labels


@query
def target_label(spark, folder):
    return order_labels(spark, folder).select(SERIES, "date", "n_orders", "target")


@query
def target_distribution(spark, folder):
    return labels.target_distribution(order_labels(spark, folder))


@query
def target_counts(spark, folder):
    return labels.target_counts(order_labels(spark, folder), [SERIES])


@query
def binary_target(spark, folder):
    return labels.binary_target(order_labels(spark, folder)).select(SERIES, "date", "n_orders", "target")


# ---------------------------------------------------------------- features

REGISTRY["lag_features"] = _feature_group(features.lags)
REGISTRY["momentum_features"] = _feature_group(features.momentum)
REGISTRY["lagged_moving_average"] = _feature_group(features.moving_averages)
REGISTRY["lagged_rolling_std"] = _feature_group(features.rolling_stds)
REGISTRY["pct_change_lagged"] = _feature_group(features.price_change, features.fx_change)
REGISTRY["diff_lagged"] = _feature_group(features.rate_change)
REGISTRY["price_trend_flag"] = _feature_group(features.trend_flag)
REGISTRY["volatility_ratio"] = _feature_group(features.volatility)


@query
def features_full(spark, folder):
    return rounded_features(engineered(spark, folder).drop("n_orders"))


@query
def features_incremental(spark, folder):
    """The feature frame of a table that came in steps: early rows, some of them wrong; corrections; the rest."""
    names = ["rate", "fx", *TRENDS]
    rows = materialise(aligned(spark, folder).select(SERIES, "date", "price", *names), "landed")

    def build(df, w):
        return features.add_features(labels.label_over(df, w), w)

    store = incremental.FeatureStore(
        spark, scratch_path(spark, "features"), rows.schema, [SERIES], "date", build, features.HALO, names, backward=True
    )
    early, wrong = F.col("date") < "2000-07-01", F.dayofyear("date") == 200
    store.update(rows.filter(early).withColumn("price", F.when(wrong, 0.0).otherwise(F.col("price"))))
    store.update(rows.filter(early & wrong))
    store.update(rows.filter(~early))
    return rounded_features(features.drop_incomplete(folds.with_year(store.read())))


@query
def src_json_range(spark, folder):
    """A range of landed documents, a folder for each year: the other folders are not opened."""
    path = scratch_path(spark, "rate-json")
    value = F.coalesce(F.col("rate").cast("string"), F.lit("."))
    entry = F.struct(S.iso_date(F.col("date")).alias("date"), value.alias("value"))
    documents = (
        tables.ship_rates(tables.ship_daily(spark, folder))
        .groupBy(F.year("date").alias("year"))
        .agg(F.collect_list(entry).alias("observations"))
    )
    documents.write.partitionBy("year").json(path)
    dates = (dt.date(1996, 3, 10), dt.date(1998, 9, 20))
    return files.read_observations_json(spark, path, multi_line=False, dates=dates)


# ---------------------------------------------------------------- the same over raw events


@query
def event_positions(spark, folder):
    placed = blocked.global_positions(tables.event_stream(spark, folder), [SERIES], "ts", ["event_id"])
    return placed.select(SERIES, "event_id", F.col("position").cast("bigint").alias("position"))


@query
def event_target_label(spark, folder):
    labelled = blocked.blocked_window(
        tables.event_stream(spark, folder), [SERIES], "ts", labels.label_over, halo=1, ties=["event_id"]
    )
    return labelled.select(SERIES, "event_id", "target")


@query
def event_features(spark, folder):
    def apply(df, w):
        return features.add_features(df, w, features.PRICE_FEATURES)

    events = tables.event_stream(spark, folder)
    wide = blocked.blocked_window(events, [SERIES], "ts", apply, features.HALO, ties=["event_id"])
    names = [c for c in wide.columns if c not in (*events.columns, "position")]
    return rounded_features(wide.select(SERIES, "event_id", *names), std=6)


@query
def event_fill(spark, folder):
    filled = blocked.blocked_fill(
        tables.event_purchases(spark, folder), [SERIES], "ts", ["last_purchase"], ties=["event_id"]
    )
    return filled.select(SERIES, "event_id", "last_purchase")


@query
def event_asof_join(spark, folder):
    """Every purchase with its user's latest earlier event of another type."""
    events = tables.table(spark, folder, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    other = events.filter("event_type <> 'purchase'").select(
        "user_id", "ts", F.col("event_id").alias("seen_event"), F.col("event_type").alias("seen_type"), F.col("ts").alias("seen_ts")
    )
    seen = ["seen_event", "seen_type", "seen_ts"]
    return asof.asof_join(bought, other, ["user_id"], "ts", seen, ties=["seen_event"], strict=True)


def median_deviation(windows: np.ndarray) -> np.ndarray:
    """Median distance from the median: no closed form over a moving window."""
    return np.median(np.abs(windows - np.median(windows, axis=1, keepdims=True)), axis=1)


@query
def event_rolling_mad(spark, folder):
    events = tables.event_stream(spark, folder)
    found = rolling.rolling_apply(
        events, [SERIES], "ts", "price", median_deviation, size=20, name="mad20_lag3", lag=3, ties=["event_id"]
    )
    return rounded(found.select(SERIES, "event_id", "mad20_lag3"), mad20_lag3=6)


@query
def event_exact_median(spark, folder):
    events = tables.event_stream(spark, folder)
    return rounded(quantile.exact_quantile(events, [SERIES], "price", 0.5, "median"), median=6)


# ---------------------------------------------------------------- scalars


@query
def scalar_dates(spark, folder):
    day = F.col("date")
    seconds = F.unix_date(day).cast("bigint") * 86400
    return (
        tables.market_price(spark, folder)
        .select(S.parse_date(S.iso_date(day)).alias("date"))
        .select(
            "date",
            S.iso_date(day).alias("iso_date"),
            F.year(day).alias("year"),
            S.years_before(day, 70).alias("lookback_start"),
            S.days_after(day, 7).alias("next_week"),
            seconds.alias("epoch_seconds"),
            S.epoch_timestamp(seconds.cast("string")).alias("epoch_timestamp"),
        )
    )


@query
def nan_to_num(spark, folder):
    raw = S.ratio(F.col("l_discount"), F.col("l_quantity") - 1)
    return rounded(
        tables.table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", S.finite_or_zero(raw).alias("cleaned")
        ),
        cleaned=8,
    )


# ---------------------------------------------------------------- folds


def _model_and_folds(spark, folder):
    """Model rows written once by year: the fold years come from the directories, not a second scan."""
    rows = materialise(model_rows(spark, folder), "model-rows", partition_by="year")
    return rows, folds.fold_list(rows, YEARS)


@query
def train_test_split(spark, folder):
    return folds.split_rows(model_rows(spark, folder), YEARS).select(SERIES, "date", "year", "target", "part")


@query
def test_years(spark, folder):
    return folds.test_years(model_rows(spark, folder), YEARS)


@query
def walkforward_folds(spark, folder):
    rows, fold_years = _model_and_folds(spark, folder)
    return folds.membership(rows, fold_years, YEARS).select("fold_year", "role", SERIES, "date", "target")


@query
def walkforward_fold_counts(spark, folder):
    return folds.fold_counts(*_model_and_folds(spark, folder), YEARS)


@query
def expanding_train_union(spark, folder):
    rows, fold_years = _model_and_folds(spark, folder)
    return folds.expanding_train(rows, YEARS, fold_years[-1]).select(SERIES, "date", "year", "target")


@query
def class_weights(spark, folder):
    weights = folds.class_weights(*_model_and_folds(spark, folder), YEARS)
    return rounded(weights, weight_down=9, weight_up=9)


@query
def fold_scaler_stats(spark, folder):
    rows, fold_years = _model_and_folds(spark, folder)
    stats = folds.scaler_stats(rows, features.model_columns(rows), fold_years, YEARS)
    return rounded(stats, mean=4, scale=4)


@query
def standardized_features(spark, folder):
    rows, fold_years = _model_and_folds(spark, folder)
    names = features.model_columns(rows)
    return rounded(folds.standardised_test_rows(rows, names, fold_years, YEARS), **{c: 5 for c in names})


# ---------------------------------------------------------------- voting, reports, metrics


@query
def soft_vote(spark, folder):
    member = tables.scored_orders(spark, folder).select(
        "row_id",
        F.col("probability_up").alias("p_lr"),
        draws.keyed_uniform(F.col("row_id"), F.lit("gbm")).alias("p_gbm"),
        draws.keyed_uniform(F.col("row_id"), F.lit("rf")).alias("p_rf"),
    )
    p_up = ensemble.soft_vote(F.col("p_lr"), F.col("p_gbm"), F.col("p_rf"))
    voted = member.select("row_id", p_up.alias("probability_up"), ensemble.voted_class(p_up).alias("predicted"))
    return rounded(voted, probability_up=9)


@query
def hist_predictions(spark, folder):
    return ensemble.history_report(tables.scored_orders(spark, folder))


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(tables.scored_orders(spark, folder))


@query
def classification_metrics(spark, folder):
    names = ("accuracy", "f1_score", "up_precision", "down_precision", "up_recall", "down_recall")
    return rounded(metrics.classification_metrics(tables.scored_orders(spark, folder)), **{c: 9 for c in names})


@query
def sample_counts(spark, folder):
    return metrics.sample_counts(
        tables.scored_orders(spark, folder),
        (YEARS.train_from, YEARS.train_to),
        (YEARS.test_from, YEARS.test_to),
    )


@query
def accuracy_verdict(spark, folder):
    judged = metrics.accuracy_verdict(metrics.classification_metrics(tables.scored_orders(spark, folder)))
    return rounded(judged.select("accuracy", "verdict"), accuracy=9)


@query
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(tables.scored_orders(spark, folder)), roc_auc=9)


@query
def smote_oversample(spark, folder):
    """Urgent orders (the smaller class) raised to the ratio; three features per order."""
    scored = tables.scored_orders(spark, folder)
    parts = [F.col("probability_up"), F.dayofyear("date") / 366.0, (F.col("year") - 1995) / 7.0]
    rows = scored.select(
        F.col("row_id").cast("string").alias("series_id"),
        "date",
        array_to_vector(F.array(*parts)).alias("features"),
        F.col("actual").alias("target"),
    )
    counts = metrics.class_counts(scored)
    balanced, _ = oversample.balance(rows, counts.first(), ensemble.SMOTE_RATIO, SEED)
    values = vector_to_array("features")
    return balanced.select("series_id", "date", *[values[i].alias(f"feature_{i}") for i in range(len(parts))], "target")


# ---------------------------------------------------------------- scenarios


def _stats(spark, folder):
    return scenarios.return_stats(tables.segment_price(spark, folder))


def _scored_paths(spark, folder):
    """Paths scored by a fixed logistic curve, so that votes can be checked without a model."""
    p_up = 1.0 / (1.0 + F.exp(-(F.col("sim_price") / F.col("last_price") - 1.0) / 10.0))
    return (
        scenarios.paths(_stats(spark, folder), SEED)
        .withColumn("probability_up", p_up)
        .withColumn("predicted", ensemble.voted_class(F.col("probability_up")))
    )


@query
def return_stats(spark, folder):
    return rounded(_stats(spark, folder), mean_return=8, std_return=8)


@query
def forecast_calendar(spark, folder):
    calendar = scenarios.forecast_calendar(_stats(spark, folder))
    return calendar.select(SERIES, "day", "day_label", "date", S.iso_date(F.col("date")).alias("iso_date"))


@query
def mc_paths(spark, folder):
    paths = scenarios.paths(_stats(spark, folder), SEED)
    growth = (F.col("sim_price") / F.col("last_price")).alias("growth")
    return rounded(paths.select(SERIES, "day", "sim", "date", growth), growth=6)


@query
def mc_vote(spark, folder):
    voted = scenarios.summarise(_scored_paths(spark, folder))
    return rounded(
        voted.select(SERIES, "day", "n_sims", F.col("n_up_votes").cast("bigint"), "vote", "prob_down", "prob_up"),
        prob_down=6,
        prob_up=6,
    )


@query
def mc_price_summary(spark, folder):
    summary = scenarios.summarise(_scored_paths(spark, folder))
    return rounded(
        summary.select(SERIES, "day", "estimated_price", "price_change"), estimated_price=1, price_change=1
    )


@query
def scenario_features(spark, folder):
    return rounded_features(scenarios.scenario_context(engineered(spark, folder)).drop("date", "price"))


# ---------------------------------------------------------------- model training

# Each query below trains for itself: nothing is kept between queries.


def training_frame(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(engineered(spark, folder).drop("n_orders"), "engineered")


def _member(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        p_up = F.col(f"p_{name}")
        return jobs.train(training_frame(spark, folder), YEARS, members=[name]).predictions.select(
            SERIES,
            "date",
            "year",
            "actual",
            ensemble.voted_class(p_up).alias("predicted"),
            p_up.alias("probability_up"),
        )

    return run


REGISTRY["wf_logistic"] = _member("lr")
REGISTRY["wf_gbt"] = _member("gbm")
REGISTRY["wf_random_forest"] = _member("rf")


@query
def wf_logistic_facts(spark, folder):
    """The regression of every fold: its training rows, and whether it is the minimum of its objective."""
    rows = labels.binary_target(training_frame(spark, folder))
    data = ensemble.prepare(rows, features.model_columns(rows), YEARS)
    off = foldfit.violations(data, ensemble.fit_linear(data))
    found = spark.createDataFrame([(f, v < 1e-6) for f, v in off.items()], "fold_year int, is_minimum boolean")
    weights = folds.class_weights(data.frame, data.folds, YEARS).select("fold_year", "n_train", "n_up")
    return weights.join(found, "fold_year")


@query
def oof_predictions(spark, folder):
    return ensemble.history_report(jobs.train(training_frame(spark, folder), YEARS).predictions)


@query
def model_summary(spark, folder):
    return jobs.train(training_frame(spark, folder), YEARS).summary


@query
def forecast_7day(spark, folder):
    frame = training_frame(spark, folder)
    return jobs.forecast(jobs.train_last(frame, YEARS), frame, SEED)


@query
def oof_facts(spark, folder):
    """Out-of-fold rows with what must hold for any fitted model, row by row."""
    found = jobs.train(training_frame(spark, folder), YEARS).predictions
    members = [F.col(f"p_{m}") for m in ensemble.MEMBERS]
    inside = F.forall(F.array(*members, F.col("probability_up")), lambda p: p.between(0, 1))
    voted = F.abs(ensemble.soft_vote(*members) - F.col("probability_up")) < 1e-12
    return found.select(
        SERIES,
        "date",
        "year",
        "actual",
        S.direction_label(F.col("actual")).alias("actual_label"),
        inside.alias("probabilities_fit"),
        voted.alias("vote_is_weighted_mean"),
        (F.col("predicted") == (F.col("probability_up") > 0.5).cast("int")).alias("class_follows"),
    )


@query
def model_summary_facts(spark, folder):
    """The parts of the summary that do not depend on a fit, and whether the others agree."""
    trained = jobs.train(training_frame(spark, folder), YEARS)
    cells = metrics.metrics_from_cells(metrics.confusion_cells(trained.predictions))
    names = ["accuracy", "f1_score", "up_precision", "down_precision"]
    again = cells.select(*[F.col(c).alias(f"_{c}") for c in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # Two frames of one row each.
    joined = trained.summary.withColumn("_one", F.lit(1)).join(again.withColumn("_one", F.lit(1)), "_one")
    return joined.select(
        "model", "training_period", "test_samples", "features_used",
        same.alias("agrees"), F.col("roc_auc").between(0, 1).alias("auc_fits"),
    )


@query
def forecast_facts(spark, folder):
    """Dates, prices and the bounds of the forecast; only its probabilities depend on the model."""
    frame = training_frame(spark, folder)
    found = jobs.forecast(jobs.train_last(frame, YEARS), frame, SEED)
    up, down = F.col("prob_up"), F.col("prob_down")
    shown = F.when(F.col("predicted_movement") == "UP", up).otherwise(down)
    return rounded(
        found.select(
            SERIES, "date", "day", "estimated_price", "price_change",
            (F.abs(up + down - 100) < 1e-6).alias("sums_to_100"),
            (F.abs(F.col("confidence") - shown) < 1e-9).alias("confidence_is_shown"),
        ),
        estimated_price=1,
        price_change=1,
    )
