"""Whole jobs: combine landed files, train, forecast, report."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from daymark.functions import scalars as S
from daymark.operators import align, ensemble, features, folds, labels, metrics, scenarios
from daymark.session import materialise
from daymark.sources import files, sinks

# Model name in the summary, lookback in years.
MODEL_NAME = "Ensemble (LR + GBM + RF)"
LOOKBACK_YEARS = 70

SUMMARY_SCHEMA = (
    "model string, accuracy double, roc_auc double, f1_score double, up_precision double, down_precision double, "
    "training_period string, test_samples bigint, features_used int, timestamp timestamp"
)


@dataclass(frozen=True)
class Sources:
    """Paths of the four landed series.

    ``series_column`` names the price column that tells several series apart; without it the
    file is one series called ``series_id``. Rate, exchange rate and trend are shared by all.
    """

    price_csv: str
    rate_json: str
    fx_csv: str
    trend_json: str
    series_id: str = "price"
    series_column: str | None = None
    multi_line_json: bool = True


def combine_sources(
    spark: SparkSession, sources: Sources, as_of: dt.date | None = None, backward: bool = True
) -> DataFrame:
    """Read the four series, check them, and bring them onto the price dates.

    Price and exchange rate look back from their own latest date, the rate from ``as_of``. The result
    is written once, and the job that writes it finds duplicates and columns without a value.
    """
    as_of = as_of or dt.date.today()
    keys = [sources.series_column] if sources.series_column else []
    price = files.read_price_csv(spark, sources.price_csv, keys=keys)
    fx_rows = files.read_fx_csv(spark, sources.fx_csv)
    asked = (S.years_back(as_of, LOOKBACK_YEARS), as_of)
    rate = files.read_observations_json(spark, sources.rate_json, multi_line=sources.multi_line_json, dates=asked)
    trend = files.read_timeline_json(spark, sources.trend_json, multi_line=sources.multi_line_json)

    series = F.col(sources.series_column) if sources.series_column else F.lit(sources.series_id)
    price = align.lookback(price, LOOKBACK_YEARS).select(series.alias("series_id"), "date", "price")
    fx = align.lookback(fx_rows, LOOKBACK_YEARS)

    daily_trend = align.upsample_daily(trend, ["trend_a", "trend_b"])
    combined = align.combine_daily(price, rate, fx, daily_trend, backward=backward)
    values = ["price", "rate", "fx", "trend_a", "trend_b"]
    # A duplicate on any side has multiplied rows of the result.
    checked, seen = align.observed(combined.select("series_id", "date", *values), values)
    written = materialise(checked, "combined")
    if not seen.get["rows"]:
        raise ValueError("price series has no rows")
    if seen.get["empty fx"] is not None:
        files.require_rows(fx_rows, "exchange-rate series")
    align.raise_for(seen)
    return written


def engineer(combined: DataFrame) -> DataFrame:
    """Labelled feature frame with its year, no-change rows included."""
    return folds.with_year(features.engineer(labels.add_target(combined)))


@dataclass
class Trained:
    """What training leaves behind."""

    predictions: DataFrame
    summary: DataFrame
    details: DataFrame
    model: PipelineModel
    columns: list[str]


def summarise_training(
    predictions: DataFrame, engineered: DataFrame, n_features: int, years: folds.Years, stamp: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """One-row summary of ten fields, and the fuller metrics row with cells, verdict and samples.

    ``training_samples`` counts the engineered rows of the seed years, no-change rows included.
    """
    auc = metrics.roc_auc(predictions).select("roc_auc").scalar()
    seed_years, tested = (years.train_from, years.train_to), (years.test_from, years.test_to)
    samples = metrics.sample_counts(engineered, seed_years, tested).select("training_samples").scalar()
    details = metrics.accuracy_verdict(metrics.classification_metrics(predictions)).withColumns(
        {"roc_auc": auc, "training_samples": samples}
    )
    summary = details.select(
        F.lit(MODEL_NAME).alias("model"),
        "accuracy",
        "roc_auc",
        "f1_score",
        "up_precision",
        "down_precision",
        F.format_string("%d-%d", F.lit(years.train_from), F.lit(years.train_to)).alias("training_period"),
        "test_samples",
        F.lit(n_features).alias("features_used"),
        F.lit(stamp).cast("timestamp").alias("timestamp"),
    )
    return summary, details


def train(
    engineered: DataFrame,
    years: folds.Years = folds.Years(),
    feature_set: str = "all",
    smote: bool = False,
    members: Sequence[str] = ensemble.MEMBERS,
    stamp: dt.datetime | None = None,
    max_fit_rows: int = ensemble.MAX_FIT_ROWS,
    resume: str | None = None,
) -> Trained:
    """Walk-forward training on an engineered frame (see :func:`engineer`).

    With ``smote`` at most about ``max_fit_rows`` labelled rows of a fold are used for its fit. Folds that
    an earlier training with the same settings and rows finished below ``resume`` are not fitted again.
    """
    rows = labels.binary_target(engineered)
    columns = features.model_columns(rows, feature_set)
    data = ensemble.prepare(rows, columns, years)
    result = ensemble.walk_forward(data, members, smote, max_fit_rows=max_fit_rows, resume=resume)
    summary, details = summarise_training(
        result.predictions, engineered, len(columns), years, stamp or dt.datetime.now()
    )
    return Trained(result.predictions, summary, details, result.model, columns)


def train_last(engineered: DataFrame, years: folds.Years = folds.Years(), feature_set: str = "all") -> PipelineModel:
    """Only the model that walk-forward training keeps: the one of the last fold."""
    rows = labels.binary_target(engineered)
    data = ensemble.prepare(rows, features.model_columns(rows, feature_set), years)
    ensemble.use_checkpoints(engineered.sparkSession)
    return ensemble.fit_fold(data, data.folds[-1])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """Load a saved model; a missing one is a clear error."""
    try:
        return PipelineModel.load(path)
    except (AnalysisException, Py4JJavaError) as error:
        raise FileNotFoundError(f"no trained model at {path}: train first") from error


def model_inputs(model: PipelineModel) -> list[str]:
    """Feature columns of a saved model, in order."""
    return [c.removeprefix("z_") for c in model.stages[1].getInputCols()]


def forecast(
    model: PipelineModel,
    engineered: DataFrame,
    seed: int,
    days: int = scenarios.HORIZON_DAYS,
    simulations: int = scenarios.SIMULATIONS,
) -> DataFrame:
    """Scenario forecast of the coming days for every series, one scored frame for all of them.

    Only the recent rows of a series matter. They are written once, since both the return
    statistics and the scenario features start from them.
    """
    if len(model.stages) < 2 + len(ensemble.MEMBERS):
        raise ValueError("a forecast needs a model with all members")
    history = materialise(align.recent_rows(engineered, scenarios.HISTORY_ROWS), "history")
    simulated = scenarios.paths(scenarios.return_stats(history), seed, days, simulations)
    rows = scenarios.scenario_rows(history, simulated, model_inputs(model))
    return scenarios.forecast_records(scenarios.summarise(ensemble.score(model, rows)))


def latest(combined: DataFrame) -> DataFrame:
    """Latest combined row of each series with published types; counts truncate to int."""
    return align.last_row(combined).select(
        "series_id",
        S.iso_date(F.col("date")).alias("date"),
        *[F.col(c).cast("double").alias(c) for c in ("price", "rate", "fx")],
        *[F.col(c).cast("int").alias(c) for c in ("trend_a", "trend_b")],
    )


def saved_metrics(spark: SparkSession, out: str) -> dict:
    """First record of the published summary, or a message if there is none."""
    run = sinks.published_run(spark, out)
    if run is None:
        return {"message": f"no finished run at {out}: train first"}
    return sinks.first_record(spark, sinks.run_folder(out, run), sinks.SUMMARY, SUMMARY_SCHEMA)


def published_model(spark: SparkSession, out: str) -> PipelineModel:
    """The model of the published run; a missing one is a clear error."""
    return load_model(spark, f"{sinks.published(spark, out)}/model")


def run_pipeline(
    spark: SparkSession,
    sources: Sources,
    out: str,
    seed: int,
    as_of: dt.date | None = None,
    years: folds.Years = folds.Years(),
    feature_set: str = "all",
    smote: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Combine, label, engineer, train, forecast, and publish the six output tables and the model.

    Returns the engineered frame and the forecast. The two frames everything else is derived
    from are written once and read back, so no later step repeats the source scans. The tables go to
    a folder of this run below ``out``, which readers see when all of them are there; finished folds
    are kept beside the runs, so a stopped run is taken up where it stopped.
    """
    as_of = as_of or dt.date.today()
    combined = combine_sources(spark, sources, as_of)
    # The last test year is the current one.
    years = dataclasses.replace(years, test_to=min(years.test_to, as_of.year))
    engineered = materialise(engineer(combined), "engineered")
    trained = train(engineered, years, feature_set, smote, resume=f"{out}/folds")
    predicted = forecast(trained.model, engineered, seed)

    run = sinks.new_run()
    root, out = out, sinks.run_folder(out, run)
    sinks.write_csv(combined.orderBy("series_id", "date"), out, sinks.COMBINED)
    sinks.write_csv(labels.add_target(combined).orderBy("series_id", "date"), out, sinks.WITH_TARGET)
    sinks.write_csv(engineered.orderBy("series_id", "date"), out, sinks.ENGINEERED)
    history = ensemble.history_report(trained.predictions)
    sinks.write_csv(history.orderBy("series_id", "date"), out, sinks.HISTORY)
    sinks.write_csv(predicted.orderBy("series_id", "date"), out, sinks.FORECAST)
    sinks.write_csv(trained.summary, out, sinks.SUMMARY)
    save_model(trained.model, f"{out}/model")
    names = [sinks.COMBINED, sinks.WITH_TARGET, sinks.ENGINEERED, sinks.HISTORY, sinks.FORECAST, sinks.SUMMARY, "model"]
    sinks.publish(spark, root, run, names)
    return engineered, predicted
