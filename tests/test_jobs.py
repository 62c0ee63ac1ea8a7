"""Model fits and the whole job, on landed files of a small hand-made market."""

import csv
import dataclasses
import datetime as dt
import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from daymark.operators import ensemble, features, folds, labels
from daymark.plans import jobs
from daymark.sources import sinks

START, DAYS = dt.date(2019, 1, 1), 1000
YEARS = folds.Years(2019, 2019, 2020, 2021)
AS_OF = START + dt.timedelta(days=DAYS)


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    rng = np.random.default_rng(11)
    price = 1000 + rng.normal(size=DAYS).cumsum()
    price[100] = price[99]  # one day without a change
    days = [START + dt.timedelta(days=i) for i in range(DAYS)]
    order = rng.permutation(DAYS)
    with open(folder / "price.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["Date", "Open", "Close"])
        out.writerow(["1930-01-01", 1, 1])
        out.writerows([days[i], 0, round(float(price[i]), 4)] for i in order)
    with open(folder / "fx.csv", "w", newline="") as f:
        out = csv.writer(f, delimiter=";")
        out.writerow(["Date", "Close"])
        out.writerows([days[i], round(70 + float(rng.random()), 4)] for i in range(30, DAYS))
    rates = [{"date": str(d), "value": "." if d.weekday() > 4 else f"{2 + rng.random():.2f}"} for d in days]
    (folder / "rate.json").write_text(json.dumps({"observations": rates}))
    weeks = [
        {"timestamp": str(int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp())),
         "values": [{"extracted_value": int(rng.integers(0, 100))}, {"extracted_value": int(rng.integers(0, 100))}]}
        for d in days[500::7]
    ]
    (folder / "trend.json").write_text(json.dumps({"interest_over_time": {"timeline_data": weeks}}))
    return jobs.Sources(*(str(folder / n) for n in ("price.csv", "rate.json", "fx.csv", "trend.json")))


@pytest.fixture(scope="module")
def outcome(spark, sources, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    engineered, forecast = jobs.run_pipeline(spark, sources, out, seed=5, as_of=AS_OF, years=YEARS)
    return out, engineered, forecast


def saved(spark, out, name):
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{sinks.published(spark, out)}/{name}")


def test_combined_has_no_gap_and_no_old_row(spark, outcome):
    frame = saved(spark, outcome[0], sinks.COMBINED)
    assert frame.count() == DAYS
    assert frame.select([F.count_if(F.col(c).isNull()).alias(c) for c in frame.columns]).first().asDict() == dict.fromkeys(
        frame.columns, 0
    )
    assert frame.select("trend_a").filter("date < '2020-05-15'").distinct().count() == 1  # copied back


def test_every_table_is_written(spark, outcome):
    out, engineered, _ = outcome
    assert saved(spark, out, sinks.WITH_TARGET).filter("target = 0").count() == 2
    assert saved(spark, out, sinks.ENGINEERED).count() == engineered.count() == DAYS - 22
    history = saved(spark, out, sinks.HISTORY).toPandas()
    assert set(history["year"]) == {2020, 2021} and not history.duplicated("date").any()
    assert ((history["predicted"] == 1) == (history["probability_up"] > 0.5)).all()
    summary = jobs.saved_metrics(spark, out)
    assert summary["model"] == jobs.MODEL_NAME and summary["training_period"] == "2019-2019"
    assert summary["test_samples"] == len(history) and summary["features_used"] == 31
    assert summary["accuracy"] == pytest.approx(history["correct"].mean())
    assert summary["accuracy"] > 0.5 and summary["roc_auc"] > 0.5


def test_forecast_invariants(outcome):
    rows = outcome[2].orderBy("date").collect()
    assert outcome[2].columns[1:] == [
        "date", "day", "predicted_movement", "confidence", "prob_down", "prob_up", "estimated_price", "price_change",
    ]
    assert [r.day for r in rows] == [f"Day +{i}" for i in range(1, 8)]
    assert [(r.date - rows[0].date).days for r in rows] == list(range(7))
    assert len({round(r.estimated_price - r.price_change, 6) for r in rows}) == 1
    for r in rows:
        assert r.prob_down + r.prob_up == pytest.approx(100)
        assert r.confidence == (r.prob_up if r.predicted_movement == "UP" else r.prob_down)


def test_forecast_repeats_from_the_saved_model(spark, outcome):
    out, engineered, forecast = outcome
    model = jobs.published_model(spark, out)
    assert jobs.model_inputs(model) == features.model_columns(engineered)
    again = jobs.forecast(model, engineered, seed=5)
    assert sorted(map(str, again.collect())) == sorted(map(str, forecast.collect()))


def test_several_series_share_the_side_series(spark, sources, tmp_path):
    with open(sources.price_csv) as f:
        header, *lines = f.read().splitlines()
    path = tmp_path / "two.csv"
    path.write_text("\n".join([f"Metal,{header}", *(f"{m},{line}" for m in ("a", "b") for line in lines)]) + "\n")
    keyed = dataclasses.replace(sources, price_csv=str(path), series_column="Metal")
    both = jobs.combine_sources(spark, keyed, AS_OF)
    one = jobs.combine_sources(spark, sources, AS_OF).drop("series_id")
    want = sorted(map(str, one.collect()))
    for name in ("a", "b"):
        assert sorted(map(str, both.filter(F.col("series_id") == name).drop("series_id").collect())) == want


def test_duplicate_price_dates_are_an_error(spark, sources, tmp_path):
    with open(sources.price_csv) as f:
        text = f.read()
    path = tmp_path / "twice.csv"
    path.write_text(text + text.splitlines()[-1] + "\n")
    with pytest.raises(ValueError, match="duplicate"):
        jobs.combine_sources(spark, dataclasses.replace(sources, price_csv=str(path)), AS_OF)


def test_empty_sources_are_errors(spark, sources, tmp_path):
    for name, header, what in (("price_csv", "Date,Open,Close", "price"), ("fx_csv", "Date;Close", "exchange-rate")):
        path = tmp_path / f"{name}.csv"
        path.write_text(header + "\n")
        with pytest.raises(ValueError, match=f"{what} series has no rows"):
            jobs.combine_sources(spark, dataclasses.replace(sources, **{name: str(path)}), AS_OF)
    path = tmp_path / "dots.json"
    path.write_text(json.dumps({"observations": [{"date": "2020-01-01", "value": "."}]}))
    with pytest.raises(ValueError, match="no value in column.s. rate of series price"):
        jobs.combine_sources(spark, dataclasses.replace(sources, rate_json=str(path)), AS_OF)


def test_checks_ride_on_the_write(spark, sources, monkeypatch):
    """One job for data and checks: no frame is collected, counted or asked whether it is empty."""
    frame = type(spark.range(1))

    def never(*_, **__):
        raise AssertionError("a job of its own")

    for name in ("collect", "count", "isEmpty", "first", "take", "toPandas"):
        monkeypatch.setattr(frame, name, never)
    monkeypatch.setattr("daymark.sources.files._headers", lambda *_: {})
    combined = jobs.combine_sources(spark, sources, AS_OF)
    monkeypatch.undo()
    assert combined.count() == DAYS


def test_a_stopped_run_leaves_the_earlier_result(spark, outcome, sources, monkeypatch):
    out = outcome[0]
    before, run = jobs.saved_metrics(spark, out), sinks.published_run(spark, out)
    real = sinks.write_csv

    def stop(df, folder, name):
        if name == sinks.FORECAST:
            raise InterruptedError
        return real(df, folder, name)

    monkeypatch.setattr(sinks, "write_csv", stop)
    with pytest.raises(InterruptedError):
        jobs.run_pipeline(spark, sources, out, seed=6, as_of=AS_OF, years=YEARS)
    monkeypatch.undo()
    assert sinks.published_run(spark, out) == run and jobs.saved_metrics(spark, out) == before
    assert saved(spark, out, sinks.FORECAST).count() == 7
    # The next run takes the finished folds, publishes, and is what readers see.
    monkeypatch.setattr(ensemble, "fit_fold", lambda *_, **__: pytest.fail("a fold was fitted again"))
    jobs.run_pipeline(spark, sources, out, seed=6, as_of=AS_OF, years=YEARS)
    assert sinks.published_run(spark, out) > run
    after = jobs.saved_metrics(spark, out)
    assert {k: v for k, v in after.items() if k != "timestamp"} == {k: v for k, v in before.items() if k != "timestamp"}


def test_nothing_published_yet(spark, tmp_path):
    assert "no finished run" in jobs.saved_metrics(spark, str(tmp_path))["message"]
    with pytest.raises(FileNotFoundError, match="no finished run"):
        jobs.published_model(spark, str(tmp_path))


def test_training_is_taken_up_where_it_stopped(spark, outcome, tmp_path, monkeypatch):
    rows = labels.binary_target(outcome[1])
    years = folds.Years(2019, 2019, 2020, 2021)
    columns = features.model_columns(rows, "lagged_only")[:4]
    rows = rows.withColumn("year", F.col("year") + F.when(F.month("date") > 6, 1).otherwise(0))
    data = ensemble.prepare(rows, columns, folds.Years(2019, 2019, 2020, 2022))
    assert len(data.folds) == 3
    real, fitted = ensemble.fit_fold, []

    def stops(data, fold, *rest, **named):
        if len(fitted) == 2:
            raise InterruptedError
        fitted.append(fold)
        return real(data, fold, *rest, **named)

    monkeypatch.setattr(ensemble, "fit_fold", stops)
    with pytest.raises(InterruptedError):
        ensemble.walk_forward(data, ["lr"], concurrent_folds=1, resume=str(tmp_path))
    assert fitted == data.folds[:2]
    again = []
    monkeypatch.setattr(ensemble, "fit_fold", lambda d, f, *r, **n: again.append(f) or real(d, f, *r, **n))
    whole = ensemble.walk_forward(data, ["lr"], concurrent_folds=1, resume=str(tmp_path))
    assert again == data.folds[2:]
    fresh = ensemble.walk_forward(data, ["lr"])
    close = whole.predictions.join(fresh.predictions.withColumnRenamed("p_lr", "p"), ["series_id", "date"])
    assert close.count() == fresh.predictions.count() == whole.predictions.count()
    assert close.filter(F.abs(F.col("p") - F.col("p_lr")) > 1e-6).isEmpty()
    # Everything is there: the model is read. Another setting, or a changed row, is another training.
    again.clear()
    assert len(ensemble.walk_forward(data, ["lr"], resume=str(tmp_path)).model.stages) == 3 and not again
    changed = ensemble.prepare(rows.withColumn(columns[0], F.when(F.col("date") == "2020-08-03", 0.0).otherwise(F.col(columns[0]))), columns, data.years)
    ensemble.walk_forward(changed, ["lr"], concurrent_folds=1, resume=str(tmp_path))
    assert again == [f for f in data.folds if f >= 2021]


def test_latest_row(spark, outcome):
    combined = saved(spark, outcome[0], sinks.COMBINED).withColumn("date", F.col("date").cast("date"))
    row = jobs.latest(combined).first()
    assert row.date == str(START + dt.timedelta(days=DAYS - 1))
    assert isinstance(row.trend_a, int) and isinstance(row.price, float)


def test_missing_model_is_a_clear_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="train first"):
        jobs.load_model(spark, str(tmp_path / "none"))


def test_lagged_only_training_with_oversampling(spark, outcome):
    engineered = outcome[1].filter("target <> 1 or day(date) < 12")  # make DOWN the minority
    trained = jobs.train(engineered, folds.Years(2019, 2020, 2021, 2021), "lagged_only", smote=True, members=["lr"])
    assert len(trained.columns) == 26 and "price" not in trained.columns
    assert trained.predictions.columns[-1] == "p_lr"
    details = trained.details.first()
    assert details.training_samples == engineered.filter("year <= 2020").count()
    assert details.tn + details.fp + details.fn + details.tp == details.test_samples
    assert trained.summary.first().test_samples == labels.binary_target(engineered).filter("year = 2021").count()


def solve(x, y, weight, n, steps=60_000):
    """Accelerated proximal gradient on  C sum(w loss) + l1_ratio |b|_1 + (1 - l1_ratio)/2 |b|^2."""
    c, l1 = ensemble.C, ensemble.L1_RATIO
    design = np.hstack([x, np.ones((n, 1))])
    step = 1.0 / (0.25 * c * np.linalg.norm(design * np.sqrt(weight)[:, None], 2) ** 2 + (1 - l1))
    beta = momentum = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ momentum))
        gradient = c * design.T @ (weight * (p - y))
        gradient[:-1] += (1 - l1) * momentum[:-1]
        new = momentum - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = new + (t - 1) / t_new * (new - beta)
        if np.abs(new - beta).max() < 1e-12:
            break
        beta, t = new, t_new
    return new


def test_logistic_solves_the_elastic_net(spark):
    rng = np.random.default_rng(8)
    n = 300
    x = rng.normal(size=(n, 5))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] - 0.8)))).astype(int)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    rows = [(Vectors.dense(a), int(b), float(w)) for a, b, w in zip(x.tolist(), y, weight)]
    model = ensemble.logistic(n, tol=1e-10).fit(spark.createDataFrame(rows, ["features", "target", "weight"]))
    want = solve(x, y, weight, n)
    assert np.allclose(model.coefficients.toArray(), want[:-1], atol=2e-5)
    assert model.intercept == pytest.approx(want[-1], abs=2e-5)


def test_tree_settings():
    gbm, rf = ensemble.boosted_trees(31), ensemble.random_forest(31)
    assert (gbm.getFeatureSubsetStrategy(), rf.getFeatureSubsetStrategy()) == ("5", "5")
    assert (gbm.getMaxIter(), gbm.getStepSize(), gbm.getMaxDepth(), gbm.getSubsamplingRate()) == (100, 0.02, 3, 0.6)
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getMinInstancesPerNode(), rf.getWeightCol()) == (80, 4, 15, "weight")


def test_fold_rows_are_read_without_a_shuffle_in_several_tasks(spark, outcome):
    engineered = outcome[1]
    rows = labels.binary_target(engineered)
    data = ensemble.prepare(rows, features.model_columns(rows, "all"), YEARS)
    frame, n, _ = ensemble.fold_rows(data, 2021, task_bytes=n_bytes(data, 2021) // 3)
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert frame.rdd.getNumPartitions() > 1 and frame.count() == n
    model = ensemble.fit_fold(data, 2021, task_bytes=n_bytes(data, 2021) // 3)
    assert len(model.stages) == 5


def n_bytes(data, fold):
    return data.weights[fold].n_train * 8 * (len(data.columns) + 2)


def test_a_fold_of_one_class_is_an_error(outcome):
    rows = labels.binary_target(outcome[1]).filter("year > 2019 or target = 1")
    with pytest.raises(ValueError, match="one class"):
        ensemble.prepare(rows, features.model_columns(rows, "all"), YEARS)


def test_oversampling_fits_on_a_bounded_share(outcome):
    rows = labels.binary_target(outcome[1])
    data = ensemble.prepare(rows, features.model_columns(rows, "all"), YEARS)
    share, weights = ensemble.bounded(data.frame.filter("year < 2021"), data.weights[2021], 100)
    assert share.count() == weights.n_train == weights.n_up + weights.n_down
    assert 50 < weights.n_train < 160


def test_a_forecast_needs_all_members(outcome):
    rows = labels.binary_target(outcome[1])
    data = ensemble.prepare(rows, features.model_columns(rows, "all"), YEARS)
    with pytest.raises(ValueError, match="all members"):
        jobs.forecast(ensemble.fit_fold(data, 2020, ["lr"]), outcome[1], seed=1)


def test_the_last_test_year_is_the_current_one(spark, sources, tmp_path, monkeypatch):
    seen = {}

    def stop(engineered, years, *rest, **named):
        seen["years"] = years
        raise InterruptedError

    monkeypatch.setattr(jobs, "train", stop)
    with pytest.raises(InterruptedError):
        jobs.run_pipeline(spark, sources, str(tmp_path), seed=1, as_of=AS_OF)
    assert seen["years"].test_to == AS_OF.year
