import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.functions import draws
from daymark.operators import features, scenarios


def history(spark, prices, series="s"):
    day = dt.date(2024, 1, 1)
    rows = [(series, day + dt.timedelta(days=i), float(p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "series_id string, date date, price double")


def test_return_stats_use_the_last_sixty_prices(spark):
    prices = 100 + np.random.default_rng(0).normal(size=80).cumsum()
    row = scenarios.return_stats(history(spark, prices)).first()
    returns = prices[-59:] / prices[-60:-1] - 1
    assert row.n_returns == 59
    assert row.mean_return == pytest.approx(returns.mean())
    assert row.std_return == pytest.approx(returns.std(ddof=1))
    assert row.last_price == prices[-1] and row.last_date == dt.date(2024, 3, 20)


def test_draws_are_normal_and_independent_of_partitioning(spark):
    keys = spark.range(20000)
    drawn = keys.select("id", draws.keyed_normal(F.col("id"), F.lit(7)).alias("z"))
    z = np.array([r.z for r in drawn.collect()])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    again = keys.repartition(13).select("id", draws.keyed_normal(F.col("id"), F.lit(7)).alias("z"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    other = keys.select(draws.keyed_normal(F.col("id"), F.lit(8)).alias("z"))
    assert abs(np.corrcoef(z, [r.z for r in other.collect()])[0, 1]) < 0.05


def test_paths_restart_every_day(spark):
    stats = scenarios.return_stats(history(spark, 100 + np.random.default_rng(1).normal(size=70).cumsum()))
    got = scenarios.paths(stats, seed=3).toPandas()
    assert len(got) == 70 and not got.duplicated(["day", "sim"]).any()
    row = stats.first()
    step = spark.range(1).select(draws.keyed_normal(F.lit("s"), F.lit(2), F.lit(4), F.lit(1), F.lit(3)).alias("a"),
                                 draws.keyed_normal(F.lit("s"), F.lit(2), F.lit(4), F.lit(2), F.lit(3)).alias("b")).first()
    want = row.last_price * np.prod([1 + row.mean_return + row.std_return * z for z in (step.a, step.b)])
    assert got[(got.day == 2) & (got.sim == 4)]["sim_price"].iloc[0] == pytest.approx(want)
    assert "Exchange" not in scenarios.paths(spark.createDataFrame(stats.collect(), stats.schema), 3)._jdf.queryExecution().executedPlan().toString()


def votes(spark, probabilities, prices):
    rows = [("s", 1, dt.date(2024, 1, 2), 100.0, float(x), float(p), int(p > 0.5)) for p, x in zip(probabilities, prices)]
    schema = "series_id string, day int, date date, last_price double, sim_price double, probability_up double, predicted int"
    return scenarios.summarise(spark.createDataFrame(rows, schema)).first()


def test_tied_vote_is_down_and_median_interpolates(spark):
    row = votes(spark, [0.9] * 5 + [0.4] * 5, range(95, 105))
    assert (row.vote, row.predicted_movement) == (0, "DOWN")
    assert row.confidence == pytest.approx(35.0) and row.confidence == row.prob_down
    assert row.prob_down + row.prob_up == pytest.approx(100)
    assert (row.estimated_price, row.price_change) == (99.5, -0.5)


def test_confidence_follows_the_vote_below_fifty(spark):
    row = votes(spark, [0.51] * 6 + [0.1] * 4, [100.0] * 10)
    assert row.predicted_movement == "UP" and row.confidence == row.prob_up < 50


def test_scenario_rows_share_all_but_the_price(spark):
    rng = np.random.default_rng(5)
    rows = [
        ("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), 100 + float(p), float(i), 1.0 + i, 1.0, 2.0)
        for i, p in enumerate(rng.normal(size=90).cumsum())
    ]
    schema = "series_id string, date date, price double, rate double, fx double, trend_a double, trend_b double"
    engineered = features.engineer(spark.createDataFrame(rows, schema))
    names = features.model_columns(engineered)
    simulated = scenarios.paths(scenarios.return_stats(engineered), 1)
    got = scenarios.scenario_rows(engineered, simulated, [*names, "unknown"]).toPandas()
    assert len(got) == 70
    constant = got[[c for c in names if c != "price"]].nunique()
    assert (constant == 1).all() and (got["unknown"] == 0).all()
    assert got["price_lag3"].iloc[0] == rows[-3][2] and got["rate"].iloc[0] == rows[-1][3]
    assert (got["price"] == got["sim_price"]).all()
