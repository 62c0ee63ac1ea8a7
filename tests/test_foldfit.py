"""Regressions of all folds in shared passes against one fit a fold, and against their conditions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.operators import ensemble, foldfit, folds

YEARS = folds.Years(2010, 2012, 2013, 2018)
COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1400):
        day = dt.date(2010, 1, 1) + dt.timedelta(days=2 * i)
        a, b = rng.normal(5000, 3), rng.normal()
        c = a + rng.normal() * 0.1
        up = int(rng.random() < 1 / (1 + np.exp(-((a - 5000) / 3 + 0.5 * b))))
        d = [7.0, float("nan"), float("inf")][i % 3] if i > 600 else 7.0
        rows.append(("s", day, day.year, up, float(a), float(b), float(c), d))
    frame = spark.createDataFrame(rows, "series_id string, date date, year int, target int, a double, b double, c double, d double")
    return ensemble.prepare(frame, COLUMNS, YEARS)


def test_coefficients_equal_single_fits(data):
    fitted = ensemble.fit_linear(data)
    assert sorted(fitted) == data.folds == [2013, 2014, 2015, 2016, 2017]
    for fold in data.folds:
        rows, n, _ = ensemble.fold_rows(data, fold)
        alone = ensemble.logistic(n, tol=1e-12).fit(rows)
        assert np.abs(fitted[fold].coefficients - alone.coefficients.toArray()).max() < 1e-4
        assert abs(fitted[fold].intercept - alone.intercept) < 1e-4
        assert fitted[fold].violation < 1e-7
    assert max(foldfit.violations(data, fitted).values()) < 1e-7


def test_passes_do_not_grow_with_the_folds(data, monkeypatch):
    passes = []
    real = foldfit._pass
    monkeypatch.setattr(foldfit, "_pass", lambda *a: passes.append(len(a[1])) or real(*a))
    one = foldfit.fit_folds(data, [data.folds[-1]], ensemble.C, ensemble.L1_RATIO)
    alone = len(passes)
    passes.clear()
    every = ensemble.fit_linear(data)
    assert len(passes) <= alone + 4 and passes[0] == len(data.folds)
    assert np.abs(one[data.folds[-1]].coefficients - every[data.folds[-1]].coefficients).max() < 1e-6


def test_stage_gives_the_probability(data):
    fold = data.folds[-1]
    linear = ensemble.fit_linear(data, [fold])
    model = ensemble.fit_fold(data, fold, ["lr"], linear=linear)
    rows, n, _ = ensemble.fold_rows(data, fold)
    alone = ensemble.logistic(n, tol=1e-12).fit(rows)
    test = data.frame.filter(F.col("year") == fold)
    scored = ensemble.score(model, test, ["lr"]).select("date", "p_lr", "probability_up", "z_a").toPandas().sort_values("date")
    assert (scored["p_lr"] == scored["probability_up"]).all() and scored["p_lr"].between(0, 1).all()
    _, _, stages = ensemble.fold_rows(data, fold)
    other = alone.transform(stages.transform(test)).toPandas().sort_values("date")
    assert np.allclose(scored["p_lr"], [v[1] for v in other["prob_lr"]], atol=1e-5)


def test_vote_of_some_members(spark):
    row = spark.createDataFrame([(0.9, 0.3)], "lr double, rf double")
    vote = ensemble.vote_of({"lr": F.col("lr"), "rf": F.col("rf")})
    assert row.select(vote.alias("v")).first().v == pytest.approx((2 * 0.9 + 0.3) / 3)


def test_year_moments(data):
    rows = data.frame.toPandas()
    got = {(r["year"], r["feature"]): r for r in folds.year_moments(data.frame, COLUMNS).collect()}
    for year, group in rows.groupby("year"):
        for c in COLUMNS:
            v = group[c].where(np.isfinite(group[c]), 0.0)
            r = got[year, c]
            assert (r["n"], r["lo"], r["hi"]) == (len(v), pytest.approx(v.min()), pytest.approx(v.max()))
            assert (r["lo"] == r["hi"]) == (v.min() == v.max())
            assert r["mean"] == pytest.approx(v.mean()) and r["m2"] == pytest.approx(((v - v.mean()) ** 2).sum())
