import datetime as dt

import numpy as np
import pytest

from daymark.operators import folds

YEARS = folds.Years(2000, 2001, 2002, 2004)
COLUMNS = ["a", "b", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = []
    for year in (1999, 2000, 2001, 2002, 2004, 2005):
        for i in range(40):
            # A large offset with a small spread would cancel in a difference of squares.
            value = 1e9 + rng.normal() if i else float("inf")
            flat = 3.0 if year <= 2002 else float(i)
            data.append((dt.date(year, 1, 1) + dt.timedelta(days=i), year, int(rng.random() < 0.3), value, rng.normal(), flat))
    return spark.createDataFrame(data, "date date, year int, target int, a double, b double, flat double").cache()


def train_of(pdf, fold):
    year = pdf["year"]
    return pdf[year.between(2000, 2001) | ((year >= 2002) & (year < fold) & (year <= 2004))]


def test_folds_skip_years_without_rows_and_rows_outside(rows):
    assert folds.fold_list(rows, YEARS) == [2002, 2004]
    parts = {r.year: r.part for r in folds.split_rows(rows, YEARS).collect()}
    assert parts == {2000: "train", 2001: "train", 2002: "test", 2004: "test"}


def test_no_test_year_is_an_error(rows):
    with pytest.raises(ValueError, match="test years"):
        folds.fold_list(rows, folds.Years(2000, 2001, 2010, 2011))


def test_membership_is_disjoint_and_grows(rows):
    got = folds.membership(rows, [2002, 2004], YEARS).toPandas()
    tests = got[got.role == "test"]
    assert not tests.duplicated("date").any()
    train = {f: set(g["date"]) for f, g in got[got.role == "train"].groupby("fold_year")}
    assert train[2002] < train[2004]
    pdf = rows.toPandas()
    for fold, dates in train.items():
        assert dates == set(train_of(pdf, fold)["date"])
        assert set(folds.expanding_train(rows, YEARS, fold).toPandas()["date"]) == dates
        assert set(rows.filter(folds.train_filter(YEARS, fold)).toPandas()["date"]) == dates


def test_class_weights_sum_to_rows(rows):
    pdf = rows.toPandas()
    for r in folds.class_weights(rows, [2002, 2004], YEARS).collect():
        want = train_of(pdf, r.fold_year)["target"]
        assert (r.n_train, r.n_up) == (len(want), want.sum())
        assert r.weight_up * r.n_up + r.weight_down * r.n_down == pytest.approx(r.n_train)


def test_scaler_matches_numpy(rows):
    pdf = rows.toPandas()
    pdf["a"] = pdf["a"].replace(np.inf, 0.0)
    for r in folds.scaler_stats(rows, COLUMNS, [2002, 2004], YEARS).collect():
        values = train_of(pdf, r.fold_year)[r.feature].to_numpy()
        constant = values.min() == values.max()
        assert r["mean"] == pytest.approx(values.mean(), rel=1e-12)
        assert r["scale"] == pytest.approx(1.0 if constant else values.std(), rel=1e-9)
        assert (r.feature == "flat" and r.fold_year == 2002) <= constant


def test_scaler_does_not_cancel(spark):
    data = [(dt.date(2000 + i % 2, 1, 1), 2000 + i % 2, 0, 1e9 + i % 5) for i in range(100)] + [(dt.date(2002, 1, 1), 2002, 1, 0.0)]
    frame = spark.createDataFrame(data, "date date, year int, target int, a double")
    row = folds.scaler_stats(frame, ["a"], [2002], YEARS).first()
    assert row["scale"] == pytest.approx(np.std([1e9 + i % 5 for i in range(100)]), rel=1e-9)


def test_constant_training_column_shifts_only(rows):
    got = folds.standardised_test_rows(rows, COLUMNS, [2002, 2004], YEARS).toPandas()
    assert (got[got.year == 2002]["flat"] == 0).all()
    flat = got[got.year == 2004].sort_values("date")["flat"].to_numpy()
    assert np.allclose(flat, np.arange(40) - 3.0)
