import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daymark.operators import align
from daymark.operators import labels

D = dt.date
T = dt.datetime


def daily(values, start=D(2024, 1, 1), series="s"):
    return [(series, start + dt.timedelta(days=i), v) for i, v in enumerate(values)]


def values_of(frame, column):
    return [r[column] for r in frame.orderBy("date").collect()]


def test_lookback_clips_leap_day(spark):
    frame = spark.createDataFrame([(D(1954, 2, 27),), (D(1954, 2, 28),), (D(2024, 2, 29),)], "date date")
    assert sorted(r.date for r in align.lookback(frame, 70).collect()) == [D(1954, 2, 28), D(2024, 2, 29)]


def test_lookback_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(D(2024, 1, 1), 1)], "date date, v int").write.parquet(str(tmp_path / "p"))
    plan = align.lookback(spark.read.parquet(str(tmp_path / "p")), 3, as_of=D(2024, 1, 1))
    assert "GreaterThanOrEqual(date,2021-01-01)" in plan._jdf.queryExecution().executedPlan().toString()


def test_upsample_against_pandas(spark):
    stamps = [T(2024, 1, 1), T(2024, 1, 8), T(2024, 1, 8, 12), T(2024, 1, 29)]
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(stamps)], "date timestamp_ntz, v int")
    want = pd.DataFrame({"v": range(4)}, index=pd.DatetimeIndex(stamps)).resample("D").ffill()
    got = align.upsample_daily(frame, ["v"]).orderBy("date").collect()
    assert [(r.date, r.v) for r in got] == [(t.date(), v) for t, v in want["v"].items()]


def test_upsample_first_point_after_midnight_leaves_its_day_null(spark):
    frame = spark.createDataFrame([(T(2024, 1, 1, 6), 5), (T(2024, 1, 3), 7)], "date timestamp_ntz, v int")
    got = {r.date: r.v for r in align.upsample_daily(frame, ["v"]).collect()}
    assert got == {D(2024, 1, 1): None, D(2024, 1, 2): 5, D(2024, 1, 3): 7}


def test_upsample_keeps_series_apart(spark):
    rows = [("a", D(2024, 1, 1), 1), ("a", D(2024, 1, 4), 2), ("b", D(2024, 1, 2), 3)]
    frame = spark.createDataFrame(rows, "k string, date date, v int")
    got = align.upsample_daily(frame, ["v"], keys=["k"])
    assert {(r.k, r.date.day, r.v) for r in got.collect()} == {("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 2, 3)}


def test_fill_is_forward_then_backward_and_idempotent(spark):
    rng = np.random.default_rng(1)
    raw = [None if rng.random() < 0.6 else float(i) for i in range(60)]
    raw[:4] = [None] * 4
    frame = spark.createDataFrame(daily(raw), "series_id string, date date, v double")
    once = align.fill_gaps(frame, ["v"])
    want = pd.Series([np.nan if v is None else v for v in raw]).ffill().bfill().tolist()
    assert values_of(once, "v") == want
    assert values_of(align.fill_gaps(once, ["v"]), "v") == want
    assert values_of(align.fill_gaps(frame, ["v"], backward=False), "v")[0] is None


def test_duplicate_dates(spark):
    frame = spark.createDataFrame(
        [("s", D(2024, 1, 1), 1.0, 1), ("s", D(2024, 1, 1), 2.0, 2)], "series_id string, date date, price double, load int"
    )
    with pytest.raises(ValueError, match="duplicate"):
        align.check_unique(frame)
    kept = align.check_unique(align.latest_load(frame, "load"))
    assert [r.price for r in kept.collect()] == [2.0]


def test_column_without_values_is_an_error(spark):
    frame = spark.createDataFrame(daily([None, None]), "series_id string, date date, rate double")
    with pytest.raises(ValueError, match="rate"):
        align.check_has_values(frame, ["rate"])


def test_duplicate_right_keys_multiply_rows(spark):
    spine = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 2),)], "date date")
    side = spark.createDataFrame([(D(2024, 1, 1), 1), (D(2024, 1, 1), 2)], "date date, v int")
    assert align.left_align(spine, side).count() == 3


def test_recent_last_and_future_rows(spark):
    frame = spark.createDataFrame(daily([1.0, 2.0, 3.0]), "series_id string, date date, price double")
    assert values_of(align.recent_rows(frame, 2), "price") == [2.0, 3.0]
    assert align.last_row(frame).first().price == 3.0
    from pyspark.sql import functions as F

    grown = align.append_future_row(frame, 2, {"price": F.lit(9.0)})
    assert values_of(grown, "price") == [1.0, 2.0, 3.0, 9.0]
    assert values_of(grown, "date")[-1] == D(2024, 1, 5)


def test_labels(spark):
    frame = spark.createDataFrame(daily([5.0, 6.0, 6.0, 4.0]), "series_id string, date date, price double")
    labelled = labels.add_target(frame)
    assert values_of(labelled, "target") == [0, 2, 0, 1]
    assert labelled.columns == ["series_id", "date", "price", "target"]
    assert values_of(labels.binary_target(labelled), "target") == [1, 0]
    counts = labels.target_counts(labelled).first()
    assert (counts.n_no_change, counts.n_decrease, counts.n_increase, counts.n_classes) == (2, 1, 1, 3)


def test_own_latest_date_is_a_plain_value_for_the_scan(spark, tmp_path):
    """No function around the subquery, which would keep it from pruning row groups."""
    spark.createDataFrame([(D(2024, 1, 1),), (D(2019, 1, 1),)], "date date").write.parquet(str(tmp_path / "d"))
    kept = align.lookback(spark.read.parquet(str(tmp_path / "d")), 3)
    assert [r.date for r in kept.collect()] == [D(2024, 1, 1)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,ScalarSubquery#" in plan


def test_a_series_without_values_is_named(spark):
    rows = [("a", 1.0), ("a", None), ("b", None)]
    frame = spark.createDataFrame(rows, "series_id string, rate double")
    with pytest.raises(ValueError, match="rate of series b"):
        align.check_has_values(frame, ["rate"])
