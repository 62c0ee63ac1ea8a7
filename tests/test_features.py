import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daymark.operators import blocked, features, folds, labels

SCHEMA = "series_id string, date date, price double, rate double, fx double, trend_a double, trend_b double"


def frame(spark, price, seed=3, series="s"):
    rng = np.random.default_rng(seed)
    day = dt.date(2020, 1, 1)
    rows = [
        (series, day + dt.timedelta(days=i), float(p), float(rng.normal()), float(rng.uniform(1, 2)), 1.0, float(i))
        for i, p in enumerate(price)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def walk(n, seed=0):
    return 100 + np.random.default_rng(seed).normal(size=n).cumsum()


def expected(pdf):
    """The definitions, spelled out with rolling pandas windows."""
    out = pd.DataFrame({"date": pdf["date"]})
    for c in ("price", "rate", "fx"):
        for k in (3, 6, 12, 20):
            out[f"{c}_lag{k}"] = pdf[c].shift(k)
    past = pdf["price"].shift(3)
    for n in (6, 12, 20):
        out[f"momentum_{n}"] = past - pdf["price"].shift(n)
        out[f"ma{n}_lag3"] = past.rolling(n).mean()
        out[f"std{n}_lag3"] = past.rolling(n).std()
    out["roc_lag3"] = past / past.shift(1) - 1
    out["rate_change_lag3"] = pdf["rate"].shift(3) - pdf["rate"].shift(4)
    out["fx_change_lag3"] = pdf["fx"].shift(3) / pdf["fx"].shift(4) - 1
    out["price_trend_12"] = past.rolling(12).apply(lambda x: float(x[-1] > x[0]), raw=True)
    out["volatility_20"] = past.rolling(20).std() / past.rolling(20).mean()
    return out.dropna().reset_index(drop=True)


def test_all_features_against_pandas(spark):
    source = frame(spark, walk(90))
    got = features.engineer(source).orderBy("date").toPandas()
    want = expected(source.toPandas())
    assert len(got) == 90 - 22
    assert sorted(c for c in got.columns if c not in SCHEMA) == sorted(c for c in want.columns if c != "date")
    for c in want.columns.drop("date"):
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-9), c


def test_one_exchange_and_one_window(spark):
    plan = features.engineer(labels.add_target(frame(spark, walk(5))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


@pytest.mark.parametrize("rows, left", [(22, 0), (23, 1)])
def test_short_series(spark, rows, left):
    assert features.engineer(frame(spark, walk(rows))).count() == left


def test_zero_prices_keep_infinity_and_drop_undefined(spark):
    price = walk(60)
    price[30:32] = 0.0
    got = features.engineer(frame(spark, price)).toPandas().set_index("date")["roc_lag3"]
    day = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    assert day[34] not in got.index  # 0/0
    assert got[day[33]] == -1.0  # 0/x
    assert got[day[35]] == np.inf  # x/0 stays


def test_null_inside_a_window_empties_it(spark):
    price = walk(60)
    source = frame(spark, price).replace(float(price[30]), None, subset=["price"])
    got = features.add_features(source, features.series_window(), [features.moving_averages]).orderBy("date").toPandas()
    assert got["ma6_lag3"][33:39].isna().all()
    assert got["ma6_lag3"][39:].notna().all()


def test_lagged_features_ignore_the_last_three_days(spark):
    price = walk(60)
    changed = price.copy()
    changed[-3:] += 50.0
    names = features.model_columns(features.engineer(frame(spark, price)), "lagged_only")
    assert len(names) == 26
    a, b = (
        features.engineer(frame(spark, p)).orderBy("date").select(*names).toPandas().iloc[-1] for p in (price, changed)
    )
    assert np.array_equal(a.to_numpy(), b.to_numpy())


def test_model_columns(spark):
    full = folds.with_year(features.engineer(labels.add_target(frame(spark, walk(30)))))
    assert len(features.model_columns(full)) == 31
    with pytest.raises(ValueError):
        features.model_columns(full, "other")


def events(spark, n=400):
    """One series with most of the rows, bursts within a minute, long gaps, and equal times."""
    rng = np.random.default_rng(9)
    gaps = rng.choice([0, 1, 5, 40, 4000, 200_000], size=n, p=[0.1, 0.4, 0.2, 0.2, 0.08, 0.02])
    start, seconds = dt.datetime(2024, 1, 1), np.cumsum(gaps)
    rows = []
    for i in range(n):
        value = None if rng.random() < 0.3 or i < 5 else float(np.round(rng.normal(50, 10), 2))
        rows.append(("hot" if rng.random() < 0.8 else "cold", start + dt.timedelta(seconds=int(seconds[i])), i, value))
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, event_id bigint, price double")


def as_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("block_rows", [22, 64, 4096])
def test_blocked_windows_equal_plain_windows(spark, block_rows):
    source = events(spark).fillna(1.5)

    def apply(df, w):
        return features.add_features(df, w, features.PRICE_FEATURES)

    from pyspark.sql import Window

    plain = apply(source, Window.partitionBy("series_id").orderBy("ts", "event_id"))
    cut = blocked.blocked_window(
        source, ["series_id"], "ts", apply, features.HALO, ["event_id"], block_rows=block_rows
    )
    assert as_rows(cut.select(*plain.columns)) == as_rows(plain)


def test_blocks_must_hold_the_halo(spark):
    with pytest.raises(ValueError):
        blocked.blocked_window(events(spark, 10), ["series_id"], "ts", lambda d, w: d, 22, block_rows=21)


def test_one_crowded_instant_is_split(spark):
    """All rows of a series at one time: ties still spread it over partitions."""
    rows = [("hot", dt.datetime(2024, 1, 1), i, float(i)) for i in range(4000)]
    source = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, event_id bigint, price double")
    # Adaptive execution would put so few rows back together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = blocked.Pieces(source, ["series_id"], "ts", ["event_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces.reduced.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = blocked.global_positions(source, ["series_id"], "ts", ["event_id"])
    assert all(r.position == r.event_id for r in placed.collect())
    shifted = blocked.blocked_fill(
        source.withColumn("price", F.when(F.col("event_id") == 7, F.col("price"))), ["series_id"], "ts", ["price"], ["event_id"]
    )
    assert {r.price for r in shifted.collect()} == {7.0}


@pytest.mark.parametrize("row", [(None, dt.datetime(2024, 1, 1), 9, 1.0), ("hot", None, 9, 1.0)])
def test_rows_without_a_place_are_an_error(spark, row):
    source = events(spark, 20).union(spark.createDataFrame([row], events(spark, 1).schema))
    with pytest.raises(ValueError, match="no place"):
        blocked.global_positions(source, ["series_id"], "ts", ["event_id"])
    with pytest.raises(ValueError, match="no place"):
        blocked.blocked_fill(source, ["series_id"], "ts", ["price"], ["event_id"])


@pytest.mark.parametrize("backward", [True, False])
def test_blocked_fill_equals_pandas(spark, backward):
    source = events(spark)
    got = blocked.blocked_fill(source, ["series_id"], "ts", ["price"], ["event_id"], backward=backward)
    got = got.toPandas().sort_values("event_id")["price"].tolist()
    pdf = source.toPandas().sort_values(["ts", "event_id"])
    filled = pdf.groupby("series_id")["price"].ffill()
    if backward:
        filled = filled.groupby(pdf["series_id"]).bfill()
    want = pdf.assign(price=filled).sort_values("event_id")["price"].tolist()
    assert np.array_equal(np.array(got, float), np.array(want, float), equal_nan=True)


def test_blocked_labels_equal_plain_labels(spark):
    source = events(spark).fillna(1.5)
    cut = blocked.blocked_window(source, ["series_id"], "ts", labels.label_over, 1, ["event_id"], block_rows=7)
    pdf = source.toPandas().sort_values(["ts", "event_id"])
    change = pdf.groupby("series_id")["price"].diff()
    want = dict(zip(pdf["event_id"], np.select([change > 0, change < 0], [2, 1], 0)))
    assert {r.event_id: r.target for r in cut.collect()} == want
