"""Updated feature tables against a full recompute, and how little of them an update touches."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from daymark.operators import align, blocked, features, labels
from daymark.operators.incremental import FeatureStore

SCHEMA = "series_id string, date date, price double, rate double, fx double"
START = dt.date(2015, 1, 1)


def market(seed=1, days=900):
    rng = random.Random(seed)
    rows = {}
    for key, step in (("a", 1), ("b", 1), ("c", 40)):
        for i in range(0, days, step):
            day = START + dt.timedelta(days=i)
            rate = None if i < 70 or rng.random() < 0.4 or 300 < i < 400 else rng.uniform(1, 5)
            rows[key, day] = (key, day, rng.uniform(50, 60), rate, rng.uniform(1, 2) if rng.random() < 0.7 else None)
    return rows


def build(df, w):
    return features.add_features(labels.label_over(df, w), w)


def whole(spark, rows):
    df = spark.createDataFrame(list(rows.values()), SCHEMA)
    filled = align.fill_gaps(df, ["rate", "fx"])
    return build(filled, Window.partitionBy("series_id").orderBy("date"))


def same(one, other):
    names = sorted(one.columns)
    assert names == sorted(other.columns)
    a, b = (sorted(map(tuple, df.select(names).collect()), key=str) for df in (one, other))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and p == pytest.approx(q, rel=1e-9, abs=1e-9))


def store_of(spark, folder, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return FeatureStore(spark, str(folder), schema, ["series_id"], "date", build, features.HALO, ["rate", "fx"], True, **more)


def test_appends_and_corrections_equal_a_recompute(spark, tmp_path):
    rows = market()
    cut = START + dt.timedelta(days=700)
    rng = random.Random(2)
    store = store_of(spark, tmp_path)
    early = {k: r for k, r in rows.items() if k[1] < cut and not (k[0] == "a" and k[1].month == 7)}
    wrong = dict(early)
    for k in rng.sample(sorted(k for k in early if k[0] == "b"), 3):
        wrong[k] = (*k, 1.0, None, 9.0)
    first = store.update(spark.createDataFrame(list(wrong.values()), SCHEMA))
    assert (first.version, first.changed) == (1, len(wrong)) and first.recomputed == len(wrong)
    same(store.read(), whole(spark, wrong))
    # Late corrections of one series.
    fixes = [early[k] for k in early if early[k] != wrong[k]]
    second = store.update(spark.createDataFrame(fixes, SCHEMA))
    same(store.read(), whole(spark, early))
    assert second.changed == 3 and second.recomputed < 0.5 * len(early)
    # Rows that were missing in the middle, then the newest ones.
    late = [r for k, r in rows.items() if k[1] < cut and k not in early]
    store.update(spark.createDataFrame(late, SCHEMA))
    new = [r for k, r in rows.items() if k[1] >= cut]
    fourth = store.update(spark.createDataFrame(new, SCHEMA))
    same(store.read(), whole(spark, rows))
    assert fourth.recomputed < len(new) + 5 * 31 * 3 and fourth.read < len(new) + 8 * 31 * 3


def test_known_values_reach_over_gaps(spark, tmp_path):
    """A first known value that comes, moves and goes changes the whole leading gap; others up to the next one."""
    rows = {("a", START + dt.timedelta(days=i)): ("a", START + dt.timedelta(days=i), float(i), None, 1.0) for i in range(500)}
    rows["a", START + dt.timedelta(days=450)] = ("a", START + dt.timedelta(days=450), 450.0, 4.0, 1.0)
    store = store_of(spark, tmp_path)
    store.update(spark.createDataFrame(list(rows.values()), SCHEMA))
    for day, rate in ((200, 2.0), (320, 3.0), (200, None), (450, 7.0), (320, None)):
        k = ("a", START + dt.timedelta(days=day))
        rows[k] = (*k, float(day), rate, 1.0)
        store.update(spark.createDataFrame([rows[k]], SCHEMA))
        same(store.read(), whole(spark, rows))


def test_events_in_a_store_equal_blocked_windows(spark, tmp_path):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), i, rng.uniform(1, 9)) for i in range(6000)]
    schema = "series_id string, ts timestamp_ntz, event_id long, price double"
    df = spark.createDataFrame(rows, schema)

    def prices(d, w):
        return features.add_features(d, w, features.PRICE_FEATURES)

    store = FeatureStore(spark, str(tmp_path), df.schema, ["series_id"], "ts", prices, features.HALO, ties=["event_id"],
                         bucket=lambda t: F.date_format(t, "yyyy-MM-dd-HH"))
    store.update(df.filter("event_id % 50 <> 7"))
    update = store.update(df.filter("event_id = 1007"))
    assert update.recomputed <= 3 * 80 and update.buckets <= 2
    store.update(df.filter("event_id % 50 = 7"))
    want = blocked.blocked_window(df, ["series_id"], "ts", prices, features.HALO, ties=["event_id"]).drop("position")
    same(store.read(), want)


def test_updates_that_fail_or_are_empty_change_nothing(spark, tmp_path, monkeypatch):
    store = store_of(spark, tmp_path)
    assert store.read().count() == 0 and store.version() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert store.update(none).changed == 0
    row = ("a", START, 1.0, 1.0, 1.0)
    with pytest.raises(ValueError, match="null in"):
        store.update(spark.createDataFrame([("a", None, 1.0, 1.0, 1.0)], SCHEMA))
    with pytest.raises(ValueError, match="same place"):
        store.update(spark.createDataFrame([row, row], SCHEMA))
    store.update(spark.createDataFrame([row], SCHEMA))

    def stop(*_):
        raise InterruptedError

    monkeypatch.setattr(store, "_publish", stop)
    with pytest.raises(InterruptedError):
        store.update(spark.createDataFrame([("a", START, 2.0, 1.0, 1.0)], SCHEMA))
    assert store.version() == 1 and store.read().first().price == 1.0
