"""A stream of landed files leaves the table that a batch over all of them computes."""

import random

from pyspark.sql import functions as F

from daymark.operators import blocked, features
from daymark.operators.incremental import FeatureStore
from daymark.streaming.upkeep import keep_features
from test_incremental import SCHEMA, market, same, store_of, whole


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    rows, folder = market(days=400), str(tmp_path / "landed")
    rng = random.Random(3)
    order = sorted(rows, key=lambda k: (k[1], k[0]))
    late = set(rng.sample(order, 40))
    schema = f"{SCHEMA}, loaded int"
    timely = [k for k in order if k not in late]
    parts = [timely[j * 250 : (j + 1) * 250] for j in range(4)]
    for n, part in enumerate([*parts, sorted(late)]):
        # A row with a mistake and its correction in one file: the one loaded last counts.
        wrong = [(*rows[part[0]][:2], 1.0, None, None, -1)] if part else []
        land(spark, folder, [(*rows[k], n) for k in part] + wrong, schema)
    store = store_of(spark, tmp_path / "store")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = keep_features(stream, store, str(tmp_path / "offsets"), newest="loaded")
    query.awaitTermination()
    left = {k: r for k, r in rows.items() if k in late or any(k in p for p in parts)}
    same(store.read(), whole(spark, left))
    assert store.version() == 5
    # Files that come later, and a correction of an old day, are taken up from the same offsets.
    fix = order[100]
    left[fix] = (*fix, 99.0, 1.0, 1.0)
    land(spark, folder, [(*left[fix], 9)], schema)
    keep_features(stream, store, str(tmp_path / "offsets"), newest="loaded").awaitTermination()
    assert store.version() == 6
    same(store.read(), whole(spark, left))


def test_events_delivered_twice(spark, tmp_path):
    schema = "series_id string, ts timestamp_ntz, event_id long, price double"
    events = spark.range(2000).select(
        F.when(F.col("id") % 4 == 0, "b").otherwise("hot").alias("series_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") / 3).cast("int"))).alias("ts"),
        F.col("id").alias("event_id"),
        (F.xxhash64("id") % 1000 / 7.0).alias("price"),
    )

    def prices(d, w):
        return features.add_features(d, w, features.PRICE_FEATURES)

    store = FeatureStore(spark, str(tmp_path / "store"), spark.createDataFrame([], schema).schema, ["series_id"], "ts",
                         prices, features.HALO, ties=["event_id"], bucket=lambda t: F.date_format(t, "yyyy-MM-dd-HH"))
    folder = str(tmp_path / "landed")
    for n in range(2):
        events.filter(F.col("event_id") % 2 == n).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for n in range(2):
        # Another checkpoint: everything is delivered again.
        keep_features(stream, store, str(tmp_path / f"offsets{n}")).awaitTermination()
        want = blocked.blocked_window(events, ["series_id"], "ts", prices, features.HALO, ties=["event_id"]).drop("position")
        same(store.read(), want)
