import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Row

from daymark.operators import oversample

N, DIM = 180, 4


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(N, DIM)) * rng.uniform(0.1, 6.0, size=(N, 1))
    points[40:70] = points[40]  # a third of a cell are copies of one row
    return points


def brute_force(points, i):
    distance = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
    distance[i] = np.inf
    return np.sort(distance)[: oversample.NEIGHBOURS]


def test_neighbours_are_exact(spark, cloud):
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(cloud)], "idx bigint, v array<double>")
    probes = rows.filter("idx % 3 = 0").select("idx")
    found = oversample.nearest(rows, probes, ring_rows=16).toPandas()
    assert found.groupby("idx").size().eq(oversample.NEIGHBOURS).all()
    assert set(found["idx"]) == {i for i in range(N) if i % 3 == 0}
    for i, group in found.groupby("idx"):
        assert np.allclose(np.sort(group["distance"].to_numpy()), brute_force(cloud, i))
        assert i not in set(group["neighbour"])


def test_few_of_all_pairs_are_compared(spark, monkeypatch):
    """31 features in clusters: exact, by a small part of the pairs, also where a third of the rows are equal."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(25, 31)) * 10
    points = centres[rng.integers(0, 25, 3000)] + rng.normal(size=(3000, 31)) * rng.uniform(0.01, 0.3, size=(3000, 1))
    points[2000:] = points[7]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "idx bigint, v array<double>")
    monkeypatch.setattr(oversample, "CHUNK_ROWS", 500)
    counter = spark.sparkContext.accumulator(0)
    probes = rows.filter("idx < 2000").select("idx")
    found = oversample.nearest(rows, probes, ring_rows=100, counter=counter).toPandas().sort_values(["idx", "rank"])
    assert counter.value < 0.15 * 2000 * 3000
    for i in range(0, 2000, 7):
        square = np.zeros(3000)
        for c in range(31):
            square += (points[i, c] - points[:, c]) ** 2
        square[i] = np.inf
        want = np.lexsort((np.arange(3000), square))[: oversample.NEIGHBOURS]
        assert found["neighbour"][found["idx"] == i].tolist() == want.tolist()


def test_fewer_points_than_neighbours(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "idx bigint, v array<double>")
    found = {(r["idx"], r["neighbour"], r["rank"]) for r in oversample.nearest(rows, rows.select("idx")).collect()}
    assert found == {(0, 1, 0), (0, 2, 1), (1, 0, 0), (1, 2, 1), (2, 1, 0), (2, 0, 1)}
    assert oversample.nearest(rows.limit(0), rows.select("idx").limit(0)).count() == 0


def test_index_is_the_sorted_place(spark):
    rows = spark.createDataFrame([(str(i), i % 7) for i in range(200)], "a string, b int").repartition(6)
    got = [(r["a"], r["b"]) for r in oversample.indexed(rows, ["a", "b"]).orderBy("idx").collect()]
    assert got == sorted((str(i), i % 7) for i in range(200))


def labelled(spark, cloud, n_up):
    day = dt.date(2000, 1, 1)
    rows = [
        ("s", day + dt.timedelta(days=i), Vectors.dense(v), int(i < n_up)) for i, v in enumerate(cloud.tolist())
    ]
    frame = spark.createDataFrame(rows, ["series_id", "date", "features", "target"])
    return frame, Row(n_train=N, n_down=N - n_up, n_up=n_up, weight_down=N / (2 * (N - n_up)), weight_up=N / (2 * n_up))


def test_balance_reaches_the_ratio(spark, cloud):
    frame, weights = labelled(spark, cloud, 60)
    balanced, new = oversample.balance(frame, weights, 0.9, 42)
    counts = {r["target"]: r["count"] for r in balanced.groupBy("target").count().collect()}
    assert counts == {0: 120, 1: 108}
    assert (new.n_up, new.n_down, new.n_train) == (108, 120, 228)
    made = balanced.filter("series_id like 'synthetic-%'").select(vector_to_array("features").alias("v")).toPandas()
    made = np.stack(made["v"].to_numpy())
    minority = cloud[:60]
    assert (made.min(axis=0) >= minority.min(axis=0) - 1e-12).all()
    assert (made.max(axis=0) <= minority.max(axis=0) + 1e-12).all()


@pytest.mark.parametrize("n_up", [5, 85])
def test_data_that_cannot_be_oversampled_is_unchanged(spark, cloud, n_up):
    frame, weights = labelled(spark, cloud, n_up)
    balanced, new = oversample.balance(frame, weights, 0.9, 42)
    assert balanced is frame and new is weights


def sent_points(monkeypatch):
    """Right sides of the comparisons, as they are planned."""
    sent, plain = [], oversample._both

    def both(one, other, function, keys, schema, empty):
        if schema == oversample.FOUND:
            sent.append(other)
        return plain(one, other, function, keys, schema, empty)

    monkeypatch.setattr(oversample, "_both", both)
    return sent


@pytest.mark.parametrize("copied", [False, True])
def test_rings_are_sent_once_for_a_chunk_of_their_probes(spark, monkeypatch, copied):
    """The points sent follow the points, not their product with the chunks of all probes."""
    rng = np.random.default_rng(3)
    points = rng.uniform(size=(1500, 3))
    if copied:
        points[300:] = points[rng.integers(0, 300, 1200)]
        points[600:900] = points[5]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "idx bigint, v array<double>")
    monkeypatch.setattr(oversample, "CHUNK_ROWS", 30)
    sent = sent_points(monkeypatch)
    found = oversample.nearest(rows, rows.select("idx"), ring_rows=30).toPandas().sort_values(["idx", "rank"])
    # Before, a ring went to the chunks that its probes had among all probes.
    assert sum(df.count() for df in sent) < 14 * 1500
    found = found.groupby("idx")["neighbour"].apply(list)
    assert len(found) == 1500
    for i in range(1500):
        square = np.zeros(1500)
        for c in range(3):
            square += (points[i, c] - points[:, c]) ** 2
        square[i] = np.inf
        assert found[i] == np.lexsort((np.arange(1500), square))[: oversample.NEIGHBOURS].tolist()


def test_equal_points_are_not_compared_with_each_other(spark):
    points = [(i, [float(i)] if i < 50 else [7.5]) for i in range(6000)]
    rows = spark.createDataFrame(points, "idx bigint, v array<double>")
    counter = spark.sparkContext.accumulator(0)
    found = oversample.nearest(rows, rows.select("idx"), counter=counter).toPandas().sort_values(["idx", "rank"])
    assert counter.value < 50_000
    found = found.groupby("idx")["neighbour"].apply(list)
    assert found[50] == [51, 52, 53, 54, 55] and found[52] == [50, 51, 53, 54, 55] and found[5999] == [50, 51, 52, 53, 54]
    assert found[7] == [50, 51, 52, 53, 54] and found[0] == [1, 2, 3, 4, 5]
