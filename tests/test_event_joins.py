"""As-of joins, user functions over rolling windows, and exact quantiles, against plain Python."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.operators.asof import asof_join
from daymark.operators.quantile import exact_quantile
from daymark.operators.rolling import rolling_apply

START = dt.datetime(2024, 1, 1)


def stamp(n):
    return None if n is None else START + dt.timedelta(seconds=n)


def sides(n=1500, seed=1):
    """Two thirds of the rows on one key, many of them in one instant."""
    rng = random.Random(seed)
    def rows(first):
        out = []
        for i in range(n):
            key = rng.choice(["hot", "hot", "cold", "rare" if rng.random() < 0.05 else "cold", None if rng.random() < 0.02 else "hot"])
            at = 500 if rng.random() < 0.3 else rng.randrange(1000)
            out.append((key, None if rng.random() < 0.02 else at, first + i))
        return out
    return rows(0), rows(10_000) + [("only-right", 1, 99_999)]


def by_hand(left, right, strict, within):
    out = []
    for key, at, i in left:
        best = None
        for k, t, j in right:
            if key is not None and k == key and t is not None and at is not None and (t < at or t == at and not strict):
                best = max(best or (-1, -1), (t, j))
        if best and within is not None and best[0] < at - within:
            best = None
        out.append((i, *(best or (None, None))))
    return sorted(out)


@pytest.mark.parametrize("strict, within", [(False, None), (True, None), (True, 3), (False, 0)])
def test_asof_join_by_hand(spark, strict, within):
    left, right = sides()
    l = spark.createDataFrame([(k, stamp(t), i, i % 7) for k, t, i in left], "k string, ts timestamp_ntz, id long, x int").repartition(5)
    r = spark.createDataFrame([(k, stamp(t), t, j) for k, t, j in right], "k string, ts timestamp_ntz, seen int, rid long").repartition(3)
    limit = None if within is None else F.expr(f"interval {within} second")
    found = asof_join(l, r, ["k"], "ts", ["seen", "rid"], ties=["rid"], strict=strict, within=limit)
    assert found.columns == ["k", "ts", "id", "x", "seen", "rid"]
    want = by_hand(left, right, strict, within)
    assert sorted((row["id"], row["seen"], row["rid"]) for row in found.collect()) == want
    inner = asof_join(l, r, ["k"], "ts", ["seen", "rid"], ties=["rid"], strict=strict, within=limit, how="inner")
    assert inner.count() == sum(w[1] is not None for w in want)


def test_asof_join_edges(spark):
    l = spark.createDataFrame([("a", stamp(5), 1), ("a", stamp(5), 1)], "k string, ts timestamp_ntz, id long")
    r = spark.createDataFrame([], "k string, ts timestamp_ntz, rid long")
    assert [tuple(x)[2:] for x in asof_join(l, r, ["k"], "ts", ["rid"]).collect()] == [(1, None)] * 2
    assert asof_join(r.withColumnRenamed("rid", "id"), r, ["k"], "ts", ["rid"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof_join(l, l, ["k"], "ts", ["id"])
    with pytest.raises(ValueError, match="left or inner"):
        asof_join(l, r, ["k"], "ts", ["rid"], how="outer")


@pytest.mark.parametrize("size, lag, block_rows", [(5, 0, 16), (4, 3, 4096), (1, 2, 7)])
def test_rolling_apply_by_hand(spark, size, lag, block_rows):
    rng = random.Random(3)
    series = {"a": 300, "b": 3, "c": 41}
    rows = []
    for key, n in series.items():
        for i in range(n):
            value = rng.choice([None, float("nan")]) if rng.random() < 0.05 else rng.uniform(-5, 5)
            rows.append((key, stamp(i // 3), i, value))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v double").repartition(4)
    spread = rolling_apply(df, ["k"], "ts", "v", lambda m: m.max(axis=1) - m.min(axis=1), size, "spread", lag, ["id"], max(block_rows, size + lag))
    got = {(r["k"], r["id"]): r["spread"] for r in spread.collect()}
    assert spread.columns == [*df.columns, "spread"] and len(got) == len(rows)
    for key in series:
        values = [v for k, _, _, v in rows if k == key]
        for i in range(len(values)):
            window = values[max(0, i - lag - size + 1) : max(0, i - lag + 1)]
            full = len(window) == size and all(v is not None and v == v for v in window)
            assert got[key, i] == (pytest.approx(max(window) - min(window)) if full else None)


def test_rolling_apply_refuses(spark):
    df = spark.createDataFrame([("a", stamp(1), 1.0)], "k string, ts timestamp_ntz, v double")
    for wrong in ({"size": 0}, {"size": 2, "lag": -1}):
        with pytest.raises(ValueError):
            rolling_apply(df, ["k"], "ts", "v", np.sum, name="x", **wrong)
    with pytest.raises(ValueError, match="column already"):
        rolling_apply(df, ["k"], "ts", "v", np.sum, 2, "v")
    none = spark.createDataFrame([], "k string, ts timestamp_ntz, v double")
    assert rolling_apply(none, ["k"], "ts", "v", lambda m: m.sum(axis=1), 2, "x").count() == 0


@pytest.mark.parametrize("share", [0.5, 0.0, 1.0, 0.9])
def test_exact_quantile_by_hand(spark, share):
    rng = random.Random(4)
    groups = {
        "spread": [rng.gauss(0, 1) for _ in range(4001)],
        "ties": [float(rng.choice([1, 1, 1, 2, 5])) for _ in range(3000)],
        "same": [7.0] * 500,
        "two": [1.0, 2.0],
        "one": [3.0],
        "none": [None, None],
        None: [float(x) for x in range(100)],
        "endless": [float("-inf"), 1.0, float("inf")],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("spread", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    # Few steps and a small bracket need several rounds.
    for bracket, steps in ((20, 4), (65_536, 256)):
        got = {r["k"]: (r["n"], r["q"]) for r in exact_quantile(df, ["k"], "v", share, "q", bracket, steps).collect()}
        assert set(got) == set(groups)
        for key, values in groups.items():
            known = sorted(v for v in values if v is not None)
            want = float(np.quantile(known, share)) if known and key != "endless" else None
            if key == "endless":
                want = {0.5: 1.0, 0.0: float("-inf"), 1.0: float("inf"), 0.9: float("inf")}[share]
            assert got[key] == (len(known), pytest.approx(want, abs=1e-12) if known else None)
    if share == 0.5:
        assert got["spread"][1] == pytest.approx(statistics.median(groups["spread"]))


def test_exact_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0
