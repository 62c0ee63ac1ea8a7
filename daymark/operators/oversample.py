"""Optional minority oversampling: interpolate between a minority row and one of its neighbours.

Neighbours are exact. Of equal points only the first few can be neighbours of anything, so a point with
enough copies has its neighbours among them, and no more than these few are searched. The others'
neighbours are found by pivots. Some points are drawn as pivots and every point belongs to the nearest one; a pivot's points are cut into rings by their distance from it. A probe's nearest pivots,
and its own ring, give it a first radius. It then only visits pivots and rings that can hold something
closer: by the triangle inequality from the ring's distances, and by the plane halfway between the
ring's pivot and its own. Inside a ring it is compared only with points whose distance from the
pivot lies within the radius of its own. Pivots, rings and visits are tables; a task compares one
bounded chunk of a ring's probes with the ring and returns candidates within the radius, never the pairs. A
ring is sent once for each such chunk, so what is sent grows with points and visits alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from daymark.functions import draws
from daymark.operators import asof, blocked
from daymark.session import materialise

# Fixed value: neighbours considered per minority row.
NEIGHBOURS = 5

RING_ROWS, CHUNK_ROWS = 2_000, 4_000
#: Most pivots; each chunk of points is compared with all of them.
MOST_PIVOTS = 1_024
#: Pairs compared at once, and the share by which bounds are widened for rounding.
PAIR_STEP, SLACK = 1 << 19, 1e-9


def indexed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add a dense zero-based ``idx``: the place of the row in the order of ``keys``."""
    first, *ties = keys
    placed = blocked.global_positions(rows.withColumn("_all", F.lit(0)), ["_all"], first, ties)
    return placed.drop("_all").withColumnRenamed("position", "idx")


def _matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of equally many rows, components added in order."""
    out = np.zeros(len(a))
    for column in range(a.shape[1]):
        out += (a[:, column] - b[:, column]) ** 2
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for column in range(a.shape[1]):
        out += (a[:, column, None] - b[None, :, column]) ** 2
    return np.sqrt(out)


PLACED = "idx bigint, v array<double>, pivot int, d double, radius double"


def _place(k: int):
    """Points of a chunk to their nearest pivot; ``radius`` holds at least ``k`` other pivots."""

    def run(points: pa.Table, pivots: pa.Table) -> pa.Table:
        pivots = pivots.sort_by("no")
        gaps = _distances(_matrix(points), _matrix(pivots))
        best = gaps.argmin(axis=1)
        own = points.column("idx").to_numpy()[:, None] == pivots.column("pivot_idx").to_numpy()[None, :]
        others = np.sort(np.where(own, np.inf, gaps), axis=1)
        radius = others[:, k - 1] if others.shape[1] >= k else np.full(len(gaps), np.inf)
        return pa.table(
            {
                "idx": points.column("idx"), "v": points.column("v"),
                "pivot": pivots.column("no").to_numpy()[best].astype(np.int32),
                "d": gaps[np.arange(len(gaps)), best], "radius": radius,
            }
        )

    return run


VISITS = "idx bigint, v array<double>, own int, own_ring bigint, pivot int, d double, radius double"


def _visits(probes: pa.Table, pivots: pa.Table) -> pa.Table:
    """Pivots whose points may lie within a probe's radius."""
    pivots = pivots.sort_by("no")
    a, b = _matrix(probes), _matrix(pivots)
    gaps, radius = _distances(a, b), probes.column("radius").to_numpy()
    number = pivots.column("no").to_numpy()
    own = np.searchsorted(number, probes.column("pivot").to_numpy())
    lo, hi = pivots.column("lo").to_numpy(), pivots.column("hi").to_numpy()
    least = np.maximum(gaps - hi, lo - gaps)
    between = _distances(b, b)[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (gaps**2 - gaps[np.arange(len(a)), own][:, None] ** 2) / (2 * between)
    least = np.maximum(least, np.where(between > 0, plane, 0.0))
    row, at = np.nonzero(least <= (radius * (1 + SLACK))[:, None] + SLACK * (1 + gaps))
    return pa.table(
        {
            "idx": probes.column("idx").take(pa.array(row)), "v": probes.column("v").take(pa.array(row)),
            "own": number[own[row]].astype(np.int32), "own_ring": probes.column("ring").take(pa.array(row)),
            "pivot": number[at].astype(np.int32), "d": gaps[row, at], "radius": radius[row],
        }
    )


FOUND = "idx bigint, neighbour bigint, square double"


def _closest(k: int, counter: Accumulator | None):
    """The ``k`` nearest points of a ring for each probe, itself excluded, ties by index.

    ``d`` is the distance from the ring's pivot on both sides, so only points whose ``d`` lies within
    the probe's radius of its own are compared.
    """

    def run(probes: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by([("d", "ascending"), ("idx", "ascending")])
        a, b = _matrix(probes), _matrix(points)
        left, right = probes.column("idx").to_numpy(), points.column("idx").to_numpy()
        ring, centre, radius = points.column("d").to_numpy(), probes.column("d").to_numpy(), probes.column("radius").to_numpy()
        reach = radius * (1 + SLACK) + SLACK * (1 + centre)
        first, stop = np.searchsorted(ring, centre - reach, "left"), np.searchsorted(ring, centre + reach, "right")
        sizes = np.maximum(stop - first, 0)
        if counter is not None:
            counter.add(int(sizes.sum()))
        out, start = [], 0
        while start < len(a):
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), PAIR_STEP, "right")))
            n = sizes[start:end]
            row = np.repeat(np.arange(start, start + len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            apart = left[row] != right[at]
            row, at = row[apart], at[apart]
            square = _squares(a[row], b[at])
            order = np.lexsort((right[at], square, row))
            row, at, square = row[order], at[order], square[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
            best = (rank < k) & (square <= reach[row] ** 2)
            out.append((left[row[best]], right[at[best]], square[best]))
            start = end
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table(dict(zip(("idx", "neighbour", "square"), columns)))

    return run


def _both(one, other, function, keys: Sequence[str], schema: str, empty: pa.Schema) -> DataFrame:
    """``function`` of the rows of both sides that share ``keys``; nothing where one side is missing."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left, right) if left.num_rows and right.num_rows else empty.empty_table()

    return one.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(run, schema)


_EMPTY = {
    PLACED: pa.schema([("idx", pa.int64()), ("v", pa.list_(pa.float64())), ("pivot", pa.int32()), ("d", pa.float64()), ("radius", pa.float64())]),
    VISITS: pa.schema([("idx", pa.int64()), ("v", pa.list_(pa.float64())), ("own", pa.int32()), ("own_ring", pa.int64()),
                       ("pivot", pa.int32()), ("d", pa.float64()), ("radius", pa.float64())]),
    FOUND: pa.schema([("idx", pa.int64()), ("neighbour", pa.int64()), ("square", pa.float64())]),
}


def _search(probes: DataFrame, points: DataFrame, k: int, counter: Accumulator | None) -> DataFrame:
    """Candidates for probes that carry the ``pivot`` and ``ring`` to visit."""
    cell, keys = ["pivot", "ring"], ["pivot", "ring", "_chunk"]
    # A ring goes to chunks of its own probes: most rings have one.
    asked = probes.groupBy(*cell).agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("_chunks"))
    asked = materialise(asked, "ring-chunks")
    # Fresh column names for the right side: both sides descend from the same table.
    copies = points.join(asked, cell).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    copies = copies.select(*[F.col(c).alias(c) for c in (*keys, "idx", "v", "d")])
    several = asked.filter("_chunks > 1")
    number = F.pmod(F.xxhash64("idx"), F.coalesce("_chunks", F.lit(1))).cast("int")
    sent = probes.join(several, cell, "left").select(*cell, number.alias("_chunk"), "idx", "v", "d", "radius")
    return _both(sent, copies, _closest(k, counter), keys, FOUND, _EMPTY[FOUND])


def _best(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("idx").orderBy("square", "neighbour")
    return candidates.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def nearest(
    points: DataFrame,
    probes: DataFrame,
    k: int = NEIGHBOURS,
    ring_rows: int = RING_ROWS,
    counter: Accumulator | None = None,
) -> DataFrame:
    """Exact ``k`` nearest ``points`` of every probe: idx, neighbour, distance, rank.

    Both sides have a unique ``idx`` (points ``v``, array of double, too); probes are some of the points.
    With fewer than ``k`` others a probe has all of them. ``counter`` adds up the pairs compared.
    """
    wanted = probes.select("idx").distinct()
    equal = Window.partitionBy("v").orderBy("idx")
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The first k + 1 of equal points; ``equal`` has them where there are that many.
    firsts = points.select("idx", "v", F.row_number().over(equal).alias("copy")).filter(F.col("copy") <= k + 1)
    firsts = firsts.withColumn("_same", F.collect_list("idx").over(whole))
    firsts = materialise(
        firsts.select(
            "idx", "v", "copy", (F.size("_same") > k).alias("full"),
            F.when((F.col("copy") == 1) & (F.size("_same") > k), F.col("_same")).alias("equal"),
        ),
        "firsts",
    )
    # The first of very many equal points is carried to all of them in their order, not joined by one key.
    heads = firsts.filter("equal is not null").select("v", F.col("idx").alias("_at"), "equal")
    copies = points.select("idx", "v", F.col("idx").alias("_at")).join(wanted, "idx", "left_semi")
    among = asof.asof_join(copies, heads, ["v"], "_at", ["equal"], how="inner")
    others = F.slice(F.filter("equal", lambda x: x != F.col("idx")), 1, k)
    crowded = among.select("idx", F.posexplode(others).alias("rank", "neighbour")).select(
        "idx", "neighbour", F.lit(0.0).alias("distance"), "rank"
    )

    points = firsts.filter(F.col("copy") <= k).select("idx", "v")
    wanted = firsts.filter("not full").select("idx").join(wanted, "idx", "left_semi")
    n, last = points.agg(F.count("*"), F.max("idx")).first()
    count = min(MOST_PIVOTS, n, max(k + 1, math.isqrt(n)))
    chunk = F.floor(F.col("idx") / CHUNK_ROWS)
    drawn = points.orderBy(F.xxhash64("idx", F.lit("pivot")), "idx").limit(count)
    numbered = drawn.select(
        (F.row_number().over(Window.orderBy("idx")) - 1).alias("no"), F.col("idx").alias("pivot_idx"), "v"
    )
    # At most MOST_PIVOTS rows; each chunk of CHUNK_ROWS points gets a copy of them.
    pivots = materialise(numbered, "pivots")
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((last or 0) // CHUNK_ROWS).cast("bigint")))
    placed = _both(
        points.withColumn("_chunk", chunk), pivots.withColumn("_chunk", chunks), _place(k), ["_chunk"], PLACED, _EMPTY[PLACED]
    )
    ordered = materialise(blocked.global_positions(placed, ["pivot"], "d", ["idx"]), "placed")
    # Rings of a pivot hold equally many points, or one less.
    rings = F.ceil(F.col("members") / ring_rows)
    members = ordered.groupBy("pivot").agg(
        F.count("*").alias("members"), F.min("d").alias("lo"), F.max("d").alias("hi")
    )
    cells = materialise(
        ordered.join(members.select("pivot", "members"), "pivot").select(
            "idx", "v", "pivot", "d", "radius", F.floor(F.col("position") * rings / F.col("members")).alias("ring")
        ),
        "rings",
    )
    spans = cells.groupBy("pivot", "ring").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    asked = materialise(cells.join(wanted, "idx", "left_semi"), "asked")

    first = materialise(_best(_search(asked, cells, k, counter), k), "first-neighbours")
    kth = first.groupBy("idx").agg(F.count("*").alias("_found"), F.max("square").alias("_far"))
    nearer = F.when(F.col("_found") == k, F.sqrt("_far"))
    told = asked.join(kth, "idx", "left").withColumn("radius", F.least("radius", F.coalesce(nearer, F.col("radius"))))
    bounds = pivots.join(members.select(F.col("pivot").alias("no"), "lo", "hi"), "no").withColumn("_chunk", chunks)
    visits = _both(
        told.select("idx", "v", "pivot", "ring", "radius", chunk.alias("_chunk")), bounds, _visits, ["_chunk"], VISITS, _EMPTY[VISITS]
    )
    reach = F.col("radius") * (1 + SLACK) + SLACK * (1 + F.col("d"))
    near = (F.col("d") - reach <= F.col("hi")) & (F.col("d") + reach >= F.col("lo"))
    searched = (F.col("pivot") == F.col("own")) & (F.col("ring") == F.col("own_ring"))
    elsewhere = visits.join(spans, "pivot").filter(near & ~searched).select("idx", "v", "pivot", "ring", "d", "radius")
    more = _search(materialise(elsewhere, "visits"), cells, k, counter)
    searched = _best(first.select("idx", "neighbour", "square").unionByName(more), k)
    return searched.select("idx", "neighbour", F.sqrt("square").alias("distance"), "rank").unionByName(crowded)


def synthesise(minority: DataFrame, n_rows: int, wanted: int, seed: int, k: int = NEIGHBOURS) -> DataFrame:
    """``wanted`` synthetic vectors: a random row moved a random share of the way to a neighbour."""
    spark = minority.sparkSession
    keyed = indexed(minority.withColumn("v", vector_to_array("features")), ["series_id", "date"])
    points = materialise(keyed.select("idx", "v"), "minority")
    draw = F.col("id")
    picks = spark.range(wanted).select(
        "id",
        F.floor(draws.keyed_fraction(draw, F.lit("row"), F.lit(seed)) * n_rows).alias("idx"),
        F.floor(draws.keyed_fraction(draw, F.lit("neighbour"), F.lit(seed)) * k).cast("int").alias("rank"),
        draws.keyed_fraction(draw, F.lit("step"), F.lit(seed)).alias("step"),
    )
    found = nearest(points, picks.select("idx").distinct(), k).select("idx", "rank", "neighbour")
    base = points.withColumnRenamed("v", "a")
    other = points.select(F.col("idx").alias("neighbour"), F.col("v").alias("b"))
    moved = F.zip_with("a", "b", lambda a, b: a + F.col("step") * (b - a))
    return (
        picks.join(found, ["idx", "rank"])
        .join(base, "idx")
        .join(other, "neighbour")
        .select(F.col("id"), array_to_vector(moved).alias("features"))
    )


def balance(rows: DataFrame, weights: Row, ratio: float, seed: int) -> tuple[DataFrame, Row]:
    """Raise the minority to ``ratio`` of the majority; returns the rows and their new weights.

    Data that cannot be oversampled (already above the ratio, or too few minority rows for the
    neighbours) comes back unchanged.
    """
    minority, n_min, n_maj = (1, weights.n_up, weights.n_down)
    if n_min > n_maj:
        minority, n_min, n_maj = (0, weights.n_down, weights.n_up)
    wanted = math.floor(n_maj * ratio - n_min)
    if wanted <= 0 or n_min <= NEIGHBOURS:
        return rows, weights
    made = synthesise(rows.filter(F.col("target") == minority), n_min, wanted, seed).select(
        # Series and date stay unique for any number of rows.
        F.format_string("synthetic-%d", F.floor(F.col("id") / 1_000_000)).alias("series_id"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.pmod("id", F.lit(1_000_000)).cast("int")).alias("date"),
        "features",
        F.lit(minority).cast("int").alias("target"),
    )
    n_up = weights.n_up + (wanted if minority == 1 else 0)
    n_down = weights.n_down + (wanted if minority == 0 else 0)
    n = n_up + n_down
    changed = Row(n_train=n, n_down=n_down, n_up=n_up, weight_down=n / (2 * n_down), weight_up=n / (2 * n_up))
    return rows.unionByName(made), changed
