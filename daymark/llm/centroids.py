"""Centroid clustering in exact integers by progressive Walsh-Hadamard search.

The Walsh-Hadamard transform of width w multiplies every squared distance by w and changes it in no
other way. Its coefficients are taken coarse to fine (by number of sign changes): the squared
differences seen so far are a lower bound of the whole sum, and the whole sum of the leading centroid
is an upper bound of the smallest one. A centroid whose part already exceeds that is strictly worse
and is left; the others take more coefficients, at last all of them, so distances and ties are exact.

Every round is one pass over the vectors: a task returns, for each centroid, counts and sums of its
vectors; Spark adds them up, and only the sums of the centroids reach the driver. Sums travel as limbs
of 30 bits, so integers of any size are added exactly.
"""

from __future__ import annotations

from fractions import Fraction
from hashlib import sha256
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_rows
from daymark.session import materialise

#: Components up to this size leave room for all sums of squares in 64 bits; larger ones use big integers.
SMALL_LIMIT = 1 << 24
LIMB = 30
LARGEST = (1 << 63) - 1
ROWS = 1024


def sign_changes(width: int) -> np.ndarray:
    """Coefficients of the transform of ``width`` (a power of two), coarse to fine."""
    at = np.arange(width)
    odd = np.bitwise_count(at[:, None] & at[None, :]) & 1
    return np.argsort((np.diff(odd.astype(int), axis=1) != 0).sum(axis=1), kind="stable")


def transform(points: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, coarse to fine, in the integers of ``points``."""
    n, width = points.shape
    out, step = points.copy(), 1
    while step < width:
        pairs = out.reshape(n, -1, 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return out[:, sign_changes(width)]


def stages(width: int) -> list[tuple[int, int]]:
    edges = [0]
    while edges[-1] < width:
        edges.append(min(width, max(4, 2 * edges[-1])))
    return list(zip(edges, edges[1:]))


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to each row's nearest centroid, and the coefficients looked at."""
    width = points.shape[1]
    x, c = transform(points), transform(centroids)
    rows, columns = (a.ravel() for a in np.indices((len(x), len(c))))
    part = np.zeros((len(x), len(c)), x.dtype)
    alive = np.ones(part.shape, bool)
    seen = 0
    for start, end in stages(width):
        gap = x[rows, start:end] - c[columns, start:end]
        part[rows, columns] += (gap * gap).sum(axis=1)
        seen += gap.size
        worst = part.max() + 1 if part.size else 0
        lead = np.where(alive, part, worst).argmin(axis=1)
        if end == width:
            break
        gap = x[:, end:] - c[lead, end:]
        most = part[np.arange(len(x)), lead] + (gap * gap).sum(axis=1)
        alive &= (part <= most[:, None]).astype(bool)
        left = alive[rows, columns]
        rows, columns = rows[left], columns[left]
    return lead, part[np.arange(len(x)), lead] // width, seen


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers where all are small, else big ones."""
    if np.abs(values).max(initial=0.0) <= SMALL_LIMIT / scale:
        return np.floor(values * scale).astype(np.int64)
    return np.array([floor(Fraction(v) * scale) for v in values.ravel().tolist()], object).reshape(values.shape)


def matched(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and distance, with centroids as Python integers."""
    small = points.dtype != object and max((abs(v) for row in centroids for v in row), default=0) <= SMALL_LIMIT
    kind = np.int64 if small else object
    cluster, distance, _ = nearest(points.astype(kind), np.array(centroids, kind))
    return cluster, distance


def limbs(value: int) -> list[int]:
    """Signed digits of base 2**LIMB, lowest first."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _batches(batches, width: int, scale: int):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0), integers(flat.reshape(-1, width), scale)


def summed(kept: DataFrame, centroids: list[list[int]], width: int, scale: int) -> dict[tuple[int, int], int]:
    """Sums of the components of each cluster's vectors, and at component -1 their number."""

    def run(batches):
        total: dict[tuple[int, int], int] = {}
        for _, points in _batches(batches, width, scale):
            cluster, _ = matched(points, centroids)
            for k in np.unique(cluster):
                inside = points[cluster == k]
                for d, s in enumerate((len(inside), *inside.sum(axis=0)), -1):
                    total[int(k), d] = total.get((int(k), d), 0) + int(s)
        found = [(k, d, i, s) for (k, d), value in total.items() for i, s in enumerate(limbs(value))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in found], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["cluster", "component", "limb", "s"],
        )

    parts = kept.mapInArrow(run, "cluster int, component int, limb int, s long")
    # (width + 1) components of each centroid, whatever the number of vectors.
    rows = parts.groupBy("cluster", "component", "limb").agg(F.sum("s").alias("s")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in rows:
        at = r["cluster"], r["component"]
        out[at] = out.get(at, 0) + (r["s"] << (LIMB * r["limb"]))
    return out


def first_centroids(kept: DataFrame, k: int, seed: int, width: int, scale: int) -> list[list[int]]:
    """The ``k`` vectors of smallest hash; rows with one id go by their components, missing ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return [integers(np.array(r["vector"]), scale).tolist() for r in rows]


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    seed: int = 2,
    width: int = 64,
    scale: int = 256,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Kept are vectors of exactly ``width`` components (a power of two), none null or non-finite; rows
    without a vector, and others, are not returned. Components become floor(scale * x). The nearest
    centroid is that of smallest squared distance, of several the smallest number; ``rounds`` times
    every centroid with vectors becomes the floor of their mean. With fewer than ``k`` vectors there
    are as many centroids. Repeated rows are vectors each, and rows without an id take part. Components
    of any finite size are exact; a distance or inertia beyond 2**63 - 1 is given as that number. Other
    columns are not looked at. No vectors give no rows.
    """
    doubles = F.col(vector).cast("array<double>")
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_column).cast("long").alias("id"), doubles.alias("vector")).filter(
        fine & (F.size(F.col(vector)) == width)
    )
    kept = materialise(kept, "vectors")
    centroids = first_centroids(kept, k, seed, width, scale)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], f"{id_column} long, {CLUSTERED}")
    for _ in range(rounds):
        total = summed(kept, centroids, width, scale)
        for i in range(len(centroids)):
            if n := total.get((i, -1), 0):
                centroids[i] = [total.get((i, d), 0) // n for d in range(width)]

    def run(batches):
        for ids, points in _batches(batches, width, scale):
            found, distance = matched(points, centroids)
            yield [ids, found, [min(int(d), LARGEST) for d in distance]]

    final = materialise(map_rows(kept, run, f"{id_column} long, cluster int, distance long"), "clustered")
    # One row a centroid.
    total = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = min(int(sum(r["s"] for r in total)), LARGEST)
    facts = [
        (r["cluster"], min(int(r["s"]), LARGEST), inertia, sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest())
        for r in total
    ]
    told = vectors.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # At most ``k`` rows are broadcast.
    return final.join(F.broadcast(told), "cluster").select(id_column, *(c.split()[0] for c in CLUSTERED.split(", ")))


CLUSTERED = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
