"""Exact top-k by inner product: vectors in shards by place, one KD-tree a shard, best first.

Vectors become integers, floor(scale * x), so that scores are exact. Cuts at medians, learned from a
bounded sample, deal all rows to places; a place with too many rows for one task has several shards.
Each shard has a tight bounding box and a KD-tree, split at the median of its widest dimension, with a
tight box at every node. For a query q and a box the largest possible score is the sum over the
dimensions of the larger of q * low and q * high.

Each query meets its own shard first, which gives a k-th score; then, of the others, the shard of the
largest bound, which improves it; then the shards whose bound still reaches the k-th score. Bounds of
shards are compared before any vector moves. Inside a shard a heap holds the nodes by bound, and the
traversal ends when the best one left falls below the k-th score.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.session import materialise

#: Rows of a shard, of a leaf, and of a block of queries; rows of the sample that the cuts are learned from.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, SAMPLE_ROWS = 8192, 128, 4096, 20_000
LARGEST = (1 << 63) - 1
_LOWEST = float("-inf")


def finite(vector: Column) -> Column:
    """Components as doubles; null where the vector takes no part."""
    doubles = vector.cast("array<double>")
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & (F.size(doubles) > 0), doubles)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where all are exact, else Python integers."""
    if np.abs(values).max(initial=0.0) < 2.0**52 / scale:
        return np.floor(values * scale)
    return np.array([floor(Fraction(v) * scale) for v in values.ravel().tolist()], object).reshape(values.shape)


class Tree:
    """A KD-tree over one shard: row order, nodes with tight boxes, and children of inner nodes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.edges: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []
        pending = [(0, len(points), -1, 0)]
        while pending:
            start, end, parent, side = pending.pop()
            node = len(self.edges)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = tuple(pair)
            inside = points[self.order[start:end]]
            low.append(inside.min(axis=0))
            high.append(inside.max(axis=0))
            spread = high[-1] - low[-1]
            self.edges.append((start, end))
            if end - start <= leaf or not spread.any():
                self.children.append(None)
                continue
            self.children.append((-1, -1))
            middle = (end - start) // 2
            column = inside[:, spread.argmax()]
            near = column.argsort(kind="stable") if column.dtype == object else np.argpartition(column, middle)
            self.order[start:end] = self.order[start:end][near]
            pending += [(start + middle, end, node, 1), (start, start + middle, node, 0)]
        self.low, self.high = np.array(low), np.array(high)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest score each query can have in each node."""
        return upper_bounds(queries, self.low, self.high)


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def exact_floats(*tables: np.ndarray) -> bool:
    """Whether inner products of such integers are exact in double precision."""
    if any(t.dtype == object for t in tables):
        return False
    most = [float(np.abs(t).max(initial=0)) for t in tables]
    return most[0] * most[-1] * max(1, tables[0].shape[1]) < 2.0**53


def exact(table: np.ndarray, kind) -> np.ndarray:
    """Integers as ``kind``: doubles, or Python integers when products are too large for them."""
    if kind is object and table.dtype != object:
        return np.array([int(v) for v in table.ravel().tolist()], object).reshape(table.shape)
    return table


def search(points, ids, queries, query_ids, floors, k: int, visited: list[int] | None = None):
    """(query, vector, score) rows: the best ``k`` of each query, ties to the smaller vector id.

    ``floors`` are scores that k other rows already reach; a node below one is not visited. ``visited``
    gets the number of rows compared.
    """
    kind = np.float64 if exact_floats(points, queries) else object
    tree = Tree(exact(points, kind))
    ids = ids[tree.order]
    queries = exact(queries, kind)
    out, seen = [], 0
    bounds = tree.bounds(queries)
    if kind is object:
        # A k-th score passed on as a double may lie above the integer it stands for.
        floors = [float(np.nextafter(f, -np.inf)) for f in floors]
    for q, query_id, least, bound in zip(queries, query_ids, floors, bounds):
        kth, scores, found = least, np.empty(0, kind), np.empty(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap:
            best, node = heappop(heap)
            # Equal scores may still win by id, so only strictly lower nodes are left out.
            if -best < kth:
                break
            if (pair := tree.children[node]) is not None:
                for child in pair:
                    if bound[child] >= kth:
                        heappush(heap, (-bound[child], child))
                continue
            a, b = tree.edges[node]
            seen += b - a
            other = ids[a:b] != query_id
            scores = np.concatenate((scores, (tree.points[a:b] @ q)[other]))
            found = np.concatenate((found, ids[a:b][other]))
            if len(scores) > k:
                first = sorted(range(len(scores)), key=lambda i: (-scores[i], found[i]))[:k] if kind is object else np.lexsort((found, -scores))[:k]
                scores, found = scores[first], found[first]
            if len(scores) == k:
                kth = max(kth, scores.min())
        out += [(query_id, int(v), int(s)) for v, s in zip(found, scores) if s >= least]
    if visited is not None:
        visited.append(seen)
    return out


FOUND = "query_id long, vec_id long, score long, weight double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("weight", pa.float64())])


def matrix(table: pa.Table, name: str, width: int) -> np.ndarray:
    values = table.column(name).combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _search_group(k: int, scale: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        width = rows.column("width")[0].as_py()
        found = search(
            integers(matrix(rows, "vector", width), scale), rows.column("id").to_numpy(),
            integers(matrix(asked, "vector", width), scale), asked.column("id").to_pylist(),
            asked.column("floor").to_pylist(), k,
        )
        told = [(q, v, max(-LARGEST, min(s, LARGEST)), _double(s)) for q, v, s in found]
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_FOUND, zip(*told) if told else [[]] * 4)})

    return run


def _double(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return float("inf") if score > 0 else float("-inf")


class Cuts:
    """Median cuts of a sample: a binary tree that gives every vector a place."""

    def __init__(self, sample: np.ndarray, places: int):
        self.dimension, self.cut, self.next = [], [], []
        self.places = 0
        self._grow(sample, places)

    def _grow(self, points: np.ndarray, places: int) -> int:
        """Number of the node, or -1 - place for a leaf."""
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        at = int(spread.argmax())
        cut = float(np.median(points[:, at])) if len(points) > 1 else 0.0
        above = points[:, at] >= cut if len(points) > 1 else np.zeros(0, bool)
        if places < 2 or len(points) < 2 or not above.any() or above.all():
            self.places += 1
            return -self.places
        node = len(self.cut)
        self.dimension.append(at)
        self.cut.append(cut)
        self.next.append((0, 0))
        self.next[node] = (self._grow(points[~above], places // 2), self._grow(points[above], places - places // 2))
        return node

    def place(self, points: np.ndarray) -> np.ndarray:
        if not self.cut:
            return np.zeros(len(points), np.int32)
        dimension, cut, after = np.array(self.dimension), np.array(self.cut), np.array(self.next)
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while (open_rows := node >= 0).any():
            here = node[open_rows]
            above = points[rows[open_rows], dimension[here]] >= cut[here]
            node[open_rows] = after[here, above.astype(int)]
        return (-1 - node).astype(np.int32)


def dealt(kept: DataFrame, sizes: dict[int, int], shard_rows: int) -> DataFrame:
    """Rows with ``place`` and ``part``: shards of about ``shard_rows`` rows that lie together."""
    cuts = {}
    for width, rows in sizes.items():
        if rows > shard_rows:
            order = F.xxhash64("id", F.lit("cuts"))
            drawn = kept.filter(F.col("width") == width).orderBy(order, "id").limit(SAMPLE_ROWS).select("vector")
            # A bounded sample reaches the driver for each length of vectors that fills several shards.
            cuts[width] = Cuts(matrix(drawn.toArrow(), "vector", width), -(-rows // shard_rows))

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            width = table.column("width").to_numpy()
            found = np.zeros(table.num_rows, np.int32)
            for w in np.unique(width):
                if int(w) in cuts:
                    here = np.flatnonzero(width == w)
                    found[here] = cuts[int(w)].place(matrix(table.take(here), "vector", int(w)))
            yield from table.append_column("place", pa.array(found)).to_batches()

    placed = materialise(kept.mapInArrow(place, "id long, asked boolean, vector array<double>, width int, place int"), "placed")
    counts = placed.groupBy("width", "place").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")
    # A row for each place.
    return placed.join(counts, ["width", "place"]).withColumn("part", part).drop("parts")


SHARD = ["width", "place", "part"]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of each query's best ``k`` rows.

    Queries are the rows where ``is_query`` holds; candidates are all rows with another id, so rows
    that repeat a query's id are not its candidates, and repeated rows of a query are one query (that
    of the smallest components). Rows without an id, and vectors that are null, empty, or hold null or
    non-finite components take no part, and vectors meet only those of the same length. Ties go to the
    smaller id; repeated rows with one id are separate candidates. Finite components of any size are
    exact; a score beyond 2**63 - 1 is given as that number (its negative likewise), and such scores
    are ranked by their nearest doubles.
    """
    spark = vectors.sparkSession
    kept = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
        finite(F.col(vector)).alias("vector"),
    ).filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    kept = materialise(kept.withColumn("width", F.size("vector")), "vectors")
    # One row for each length of vectors.
    sizes = {r["width"]: r["rows"] for r in kept.groupBy("width").agg(F.count("*").alias("rows")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = materialise(dealt(kept, sizes, shard_rows), "shards")
    asked = rows.filter("asked").groupBy("id", "width").agg(F.min(F.struct("vector", "place", "part")).alias("q"))
    blocks = -(-asked.count() // BLOCK_ROWS) or 1
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")
    queries = materialise(
        asked.select("id", "width", "q.vector", F.col("q.place").alias("home"), F.col("q.part").alias("home_part"), block.alias("block")),
        "queries",
    )

    def meet(pairs: DataFrame) -> DataFrame:
        """Queries with the shard to visit, in groups of one shard and one block of queries."""
        key = [*SHARD, "block"]
        pairs = pairs.select(*(F.col(c).alias(c) for c in (*key, "id", "vector", "floor")))
        wanted = pairs.select(*key).distinct()
        # New names again, as both sides come from one table.
        copies = rows.join(wanted, SHARD).select(*(F.col(c).alias(c) for c in (*key, "id", "vector")))
        return copies.groupBy(*key).cogroup(pairs.groupBy(*key)).applyInArrow(_search_group(k, scale), FOUND)

    def floors(found: DataFrame) -> DataFrame:
        """Queries with the k-th score they have so far."""
        best = _best(found, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("weight").alias("kth"))
        known = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(_LOWEST))
        return queries.join(best, queries["id"] == F.col("query_id"), "left").select(
            *queries.columns, F.coalesce(known, F.lit(_LOWEST)).alias("floor")
        )

    home = queries.withColumns({"place": F.col("home"), "part": F.col("home_part"), "floor": F.lit(_LOWEST)})
    found = materialise(meet(home), "first-shard")
    if max(sizes.values()) > shard_rows:
        wanted = Summarizer.metrics("min", "max").summary(array_to_vector("vector"))
        boxes = materialise(
            rows.groupBy(*SHARD).agg(wanted.alias("box")).select(
                *SHARD, vector_to_array("box.min").alias("low"), vector_to_array("box.max").alias("high")
            ),
            "boxes",
        )
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        boxes = boxes.select(*(F.col(c).alias(c) for c in (*SHARD, "low", "high")), every)
        second = None
        for only_best in (True, False):
            told = floors(found).select("id", "width", "vector", "home", "home_part", "block", "floor")
            pairs = told.groupBy("width", "block").cogroup(boxes.groupBy("width", "block")).applyInArrow(
                _reached(scale, only_best), VISIT
            )
            if only_best:
                pairs = second = materialise(pairs, "second-shards")
            else:
                seen = second.select("id", *SHARD)
                pairs = materialise(pairs.join(seen, ["id", *SHARD], "left_anti"), "visits")
            found = found.unionByName(materialise(meet(pairs), "next-shards"))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("weight").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


VISIT = "id long, vector array<double>, floor double, width int, place int, part int, block int"
_VISIT = pa.schema(
    [("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("floor", pa.float64()), ("width", pa.int32()),
     ("place", pa.int32()), ("part", pa.int32()), ("block", pa.int32())]
)


def _reached(scale: int, only_best: bool):
    """Shards, not a query's own, whose bound reaches its k-th score; the best one only, if asked."""

    def run(asked: pa.Table, boxes: pa.Table) -> pa.Table:
        if not asked.num_rows or not boxes.num_rows:
            return _VISIT.empty_table()
        width = asked.column("width")[0].as_py()
        low, high, q = (integers(matrix(t, c, width), scale) for t, c in ((boxes, "low"), (boxes, "high"), (asked, "vector")))
        kind = np.float64 if exact_floats(q, low) and exact_floats(q, high) else object
        bound = upper_bounds(exact(q, kind), exact(low, kind), exact(high, kind))
        least = asked.column("floor").to_numpy()
        place, part = boxes.column("place").to_numpy(), boxes.column("part").to_numpy()
        own = (asked.column("home").to_numpy()[:, None] == place) & (asked.column("home_part").to_numpy()[:, None] == part)
        # Compared as doubles; widened, as the k-th score is one and bounds may be larger integers.
        bound = np.array([[_double(v) for v in row] for row in bound]) if kind is object else bound
        slack = 0.0 if kind is not object else 1e-12 * np.abs(bound)
        reach = (bound + slack >= least[:, None]) & ~own
        if only_best:
            best = np.where(reach, bound, -np.inf).argmax(axis=1)
            reach &= np.arange(bound.shape[1]) == best[:, None]
        row, at = np.nonzero(reach)
        return pa.table(
            {
                "id": asked.column("id").take(pa.array(row)), "vector": asked.column("vector").take(pa.array(row)),
                "floor": least[row], "width": pa.array(np.full(len(row), width), pa.int32()),
                "place": pa.array(place[at], pa.int32()), "part": pa.array(part[at], pa.int32()),
                "block": asked.column("block").take(pa.array(row)),
            }
        )

    return run
