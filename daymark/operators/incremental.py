"""Feature tables that are kept up to date instead of computed again.

A window that looks back a fixed number of rows gives every row a short reach: a changed row changes
the features of itself and of the next ``halo`` rows, and through a fill those up to the next known
value. So the rows are kept in calendar buckets, together with a reduced row for each series and
bucket (its *piece*: rows, last and first known values). An update

1. merges the changed rows into their buckets and reduces only these again;
2. finds on the pieces alone which (series, bucket) are reached, and which earlier ones hold the rows
   that their first windows look back on;
3. reads just those buckets, fills them from the values the pieces carry in, builds the features, and
   writes the buckets that were reached.

Nothing is overwritten. An update writes new files for the buckets it touched, and a manifest, written
last, that says which version of each bucket counts: readers see the old table or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.session import materialise

MANIFEST = "version int, kind string, bucket string, place string"


@dataclass(frozen=True)
class Update:
    """What an update did: rows that came, rows computed again, rows read for that, buckets written."""

    version: int
    changed: int
    recomputed: int
    read: int
    buckets: int


class FeatureStore:
    """Rows of ``schema`` and the columns that ``build`` adds to them, below ``folder``.

    A row is known by ``keys``, ``time`` and ``ties``. ``fill`` names columns whose gaps take the last
    known value of their series, and with ``backward`` its first one. ``build`` appends columns over a
    window that is given to it, looking back at most ``halo`` rows. ``bucket`` turns ``time`` into the
    name of a bucket; names must sort like time. A bucket of one series is small enough for one task.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: T.StructType,
        keys: Sequence[str],
        time: str,
        build: Callable[[DataFrame, WindowSpec], DataFrame],
        halo: int,
        fill: Sequence[str] = (),
        backward: bool = False,
        ties: Sequence[str] = (),
        bucket: Callable[[Column], Column] = lambda t: F.date_format(t, "yyyy-MM"),
    ) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.keys, self.time, self.ties = list(keys), time, list(ties)
        self.build, self.halo, self.fill, self.backward = build, halo, list(fill), backward
        self.bucket = bucket

    # ------------------------------------------------------------ manifest and files

    def _manifest(self) -> dict[tuple[str, str], str]:
        """Place of each kind's buckets in the newest version. A row for each bucket of the calendar."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifests/*")
            newest = rows.agg(F.max("version")).first()[0]
            if newest is None:
                return {}
            found = rows.filter(F.col("version") == newest).collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return {}
        self._version = newest
        return {(r.kind, r.bucket): r.place for r in found}

    def version(self) -> int:
        """Number of the newest finished version, 0 before the first."""
        self._version = 0
        self._manifest()
        return self._version

    def _publish(self, version: int, places: dict[tuple[str, str], str]) -> None:
        rows = [(version, kind, bucket, place) for (kind, bucket), place in sorted(places.items())]
        table = self.spark.createDataFrame(rows, MANIFEST)
        table.coalesce(1).write.json(f"{self.folder}/manifests/{version:08d}-{uuid.uuid4().hex[:8]}")

    def _write(self, df: DataFrame, kind: str, version: int) -> dict[tuple[str, str], str]:
        """Write rows with their ``_bucket``; where the buckets lie."""
        place = f"{self.folder}/{kind}/v={version}-{uuid.uuid4().hex[:8]}"
        df.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(place)
        names = self.spark.read.parquet(place).select(F.col("_bucket").cast("string")).distinct().collect()
        return {(kind, r[0]): f"{place}/_bucket={r[0]}" for r in names}

    def _read(self, kind: str, schema: T.StructType, places: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        """The rows of some buckets, of all by default, with ``_bucket``."""
        wanted = sorted(b for k, b in places if k == kind and (buckets is None or b in set(buckets)))
        if not wanted:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_bucket", T.StringType())]))
        paths = [places[kind, b] for b in wanted]
        rows = self.spark.read.schema(schema).parquet(*paths)
        if kind == "pieces":
            return rows.withColumn("_bucket", F.col("_month"))
        return rows.withColumn("_bucket", self.bucket(F.col(self.time)))

    # ------------------------------------------------------------ reading

    def feature_schema(self) -> T.StructType:
        none = self.spark.createDataFrame([], self.schema)
        return self.build(none, Window.partitionBy(*self.keys).orderBy(self.time, *self.ties)).schema

    def read(self) -> DataFrame:
        """All rows with their features, as the newest finished version has them."""
        return self._read("features", self.feature_schema(), self._manifest()).drop("_bucket")

    # ------------------------------------------------------------ updating

    def _checked(self, changes: DataFrame) -> DataFrame:
        rows = materialise(changes.select(*self.schema.names), "changes")
        identity = [*self.keys, self.time, *self.ties]
        missing = F.lit(False)
        for c in identity:
            missing = missing | F.col(c).isNull()
        worst = rows.groupBy(*identity).agg(F.count("*").alias("n")).agg(F.max("n"), F.count_if(missing)).first()
        if worst[1]:
            raise ValueError(f"null in {', '.join(identity)}: such rows have no place in a series")
        if (worst[0] or 0) > 1:
            raise ValueError("two changed rows have the same place in a series")
        return rows.withColumn("_bucket", self.bucket(F.col(self.time)))

    def _pieces_of(self, rows: DataFrame) -> DataFrame:
        order = F.struct(self.time, *self.ties)
        known = {c: F.when(F.col(c).isNotNull(), order) for c in self.fill}
        return rows.groupBy(*self.keys, "_bucket").agg(
            F.count("*").alias("_n"),
            *[F.max_by(c, known[c]).alias(f"_last_{c}") for c in self.fill],
            *[F.min_by(c, known[c]).alias(f"_first_{c}") for c in self.fill],
        )

    def update(self, changes: DataFrame) -> Update:
        """Take in new rows, and rows that replace those with the same place in a series."""
        places, version = self._manifest(), 0
        version = (self._version if places else 0) + 1
        changes = self._checked(changes)
        # Buckets are the calendar's: their names are few.
        dirty = sorted(r[0] for r in changes.select("_bucket").distinct().collect())
        if not dirty:
            return Update(version - 1, 0, 0, 0, 0)
        identity = [*self.keys, self.time, *self.ties]
        stored = self._read("rows", self.schema, places, dirty)
        merged = stored.join(changes.select(*identity), identity, "left_anti").unionByName(changes)
        now = dict(places) | self._write(merged, "rows", version)
        fresh = self._read("rows", self.schema, now, dirty)

        reduced = self._pieces_of(fresh)
        old = self._read("pieces", self._piece_schema(reduced), places)
        touched = changes.select(*self.keys, "_bucket").distinct().withColumn("_dirty", F.lit(True))
        kept = old.select(*reduced.columns).filter(~F.col("_bucket").isin(dirty))
        pieces = kept.unionByName(reduced).join(touched, [*self.keys, "_bucket"], "left")
        plan = materialise(self._plan(pieces, old), "update-plan")
        now |= self._write(reduced.withColumn("_month", F.col("_bucket")), "pieces", version)

        needed = plan.filter("_affected or _context")
        buckets = sorted(r[0] for r in needed.select("_bucket").distinct().collect())
        rows = self._read("rows", self.schema, now, buckets).join(needed, [*self.keys, "_bucket"])
        rows = materialise(rows, "update-rows")
        built = self._built(rows)
        renewed = plan.filter("_affected").select(*self.keys, "_bucket")
        written = sorted(r[0] for r in renewed.select("_bucket").distinct().collect())
        # Other series of a written bucket keep the features they have.
        rest = self._read("features", self.feature_schema(), places, written).join(renewed, [*self.keys, "_bucket"], "left_anti")
        now |= self._write(rest.unionByName(built), "features", version)
        self._publish(version, now)
        counts = rows.agg(F.count_if("_affected"), F.count("*")).first()
        return Update(version, changes.count(), counts[0], counts[1], len(written))

    def _piece_schema(self, reduced: DataFrame) -> T.StructType:
        fields = [f for f in reduced.schema.fields if f.name != "_bucket"]
        return T.StructType([*fields, T.StructField("_month", T.StringType())])

    def _plan(self, pieces: DataFrame, old: DataFrame) -> DataFrame:
        """For each piece: whether its rows change, whether they are looked back on, what is carried in."""
        series = Window.partitionBy(*self.keys)
        w = series.orderBy("_bucket")
        earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = pieces.withColumn("_dirty", F.coalesce("_dirty", F.lit(False)))
        df = df.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        df = df.withColumn("_end", F.col("_start") + F.col("_n")).withColumn("_total", F.sum("_n").over(series))
        # A changed known value is carried on until the next bucket that knows one.
        ends = [F.col("_end")]
        for c in self.fill:
            found = F.min(F.when(F.col(f"_first_{c}").isNotNull(), F.col("_end"))).over(later)
            ends.append(F.coalesce(found, F.col("_total")))
        reach = F.when(F.col("_dirty"), (F.greatest(*ends) if len(ends) > 1 else ends[0]) + self.halo)
        df = df.withColumn("_reach", reach)
        affected = F.col("_dirty") | (F.col("_start") < F.coalesce(F.max("_reach").over(earlier), F.lit(-1)))
        if self.backward and self.fill:
            # The leading gap takes the first known value: a change at or before it changes the gap.
            heads = [F.min(F.when(F.col(f"_first_{c}").isNotNull(), F.col("_bucket"))).alias(f"_lead_{c}") for c in self.fill]
            before = old.groupBy(*self.keys).agg(*heads)
            df = df.join(before, self.keys, "left")
            first_dirty = F.min(F.when(F.col("_dirty"), F.col("_bucket"))).over(series)
            last = F.max("_bucket").over(series)
            gaps = []
            for c in self.fill:
                head = F.coalesce(F.min(F.when(F.col(f"_first_{c}").isNotNull(), F.col("_bucket"))).over(series), last)
                gaps.append(F.greatest(head, F.coalesce(f"_lead_{c}", head)))
            gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
            df = df.withColumn("_gap", F.when(first_dirty <= gap, gap))
            gap_end = F.max(F.when(F.col("_bucket") <= F.col("_gap"), F.col("_end"))).over(series) + self.halo
            affected = affected | (F.col("_bucket") <= F.col("_gap")) | (F.col("_start") < gap_end)
        df = df.withColumn("_affected", F.coalesce(affected, F.lit(False)))
        following = F.min(F.when(F.col("_affected"), F.col("_start"))).over(later)
        context = ~F.col("_affected") & (F.col("_end") > following - self.halo)
        df = df.withColumn("_context", F.coalesce(context, F.lit(False)))
        # A run of pieces that are read without a gap between them is one window.
        index, used = F.row_number().over(w), F.sum((F.col("_affected") | F.col("_context")).cast("int")).over(upto)
        carried = [F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in self.fill]
        whole = series.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        heads = [F.first(f"_first_{c}", ignorenulls=True).over(whole).alias(f"_head_{c}") for c in self.fill]
        return df.select(*self.keys, "_bucket", "_affected", "_context", (index - used).alias("_run"), *carried, *heads)

    def _built(self, rows: DataFrame) -> DataFrame:
        """Features of the affected rows, with ``_bucket``."""
        order = [self.time, *self.ties]
        if self.fill:
            past = Window.partitionBy(*self.keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            steps = {}
            for c in self.fill:
                tail = [F.col(f"_head_{c}")] if self.backward else []
                steps[c] = F.coalesce(F.last(c, ignorenulls=True).over(past), F.col(f"_in_{c}"), *tail)
            rows = rows.withColumns(steps)
        frame = rows.select(*self.schema.names, "_bucket", "_affected", "_run")
        w = Window.partitionBy(*self.keys, "_run").orderBy(*order)
        return self.build(frame, w).filter("_affected").drop("_affected", "_run")
