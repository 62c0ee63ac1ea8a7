"""Bring several series onto one date spine.

Date-grain frames are unique on ``(series_id, date)``, so one series holds at most one row
per calendar day (about 25,600 rows for 70 years) however much raw data was aggregated into
it. Windows partitioned by series are therefore bounded here. Event-grain frames have no such
bound and go through :mod:`daymark.operators.blocked`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from daymark.functions import scalars as S

SERIES = ("series_id",)


def lookback(df: DataFrame, years: int, date_col: str = "date", as_of=None) -> DataFrame:
    """Keep rows no older than ``years`` before the latest date, or before ``as_of``.

    The bound is a scalar subquery with the calendar arithmetic inside, so that it is a plain value by
    the time the file is scanned and old row groups are never read. (Parquet does not prune
    ``timestamp_ntz`` columns; rows are then filtered after the scan.)
    """
    column_type = df.schema[date_col].dataType
    if as_of is None:
        first = S.years_before(F.max(date_col).cast("date"), years).cast(column_type)
        bound = df.agg(first.alias("first")).scalar()
    else:
        latest = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
        bound = S.years_before(latest, years).cast(column_type)
    return df.filter(F.col(date_col) >= bound)


def latest_load(df: DataFrame, load_col: str, keys: Sequence[str] = ("series_id", "date")) -> DataFrame:
    """One row per key, the one loaded last. Aggregates map-side, so duplicates never pile up."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.col(load_col)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def check_unique(df: DataFrame, keys: Sequence[str] = ("series_id", "date")) -> DataFrame:
    """Raise if two rows share a key: a duplicate would multiply rows in the left joins."""
    clash = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"duplicate rows for {clash[0].asDict()}")
    return df


def check_has_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Raise if a column of some series has no value at all.

    Filling cannot repair it, and every row of that series would go.
    """
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in columns])
    empty = F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    found = counts.select(*keys, empty.alias("_empty")).filter(F.size("_empty") > 0).limit(1).collect()
    if found:
        series = ", ".join(str(found[0][k]) for k in keys)
        raise ValueError(f"no value in column(s) {', '.join(found[0]['_empty'])} of series {series}")
    return df


def observed(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES, order: str = "date"
) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and what the job that writes it finds out on the way.

    For filled frames: a series whose last row lacks a value has none at all. :func:`raise_for` turns the
    findings into the errors of :func:`check_unique` and :func:`check_has_values`, without a job.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    repeated = F.coalesce(F.lag(order).over(w) == F.col(order), F.lit(False))
    marked = df.withColumns({"_repeated": repeated, "_last": F.lead(order).over(w).isNull()})
    series = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    place = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in (*keys, order)])
    findings = [F.count("*").alias("rows"), F.min(F.when(F.col("_repeated"), place)).alias("repeated")]
    findings += [F.min(F.when(F.col("_last") & F.col(c).isNull(), series)).alias(f"empty {c}") for c in columns]
    seen = Observation()
    return marked.observe(seen, *findings).drop("_repeated", "_last"), seen


def raise_for(seen: Observation) -> None:
    """Raise what an observed write has found."""
    found = seen.get
    if found["repeated"] is not None:
        raise ValueError(f"duplicate rows for {found['repeated']}")
    empty = {k.removeprefix("empty "): v for k, v in found.items() if k.startswith("empty ") and v is not None}
    if empty:
        series = min(empty.values())
        names = [c for c, v in empty.items() if v == series]
        raise ValueError(f"no value in column(s) {', '.join(names)} of series {series}")


def left_align(spine: DataFrame, *series: DataFrame, on: Sequence[str] = ("date",)) -> DataFrame:
    """Left equi-joins of ``series`` onto ``spine``.

    No broadcast hint: the side series are aggregates, so their size is only known at run
    time, and adaptive execution switches to a broadcast join when it measures a small side.
    """
    for side in series:
        spine = spine.join(side, list(on), "left")
    return spine


def upsample_daily(
    df: DataFrame,
    value_cols: Sequence[str],
    date_col: str = "date",
    keys: Sequence[str] = (),
) -> DataFrame:
    """As-of upsampling: one row per calendar day between the first and last source row.

    A day takes the latest source row at or before its midnight. Days after the last source
    row are not produced; a first row later than midnight leaves its own day null.
    """
    stamp = F.col(date_col)
    day = stamp.cast("date")
    in_force = F.when(stamp == day.cast(df.schema[date_col].dataType), day).otherwise(F.date_add(day, 1))
    per_day = (
        df.withColumn("_from", in_force)
        .groupBy(*keys, "_from")
        .agg(
            F.max_by(F.struct(*value_cols), stamp).alias("_row"),
            F.min(day).alias("_first"),
            F.max(day).alias("_last"),
        )
    )
    w = Window.partitionBy(*keys).orderBy("_from")
    start = F.when(F.row_number().over(w) == 1, F.col("_first")).otherwise(F.col("_from"))
    end = F.coalesce(F.date_sub(F.lead("_from").over(w), 1), F.col("_last"))
    spans = per_day.select(*keys, "_from", "_row", start.alias("_start"), end.alias("_end"))
    days = F.when(F.col("_start") <= F.col("_end"), F.sequence("_start", "_end", F.expr("interval 1 day")))
    return spans.select(*keys, "_from", "_row", F.explode(days).alias("date")).select(
        *keys,
        "date",
        *[F.when(F.col("date") >= F.col("_from"), F.col("_row")[c]).alias(c) for c in value_cols],
    )


def fill_gaps(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = SERIES,
    order: str = "date",
    backward: bool = True,
) -> DataFrame:
    """Carry the last known value forward, then fill a leading gap from the first known one.

    A row that is still empty after the forward pass has nothing before it, so what it takes
    from behind is the first known value of the whole series: one frame for the partition, and
    no frame that shrinks row by row (quadratic in Spark). ``backward`` copies future values
    into the past; it is the default for parity and can be switched off where that matters.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {}
    for c in columns:
        value = F.last(c, ignorenulls=True).over(past)
        filled[c] = F.coalesce(value, F.first(c, ignorenulls=True).over(whole)) if backward else value
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def combine_daily(
    spine: DataFrame,
    *series: DataFrame,
    keys: Sequence[str] = SERIES,
    backward: bool = True,
) -> DataFrame:
    """Spine plus side series, gaps filled."""
    aligned = left_align(spine, *series)
    values = [c for c in aligned.columns if c not in (*keys, "date")]
    return fill_gaps(aligned, values, keys=keys, backward=backward)


def positions(df: DataFrame, keys: Sequence[str] = SERIES, order: str = "date") -> DataFrame:
    """Zero-based position of each row within its date-grain series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("position", F.row_number().over(w) - 1)


def recent_rows(df: DataFrame, n: int, keys: Sequence[str] = SERIES, order: str = "date") -> DataFrame:
    """The last ``n`` rows of every series.

    A row-number filter of this shape becomes a group limit before the shuffle, so each task
    ships at most ``n`` rows per series.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= n).drop("_back")


def last_row(df: DataFrame, keys: Sequence[str] = SERIES, order: str = "date") -> DataFrame:
    """The latest row of every series."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def append_future_row(
    df: DataFrame,
    offset_days: int,
    replace: dict[str, Column],
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Append a copy of each series' last row, moved ``offset_days`` on and with values replaced.

    The last row is recognised by having none after it and is emitted twice, so the input is
    evaluated once; a union with its own last row would evaluate it twice.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    marked = df.withColumn("_is_last", F.lead("date").over(w).isNull())
    copies = F.when(F.col("_is_last"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    changed = {"date": S.days_after(F.col("date"), offset_days), **replace}
    future = F.col("_future")
    return marked.withColumn("_future", F.explode(copies)).select(
        *[F.when(future, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns]
    )


def series_profile(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Date range, row count and column count of each series."""
    return df.groupBy(*keys).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
    )
