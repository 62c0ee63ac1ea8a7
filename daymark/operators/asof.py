"""As-of join of two event-grain frames: each left row with the latest right row at or before it.

Both sides become one ordered stream and go through the pieces of :mod:`daymark.operators.blocked`:
the union is range-partitioned once by (keys, time, side, ties), so a key or an instant with very many
rows spans several partitions; each piece is reduced to its last right row, what is carried into a
piece is found on those few reduced rows, and the rows of a piece then take the last right row
before them. No pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.operators.blocked import Pieces


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    right_columns: Sequence[str],
    ties: Sequence[str] = (),
    strict: bool = False,
    within: Column | None = None,
    how: str = "left",
) -> DataFrame:
    """``left`` with ``right_columns`` of the latest ``right`` row of the same ``keys``.

    The latest is that of the largest ``time`` not after the left row's (``strict``: before it), among
    equal times the one with the largest ``ties`` (columns of ``right``). ``within`` is an interval:
    a right row older than that is not taken, and no earlier one instead. ``how`` is ``left`` (rows
    without a partner keep nulls) or ``inner``. Rows of either side with a null key or time have no
    partner. ``right_columns`` must have names that ``left`` lacks.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    clash = {c.lower() for c in right_columns} & {c.lower() for c in left.columns}
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    placed = F.lit(True)
    for c in (*keys, time):
        placed = placed & F.col(c).isNotNull()
    order = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] + [F.col(time).alias("_time")]
    tied = F.struct(*ties) if ties else F.struct(F.lit(0).alias("none"))
    # Strict: left rows of an instant come before its right rows.
    sides = {"right": 1, "left": 0} if strict else {"right": 0, "left": 1}
    found = F.struct(F.col(time).alias("_time"), *[F.col(c) for c in right_columns])
    kind = right.select(found.alias("r"), tied.alias("t")).schema
    rows = left.filter(placed).select(
        *order,
        F.lit(sides["left"]).alias("_side"),
        F.lit(None).cast(kind["t"].dataType).alias("_tie"),
        # Any order of left rows will do; the hash lets a crowded instant span partitions.
        F.xxhash64(*left.columns).alias("_spread"),
        F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(kind["r"].dataType).alias("_right"),
    )
    others = right.filter(placed).select(
        *order,
        F.lit(sides["right"]).alias("_side"),
        tied.alias("_tie"),
        F.lit(0).cast("bigint").alias("_spread"),
        F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"),
        found.alias("_right"),
    )
    series = [f"_k{i}" for i in range(len(keys))]
    known = F.when(F.col("_right").isNotNull(), F.struct("_at", "_right"))
    pieces = Pieces(rows.unionByName(others), series, "_time", ["_side", "_tie", "_spread"], [F.max_by("_right", known["_at"]).alias("_last")])
    carried = pieces.reduced.select(*pieces.all, F.last("_last", ignorenulls=True).over(pieces.earlier()).alias("_in"))
    past = Window.partitionBy(*pieces.all).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = pieces.rows.withColumn("_seen", F.last("_right", ignorenulls=True).over(past)).filter(F.col("_left").isNotNull())
    match = F.coalesce(F.col("_seen"), F.col("_in"))
    joined = joined.join(carried, pieces.all).withColumn("_match", match)
    if within is not None:
        joined = joined.withColumn("_match", F.when(F.col("_match._time") >= F.col("_time") - within, F.col("_match")))
    if how == "inner":
        joined = joined.filter(F.col("_match").isNotNull())
    out = joined.select(
        *[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_match")[c].alias(c) for c in right_columns]
    )
    if how == "inner":
        return out
    kinds = {f.name: f.dataType for f in right.schema.fields}
    loose = left.filter(~F.coalesce(placed, F.lit(False))).select(
        "*", *[F.lit(None).cast(kinds[c]).alias(c) for c in right_columns]
    )
    return out.unionByName(loose)
