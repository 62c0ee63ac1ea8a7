"""Ordered windows over series of any length.

``Window.partitionBy(series).orderBy(time)`` sorts a whole series in one task. That is fine for
a daily series and fatal for raw events, where one series can hold a third of all rows. Here a
series is cut by ranges of its own order:

1. range-partition the rows once by (series, time, ties), sort inside partitions, number the rows
   and write them: a large series, or a single crowded instant, simply spans several partitions;
2. reduce to one row per (series, partition). Running sums over those few rows give the position at
   which each piece starts, and position = start + number inside the piece;
3. block = position // block_rows, and the last ``halo`` rows of a block are copied into the
   next one, so that each block sees all the history its window needs;
4. run the window by (series, block) and drop the copies.

The same steps run at every size. Rows equal in series, time and all ties stay in one partition, so
``ties`` should tell rows apart. A null series key or time is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from daymark.session import materialise

# monotonically_increasing_id() holds the partition above these bits and the row number below.
_ROW_BITS = 33


class Pieces:
    """Rows with ``_part`` and ``_at`` (number inside the partition), and a reduced row per piece.

    Both are written once: partition numbers must not be computed twice, and the running sums never
    scan the input again.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        time: str,
        ties: Sequence[str],
        aggregates: Sequence[Column] = (),
    ) -> None:
        self.keys = list(keys)
        self.all = [*self.keys, "_part"]
        order = [*self.keys, time, *ties]
        numbered = df.repartitionByRange(*order).sortWithinPartitions(*order)
        numbered = numbered.withColumn("_id", F.monotonically_increasing_id())
        self.rows = materialise(
            numbered.withColumns(
                {"_part": F.shiftright("_id", _ROW_BITS), "_at": F.col("_id") % (1 << _ROW_BITS)}
            ).drop("_id"),
            "ranged-rows",
        )
        missing = F.count_if(F.col(time).isNull()).alias("_missing")
        counts = [F.count("*").alias("_n"), F.min("_at").alias("_first"), missing]
        self.reduced = materialise(self.rows.groupBy(*self.all).agg(*counts, *aggregates), "ranged-pieces")
        unplaced = F.col("_missing") > 0
        for key in self.keys:
            unplaced = unplaced | F.col(key).isNull()
        if not self.reduced.filter(unplaced).isEmpty():
            raise ValueError(f"null in {', '.join([*self.keys, time])}: such rows have no place in a series")

    def earlier(self) -> WindowSpec:
        """Pieces of the same series before this one; at most one per partition."""
        w = Window.partitionBy(*self.keys).orderBy("_part")
        return w.rowsBetween(Window.unboundedPreceding, -1)


def global_positions(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """Zero-based ``position`` of every row in its series, by ``time`` then ``ties``."""
    pieces = Pieces(df, keys, time, ties)
    before = F.coalesce(F.sum("_n").over(pieces.earlier()), F.lit(0))
    starts = pieces.reduced.select(*pieces.all, (before - F.col("_first")).alias("_start"))
    return (
        pieces.rows.join(starts, pieces.all)
        .withColumn("position", F.col("_start") + F.col("_at"))
        .select(*df.columns, "position")
    )


def halo_blocks(
    df: DataFrame, keys: Sequence[str], time: str, halo: int, ties: Sequence[str] = (), block_rows: int = 4096
) -> DataFrame:
    """``df`` with ``position``, its block ``_own``, and the last ``halo`` rows of a block again in the next.

    ``_block`` is the block a row is shown in; a copy is a row whose ``_block`` is not its own.
    """
    if block_rows < max(halo, 1):
        raise ValueError("a block must hold at least the halo")
    placed = global_positions(df, keys, time, ties)
    near_end = F.col("position") % block_rows >= block_rows - halo
    shown = F.when(near_end, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    return placed.withColumn("_own", F.floor(F.col("position") / block_rows)).withColumn("_block", F.explode(shown))


def blocked_window(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    apply: Callable[[DataFrame, WindowSpec], DataFrame],
    halo: int,
    ties: Sequence[str] = (),
    block_rows: int = 4096,
) -> DataFrame:
    """Run ``apply`` (which appends columns over a window) for series of any length.

    The window may look at most ``halo`` rows back. Result: the input columns, ``position`` and
    what ``apply`` appended.
    """
    copies = halo_blocks(df, keys, time, halo, ties, block_rows)
    w = Window.partitionBy(*keys, "_block").orderBy("position")
    return apply(copies, w).filter(F.col("_block") == F.col("_own")).drop("_own", "_block")


def blocked_fill(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    ties: Sequence[str] = (),
    backward: bool = True,
) -> DataFrame:
    """Forward fill, then fill of the leading gap, for series of any length.

    Each piece is reduced to its last known value. What is carried into a piece is found on those
    reduced rows, and the first known value of a series by a plain aggregate; only then do the rows
    meet them, piece by piece.
    """

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).alias("_value")))

    latest = [F.max(known(c)).alias(f"_last_{c}") for c in columns]
    earliest = [F.min(known(c)).alias(f"_head_{c}") for c in columns] if backward else []
    pieces = Pieces(df, keys, time, ties, [*latest, *earliest])
    carried = [
        F.last(F.col(f"_last_{c}")["_value"], ignorenulls=True).over(pieces.earlier()).alias(f"_in_{c}") for c in columns
    ]
    context = pieces.reduced.select(*pieces.all, *carried)
    if backward:
        head = {c: F.when(F.col(f"_head_{c}").isNotNull(), F.struct("_part", f"_head_{c}")) for c in columns}
        heads = pieces.reduced.groupBy(*pieces.keys).agg(
            *[F.min(v)[f"_head_{c}"]["_value"].alias(f"_first_{c}") for c, v in head.items()]
        )
        context = context.join(heads, pieces.keys)

    past = Window.partitionBy(*pieces.all).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {}
    for c in columns:
        steps = [F.last(c, ignorenulls=True).over(past), F.col(f"_in_{c}")]
        steps += [F.col(f"_first_{c}")] if backward else []
        filled[c] = F.coalesce(*steps)
    return pieces.rows.join(context, pieces.all).select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns]
    )
