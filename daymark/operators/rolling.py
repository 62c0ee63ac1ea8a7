"""A user's function over rolling windows of series of any length, a block of rows at a time.

Windows that a built-in aggregate or a closed form expresses belong into a ``Window`` expression. For
any other function, the halo blocks of :mod:`daymark.operators.blocked` go to Python as Arrow tables:
one block becomes one matrix with a row per window, and the function sees the whole matrix at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.operators.blocked import halo_blocks

#: Takes windows as rows of a matrix, oldest value first; returns a number for each.
WindowFunction = Callable[[np.ndarray], np.ndarray]


def windows_applied(values: np.ndarray, function: WindowFunction, size: int, lag: int) -> np.ndarray:
    """``function`` of the ``size`` values that end ``lag`` rows before each row; NaN where one is missing."""
    out = np.full(len(values), np.nan)
    first = size - 1 + lag
    if len(values) <= first:
        return out
    matrix = np.lib.stride_tricks.sliding_window_view(values[: len(values) - lag], size)
    whole = ~np.isnan(matrix).any(axis=1)
    if whole.any():
        found = np.asarray(function(matrix[whole]), float)
        if found.shape != (int(whole.sum()),):
            raise ValueError("a window function returns one number for each window")
        out[first:][whole] = found
    return out


def rolling_apply(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    column: str,
    function: WindowFunction,
    size: int,
    name: str,
    lag: int = 0,
    ties: Sequence[str] = (),
    block_rows: int = 4096,
) -> DataFrame:
    """Add ``name``: ``function`` over ``size`` rows of ``column``, the last one ``lag`` rows back.

    Rows are ordered by ``time`` and ``ties`` in their series. A window that is not full, or holds a
    null or NaN, gives null, and so does a function's NaN; infinities reach the function. A null key
    or time is an error. The result has the columns of ``df`` and ``name``.
    """
    if size < 1 or lag < 0:
        raise ValueError("a window has at least one row, none of them ahead")
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    blocks = halo_blocks(df, keys, time, size - 1 + lag, ties, block_rows)
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        values = table.column("_value").combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)
        found = windows_applied(values, function, size, lag)
        own = table.column("_own").to_numpy() == table.column("_block").to_numpy()
        kept = table.select(names).filter(pa.array(own))
        return kept.append_column(name, pa.array(found[own], mask=np.isnan(found[own])))

    return (
        blocks.withColumn("_value", F.col(column).cast("double")).groupBy(*keys, "_block").applyInArrow(one, schema)
    )
