"""Lagged window features, defined once for every caller.

:func:`add_features` takes any window specification. The same definitions therefore run over
date-grain series (window by series) and over event-grain series cut into blocks
(:mod:`daymark.operators.blocked`). All columns share one specification, which Catalyst plans
as a single exchange, sort and window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from daymark.functions import scalars as S

# Lags and window lengths, in rows.
LAGS = (3, 6, 12, 20)
SPANS = (6, 12, 20)
SAFE_LAG = 3
TREND_SPAN = 12
VOLATILITY_SPAN = 20

# Rows of history the longest feature needs: the safe lag plus a full window ending there.
HALO = SAFE_LAG + max(SPANS) - 1

RAW_FEATURES = ("price", "rate", "fx", "trend_a", "trend_b")
NOT_FEATURES = ("series_id", "date", "year", "target", "n_orders")


class WindowValues:
    """Window expressions over one specification, each computed once and then used by name.

    Catalyst does not merge equal window expressions, so a lag that three features need would
    otherwise be evaluated three times per row.
    """

    def __init__(self, w: WindowSpec) -> None:
        self._w = w
        self.expressions: dict[str, Column] = {}

    def _named(self, name: str, expression: Column) -> Column:
        self.expressions.setdefault(name, expression)
        return F.col(name)

    def _frame(self, rows: int) -> WindowSpec:
        """``rows`` rows ending ``SAFE_LAG`` rows before the current one."""
        return self._w.rowsBetween(-(SAFE_LAG + rows - 1), -SAFE_LAG)

    def lag(self, column: str, k: int) -> Column:
        return self._named(f"{column}_lag{k}", F.lag(column, k).over(self._w))

    def when_full(self, column: str, rows: int, value: Column) -> Column:
        """Null until the frame holds ``rows`` values; a null inside the frame also gives null."""
        count = self._named(f"_{column}_n_{rows}", F.count(column).over(self._frame(rows)))
        return F.when(count == rows, value)

    def mean(self, column: str, rows: int) -> Column:
        return self._named(f"_{column}_mean_{rows}", F.avg(column).over(self._frame(rows)))

    def std(self, column: str, rows: int) -> Column:
        return self._named(f"_{column}_std_{rows}", F.stddev_samp(column).over(self._frame(rows)))


Columns = dict[str, Column]
Builder = Callable[[WindowValues], Columns]


def lags(v: WindowValues, columns: Sequence[str] = ("price", "rate", "fx")) -> Columns:
    return {f"{c}_lag{k}": v.lag(c, k) for c in columns for k in LAGS}


def momentum(v: WindowValues, column: str = "price") -> Columns:
    return {f"momentum_{k}": v.lag(column, SAFE_LAG) - v.lag(column, k) for k in SPANS}


def moving_averages(v: WindowValues, column: str = "price") -> Columns:
    return {f"ma{n}_lag{SAFE_LAG}": v.when_full(column, n, v.mean(column, n)) for n in SPANS}


def rolling_stds(v: WindowValues, column: str = "price") -> Columns:
    return {f"std{n}_lag{SAFE_LAG}": v.when_full(column, n, v.std(column, n)) for n in SPANS}


def _relative_change(v: WindowValues, column: str) -> Column:
    return S.ratio(v.lag(column, SAFE_LAG), v.lag(column, SAFE_LAG + 1)) - 1.0


def price_change(v: WindowValues, column: str = "price") -> Columns:
    return {f"roc_lag{SAFE_LAG}": _relative_change(v, column)}


def rate_change(v: WindowValues, column: str = "rate") -> Columns:
    return {f"rate_change_lag{SAFE_LAG}": v.lag(column, SAFE_LAG) - v.lag(column, SAFE_LAG + 1)}


def fx_change(v: WindowValues, column: str = "fx") -> Columns:
    return {f"fx_change_lag{SAFE_LAG}": _relative_change(v, column)}


def trend_flag(v: WindowValues, column: str = "price") -> Columns:
    """Is the end of the window above its start? Two lags say so, without a function over rows."""
    risen = v.lag(column, SAFE_LAG) > v.lag(column, SAFE_LAG + TREND_SPAN - 1)
    return {f"price_trend_{TREND_SPAN}": v.when_full(column, TREND_SPAN, risen.cast("double"))}


def volatility(v: WindowValues, column: str = "price") -> Columns:
    n = VOLATILITY_SPAN
    return {f"volatility_{n}": v.when_full(column, n, S.ratio(v.std(column, n), v.mean(column, n)))}


def price_lags(v: WindowValues) -> Columns:
    return lags(v, ("price",))


# The 26 engineered columns, and those of them that need the price alone.
ALL_FEATURES: tuple[Builder, ...] = (
    lags,
    momentum,
    moving_averages,
    rolling_stds,
    price_change,
    rate_change,
    fx_change,
    trend_flag,
    volatility,
)
PRICE_FEATURES: tuple[Builder, ...] = (
    price_lags,
    momentum,
    moving_averages,
    rolling_stds,
    price_change,
    trend_flag,
    volatility,
)


def add_features(df: DataFrame, w: WindowSpec, builders: Sequence[Builder] = ALL_FEATURES) -> DataFrame:
    """Append the columns of ``builders`` evaluated over ``w``."""
    values = WindowValues(w)
    columns: Columns = {}
    for build in builders:
        columns.update(build(values))
    windowed = df.select("*", *[e.alias(name) for name, e in values.expressions.items()])
    # A lag is already there under its own name: selecting it as is spares Catalyst an alias.
    wanted = [F.col(name) if name in values.expressions else e.alias(name) for name, e in columns.items()]
    return windowed.select(*df.columns, *wanted)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null or NaN in any column.

    One condition per column. ``na.drop`` would make a single condition over all of them, and
    Catalyst's constraint inference then grows exponentially with the columns renamed later.
    """
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    present = [F.col(c).isNotNull() & ~F.isnan(c) if c in doubles else F.col(c).isNotNull() for c in df.columns]
    return df.filter(reduce(and_, present))


def series_window(keys: Sequence[str] = ("series_id",), order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def engineer(df: DataFrame, keys: Sequence[str] = ("series_id",), order: str = "date") -> DataFrame:
    """Full feature frame; rows with any missing value go (the first 22 of every series).

    Infinite ratios are values, not gaps: they stay and are zeroed before modelling.
    """
    return drop_incomplete(add_features(df, series_window(keys, order)))


def model_columns(df: DataFrame, feature_set: str = "all") -> list[str]:
    """Model inputs: what is left after the key, label and bookkeeping columns.

    ``all`` includes the same-day raw columns, whose day-over-day move is the label itself;
    ``lagged_only`` leaves them out.
    """
    columns = [c for c in df.columns if c not in NOT_FEATURES]
    if feature_set == "all":
        return columns
    if feature_set == "lagged_only":
        return [c for c in columns if c not in RAW_FEATURES]
    raise ValueError(f"unknown feature set {feature_set!r}")
