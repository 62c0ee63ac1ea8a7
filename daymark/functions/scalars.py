"""Scalar column helpers. Everything here stays inside the JVM expression tree."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def parse_date(text: Column) -> Column:
    """Text to date; malformed text is an error, as for a required key."""
    return F.to_date(text)


def parse_number(text: Column) -> Column:
    """Text to double, anything non-numeric (for example ``.``) to null."""
    return null_if_nan(text.try_cast("double"))


def epoch_timestamp(seconds: Column) -> Column:
    """Epoch seconds (text or number) to the UTC timestamp, independent of the session zone."""
    whole = seconds.try_cast("bigint")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), whole.cast("decimal(18,6)")
    )


def null_if_nan(value: Column) -> Column:
    """NaN becomes null, the only missing marker used below this point."""
    return F.when(~F.isnan(value), value)


def years_before(day: Column, years: int) -> Column:
    """The same calendar day ``years`` earlier; 29 February is clipped to 28."""
    return F.add_months(day, -12 * years)


def years_back(day: dt.date, years: int) -> dt.date:
    """Like :func:`years_before`, of a plain date."""
    try:
        return day.replace(year=day.year - years)
    except ValueError:
        return day.replace(year=day.year - years, day=28)


def days_after(day: Column, days: Column | int) -> Column:
    return F.date_add(day, days)


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def day_label(offset: Column) -> Column:
    return F.concat(F.lit("Day +"), offset.cast("string"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating division without the ANSI error: x/0 is signed infinity, 0/0 is null."""
    return F.when(denominator != 0, F.try_divide(numerator, denominator)).when(
        denominator == 0,
        F.when(numerator > 0, F.lit(INFINITY)).when(numerator < 0, F.lit(-INFINITY)),
    )


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that answers 0.0 when the denominator is zero (precision and recall)."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and both infinities become 0.0."""
    unusable = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(INFINITY))
    return F.when(unusable, F.lit(0.0)).otherwise(value)


def mapped(value: Column, mapping: Mapping[int, object]) -> Column:
    """Dictionary lookup; keys absent from ``mapping`` give null."""
    result: Column | None = None
    for key, answer in mapping.items():
        hit = value == F.lit(key)
        result = F.when(hit, F.lit(answer)) if result is None else result.when(hit, F.lit(answer))
    return result if result is not None else F.lit(None)


def direction_label(binary: Column) -> Column:
    return mapped(binary, {0: "DOWN", 1: "UP"})


def equal_flag(left: Column, right: Column) -> Column:
    return (left == right).cast("int")
