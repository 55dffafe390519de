"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Time formats found in telemetry files beside ISO 8601, tried in this order.
TIME_FORMATS = ("yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


def parse_time(text: Column) -> Column:
    """UTC timestamp from ISO 8601 text or one of the other known formats, NULL if none fits."""
    return F.coalesce(text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def null_if_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def finite(column: Column) -> Column:
    """The value if it is a finite number, else NULL."""
    return F.when(F.abs(column) < F.lit(float("inf")), column)


def greatest_of(columns: Sequence[Column]) -> Column:
    """Greatest of one or more columns, ignoring NULLs."""
    columns = list(columns)
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def total_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def half_even(column: Column, digits: int) -> Column:
    """Rounds halves to even after removing floating-point noise, so that 12.25 and 12.250000000000002 agree."""
    return F.bround(F.round(column, 9), digits)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double, 0 where the denominator is 0."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def stable_id(*parts: Column) -> Column:
    """12 hex characters derived from the parts, so that re-running a job yields the same ids."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12)


def iso(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss")


def as_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long: one row per (ids, column)."""
    return df.select(*ids, *columns).unpivot(list(ids), list(columns), name, value)
