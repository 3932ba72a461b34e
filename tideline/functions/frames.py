"""Window helpers.

All time windows order by an integer day number, so a frame of ``N`` means ``N`` calendar
days. Observations are daily, hence a partition never has more rows than the history has
days: a hot series or scope cannot grow a partition past that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES_KEYS = ["scope", "provider", "series"]
START = Window.unboundedPreceding


def day_number(date: Column | str) -> Column:
    return F.unix_date(date)


def series_window(keys: list[str] | None = None) -> WindowSpec:
    """One partition per series, ordered by day number ``n``."""
    return Window.partitionBy(*(keys or SERIES_KEYS)).orderBy("n")


def at_or_before(value: Column, w: WindowSpec, days: int) -> Column:
    """Last non-null value observed at least ``days`` calendar days before the row.

    The frame only ever grows at its end, so Spark evaluates it incrementally.
    """
    return F.last(value, ignorenulls=True).over(w.rangeBetween(START, -days))


def so_far(value: Column, w: WindowSpec) -> Column:
    """Last non-null value up to and including the row."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(START, 0))


def trailing_count(value: Column, w: WindowSpec, days: int) -> Column:
    """Non-null values within ``[n - days, n]``, from two incremental frames.

    Equal to ``count(value)`` over the sliding frame, without rescanning it per row.
    """
    upto = F.count(value).over(w.rangeBetween(START, 0))
    before = F.count(value).over(w.rangeBetween(START, -days - 1))
    return upto - before
