"""Time-series expressions: lookback changes, drawdown, percentile, volatility.

Each function takes a value column and a window spec (partitioned by series, ordered by day
number) and returns a Column, so several of them share one Window operator and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tideline import params as P
from tideline.functions.frames import START, at_or_before

ANNUAL = math.sqrt(252.0)


def pct_between(value: Column, base: Column) -> Column:
    """Percent change from ``base`` to ``value``; null for a missing or zero base."""
    return (F.try_divide(value, base) - 1.0) * 100.0


def pct_change(value: Column, w: WindowSpec, days: int) -> Column:
    return pct_between(value, at_or_before(value, w, days))


def abs_change(value: Column, w: WindowSpec, days: int) -> Column:
    return value - at_or_before(value, w, days)


def drawdown(value: Column, w: WindowSpec, days: int) -> Column:
    """Percent below the highest value of the trailing window, both ends included."""
    return pct_between(value, F.max(value).over(w.rangeBetween(-days, 0)))


def trailing_values(value: Column, w: WindowSpec, days: int = P.PERCENTILE_DAYS) -> Column:
    """Sign-flipped values of the trailing window, for :func:`percentile_in`."""
    return F.collect_list(F.lit(0.0) - value).over(w.rangeBetween(-days, 0))


def percentile_in(
    flipped: Column, value: Column, min_obs: int = P.PERCENTILE_MIN_OBS
) -> Column:
    """Share of window values ``<= value``, times 100.

    The window arrives sign-flipped, so after an ascending sort on primitive doubles the
    first position of ``-value`` counts the values above it. Sorting stays in generated
    code; a lambda over the array would run interpreted for every element.
    """
    size = F.size(flipped)
    above = F.array_position(F.sort_array(flipped), F.lit(0.0) - value) - 1
    return F.when(
        value.isNotNull() & (size >= min_obs), (size - above) / size.cast("double") * 100.0
    )


def one_row_return(value: Column, previous: Column) -> Column:
    return F.try_divide(value, previous) - 1.0


def rolling_std(step: Column, w: WindowSpec, scale: float, rows: int = P.VOL_ROWS) -> Column:
    """Annualised sample deviation of the last ``rows`` steps; null until the frame is full."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(
        F.count(step).over(frame) == rows, F.stddev_samp(step).over(frame) * (ANNUAL * scale)
    )


def rank_key(deviation: Column) -> Column:
    """A deviation as it is ranked. Windows over the same steps in another order must tie,
    so the last bits, which depend on the order of summing, are dropped."""
    return F.round(deviation, 8)


def realised_vol(ret: Column, w: WindowSpec, rows: int = P.VOL_ROWS) -> Column:
    return rolling_std(ret, w, 100.0, rows)


def difference_vol(diff: Column, w: WindowSpec, rows: int = P.VOL_ROWS) -> Column:
    """Yields are in percent, so a difference times 100 is in basis points."""
    return rolling_std(diff, w, 100.0, rows)


def rolling_corr(x: Column, y: Column, w: WindowSpec, rows: int = P.CORR_ROWS) -> Column:
    """Pearson correlation of the last ``rows`` rows; rows must hold both values."""
    frame = w.rowsBetween(-(rows - 1), 0)
    c = F.corr(x, y).over(frame)
    return F.when((F.count(x).over(frame) >= rows) & ~F.isnan(c), c)


def record_month(value: Column, month: Column, w: WindowSpec) -> Column:
    """Struct of the running record and (negated) day of the first month that set it."""
    return F.max(
        F.when(
            value.isNotNull(),
            F.struct(value.alias("peak"), (-F.unix_date(month)).alias("neg_day")),
        )
    ).over(w.rowsBetween(START, 0))
