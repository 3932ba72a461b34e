"""Number display. Rounding follows the exact binary value, ties to even, as printf does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # 2**27 + 1, splits a double into two halves


def round_exact(value: Column, decimals: int) -> Column:
    """Round to ``decimals`` places by the exact value of the double.

    Spark rounds the shortest decimal text of the double, half up, so it takes 0.15 to 0.2.
    Here the rounding error of ``value * 10**decimals`` is computed exactly and settles
    what looks like a tie.
    """
    base = float(10**decimals)
    x = F.abs(value)
    p = x * base
    high = x * SPLIT - (x * SPLIT - x)
    err = (high * base - p) + (x - high) * base
    whole = F.floor(p).cast("double")
    part = p - whole
    up = (
        (part > 0.5)
        | ((part == 0.5) & (err > 0.0))
        | ((part == 0.5) & (err == 0.0) & (whole % 2.0 == 1.0))
    )
    rounded = F.when(up, whole + 1.0).otherwise(whole) / base
    return F.when(value < 0.0, -rounded).otherwise(rounded)


def fixed(value: Column, decimals: int, signed: bool = False, thousands: bool = False) -> Column:
    flags = ("+" if signed else "") + ("," if thousands else "")
    return F.format_string(f"%{flags}.{decimals}f", round_exact(value, decimals))


def number_text(
    value: Column,
    decimals: int = 2,
    suffix: str = "",
    prefix: str = "",
    signed: bool = False,
    thousands: bool = False,
    missing: str = "—",
) -> Column:
    text = F.concat(
        F.lit(prefix), fixed(value, decimals, signed, thousands), F.lit(suffix)
    )
    return F.when(value.isNull() | F.isnan(value), missing).otherwise(text)


def signal_text(value: Column, decimals: int, signed: bool, suffix: str) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(
        F.concat(fixed(value, decimals, signed), F.lit(suffix))
    )


def tone(value: Column, good_direction: str | None) -> Column:
    """'up' for a welcome move, 'down' for an unwelcome one; zero counts as welcome."""
    if good_direction is None:
        return F.lit("none")
    good = value >= 0.0 if good_direction == "up" else value <= 0.0
    return F.when(value.isNull(), "none").when(good, "up").otherwise("down")
