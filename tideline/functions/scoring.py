"""Row-wise scoring expressions. Nothing here shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline import params as P


def ramp(value: Column, calm: float, stress: float) -> Column:
    """0 at or beyond ``calm``, 1 at or beyond ``stress``, linear between; null stays null."""
    if stress == calm:
        scored = (value >= calm).cast("double")
    else:
        share = (value - calm) / (stress - calm)
        scored = F.when(share < 0.0, 0.0).when(share > 1.0, 1.0).otherwise(share)
    return F.when(value.isNotNull(), scored)


def ramp_between(value: Column, calm: Column, stress: Column) -> Column:
    """:func:`ramp` for thresholds that are columns."""
    share = F.try_divide(value - calm, stress - calm)
    scored = (
        F.when(calm == stress, (value >= stress).cast("double"))
        .when(share < 0.0, 0.0)
        .when(share > 1.0, 1.0)
        .otherwise(share)
    )
    return F.when(value.isNotNull(), scored)


def level_of(score: Column) -> Column:
    return (
        F.when(score.isNull(), "na")
        .when(score >= P.LEVEL_HIGH, "high")
        .when(score >= P.LEVEL_ELEVATED, "elevated")
        .otherwise("low")
    )


def regime_of(composite: Column, high=P.REGIME_HIGH, elevated=P.REGIME_ELEVATED) -> Column:
    return (
        F.when(composite >= high, "high")
        .when(composite >= elevated, "elevated")
        .otherwise("low")
    )


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def available_weight(scores: Sequence[Column], weights: Sequence[Column]) -> Column:
    return total(
        [F.when(s.isNotNull() & (w > 0.0), w).otherwise(0.0) for s, w in zip(scores, weights)]
    )


def weighted_mean(scores: Sequence[Column], weights: Sequence[Column]) -> Column:
    """Mean over the scores that exist and carry weight; null when there is none.

    The terms are added in a fixed order, so a result never depends on partitioning.
    """
    summed = total(
        [
            F.when(s.isNotNull() & (w > 0.0), s * w).otherwise(0.0)
            for s, w in zip(scores, weights)
        ]
    )
    return F.try_divide(summed, available_weight(scores, weights))
