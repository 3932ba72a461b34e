"""Operators over two series of one scope.

Two series are aligned by one aggregation on ``(scope, obs_date)`` instead of a join: a
single shuffle, combined on the map side, and no join side that could be skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.functions.frames import day_number


def aligned(obs: DataFrame, left: str, right: str, column: str = "value") -> DataFrame:
    """Dates on which both series have a value: scope, obs_date, x, y."""

    def pick(name):
        return F.max(F.when(F.col("series") == name, F.col(column)))

    return (
        obs.where(F.col("series").isin(left, right))
        .groupBy("scope", "obs_date")
        .agg(pick(left).alias("x"), pick(right).alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def ratio(obs: DataFrame, left: str, right: str) -> DataFrame:
    return (
        aligned(obs, left, right)
        .select("scope", "obs_date", F.try_divide("x", "y").alias("value"))
        .where(F.col("value").isNotNull())
    )


def spread(obs: DataFrame, left: str, right: str) -> DataFrame:
    return aligned(obs, left, right).select(
        "scope", "obs_date", (F.col("x") - F.col("y")).alias("value")
    )


def minus_scalar(obs: DataFrame, series: str, scalars: DataFrame, key: str) -> DataFrame:
    """Series shifted by the scope's scalar input ``key``; scopes without it drop out.

    The scalar is one row per scope. Spark broadcasts that side only if its measured size
    is under the session's limit and otherwise joins by shuffle.
    """
    scalar = scalars.where(F.col("key") == key).select("scope", F.col("value").alias("scalar"))
    return (
        obs.where(F.col("series") == series)
        .join(scalar, "scope")
        .select("scope", "obs_date", (F.col("value") - F.col("scalar")).alias("value"))
    )


def rolling_correlation(returns: DataFrame, left: str, right: str) -> DataFrame:
    """Correlation of the last 60 joint returns. Returns come from each series' own
    calendar; the frame counts only dates that both series have."""
    w = Window.partitionBy("scope").orderBy("n")
    return (
        aligned(returns, left, right, column="ret")
        .withColumn("n", day_number("obs_date"))
        .withColumn("corr", S.rolling_corr(F.col("x"), F.col("y"), w))
        .select("scope", "obs_date", "corr")
    )
