"""Window operators over long panels: one row in, one row out, per observation.

Input rows carry ``n`` (see ``ingest.numbered``). All operators partition by series; chained
ones share a single shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline import params as P
from tideline.functions import series as S
from tideline.functions.frames import SERIES_KEYS, START, series_window, so_far


def latest(obs: DataFrame) -> DataFrame:
    """Last value and its date, per series; combines on the map side."""
    return obs.groupBy(*SERIES_KEYS).agg(
        F.max_by("value", "obs_date").alias("latest"), F.max("obs_date").alias("last_date")
    )


def with_pct_change(obs: DataFrame, days: int, out: str) -> DataFrame:
    return obs.withColumn(out, S.pct_change(F.col("value"), series_window(), days))


def with_abs_change(obs: DataFrame, days: int, out: str) -> DataFrame:
    return obs.withColumn(out, S.abs_change(F.col("value"), series_window(), days))


def with_drawdown(obs: DataFrame, days: int, out: str) -> DataFrame:
    return obs.withColumn(out, S.drawdown(F.col("value"), series_window(), days))


def with_percentile(
    obs: DataFrame, out: str, col: str = "value", days: int = P.PERCENTILE_DAYS
) -> DataFrame:
    """Percentile of every row in its own trailing window (history form)."""
    window = S.trailing_values(F.col(col), series_window(), days)
    return (
        obs.withColumn("_window", window)
        .withColumn(out, S.percentile_in(F.col("_window"), F.col(col)))
        .drop("_window")
    )


def latest_percentile(obs: DataFrame, days: int = P.PERCENTILE_DAYS) -> DataFrame:
    """Percentile of each series' last value only (snapshot form): two plain aggregates."""
    last = obs.groupBy(*SERIES_KEYS).agg(
        F.max_by("value", "n").alias("latest"), F.max("n").alias("last_n")
    )
    inside = obs.join(last, SERIES_KEYS).where(F.col("n") >= F.col("last_n") - days)
    share = F.avg((F.col("value") <= F.col("latest")).cast("double")) * 100.0
    return inside.groupBy(*SERIES_KEYS).agg(
        F.when(F.count("*") >= P.PERCENTILE_MIN_OBS, share).alias("percentile")
    )


def with_returns(obs: DataFrame) -> DataFrame:
    """Previous value, one-row return and difference, and the row's position ``rn``."""
    w = series_window()
    previous = F.lag("value").over(w)
    return (
        obs.withColumn("previous", previous)
        .withColumn("rn", F.row_number().over(w).cast("bigint"))
        .withColumn("ret", S.one_row_return(F.col("value"), F.col("previous")))
        .withColumn("diff", F.col("value") - F.col("previous"))
    )


def with_realised_vol(obs: DataFrame) -> DataFrame:
    """``vol`` is the distribution member of every row; ``vol_now`` is what a reader at the
    row sees, null until the series has enough observations."""
    vol = S.realised_vol(F.col("ret"), series_window())
    return (
        with_returns(obs)
        .withColumn("vol", vol)
        .withColumn("vol_now", F.when(F.col("rn") >= P.VOL_MIN_OBS, F.col("vol")))
    )


def with_vol_proxy(obs: DataFrame) -> DataFrame:
    """Deviation of yield differences in basis points a year, guarded like a vol."""
    vol = S.difference_vol(F.col("diff"), series_window())
    return (
        with_returns(obs)
        .withColumn("proxy", vol)
        .withColumn("proxy_now", F.when(F.col("rn") >= P.PROXY_MIN_OBS, F.col("proxy")))
    )


def with_vol_percentile(obs: DataFrame) -> DataFrame:
    """Percentile of the latest volatility within its trailing distribution."""
    keyed = with_realised_vol(obs).withColumn("_key", S.rank_key(F.col("vol")))
    ranked = with_percentile(keyed, "vol_pctile", col="_key")
    return ranked.withColumn(
        "vol_pctile", F.when(F.col("rn") >= P.VOL_MIN_OBS, F.col("vol_pctile"))
    ).drop("_key")


def carry_to(obs: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    """Last observation of every series at or before each calendar date, however old.

    Calendar rows join the series' rows by a union; the window carries a struct, so a null
    inside the last observation stays null instead of reviving an older value.
    """
    series = obs.select(*SERIES_KEYS).distinct()
    dates = series.join(calendar, "scope").select(
        *SERIES_KEYS,
        F.unix_date("as_of").alias("n"),
        F.col("as_of"),
        F.lit(None).cast(obs.select(F.struct("n", *columns)).schema[0].dataType).alias("seen"),
    )
    rows = obs.select(
        *SERIES_KEYS,
        "n",
        F.lit(None).cast("date").alias("as_of"),
        F.struct("n", *columns).alias("seen"),
    )
    # Observations sort before the calendar row of the same day.
    w = Window.partitionBy(*SERIES_KEYS).orderBy("n", F.col("as_of").asc_nulls_first())
    carried = rows.unionByName(dates).withColumn("seen", so_far(F.col("seen"), w))
    return carried.where(F.col("as_of").isNotNull() & F.col("seen").isNotNull()).select(
        *SERIES_KEYS,
        "as_of",
        F.date_from_unix_date("seen.n").alias("last_date"),
        *[F.col(f"seen.{c}").alias(c) for c in columns],
    )


def worst_of(obs: DataFrame, series: list[str], column: str, out: str) -> DataFrame:
    """Smallest available value of a column across series, per scope and date."""
    return (
        obs.where(F.col("series").isin(series))
        .groupBy("scope", "obs_date")
        .agg(F.min(column).alias(out))
    )


def trailing_slice(obs: DataFrame, days: int) -> DataFrame:
    """The last ``days`` of each series, counted from that series' own last date."""
    whole = Window.partitionBy(*SERIES_KEYS)
    return (
        obs.withColumn("_last", F.max("n").over(whole))
        .where(F.col("n") >= F.col("_last") - days)
        .drop("_last")
    )


def indexed(obs: DataFrame, days: int) -> DataFrame:
    """Series rebased to 100 at the start of its display window."""
    w = series_window().rowsBetween(START, 0)
    return (
        trailing_slice(obs, days)
        .withColumn("_first", F.first("value").over(w))
        .where(F.col("_first") != 0.0)
        .withColumn("indexed", F.col("value") / F.col("_first") * 100.0)
        .drop("_first")
    )


def sparkline_points(obs: DataFrame, days: int = 90) -> DataFrame:
    """Unit-square points of each series' display window; needs three points."""
    whole = Window.partitionBy(*SERIES_KEYS)
    lo, hi = F.min("value").over(whole), F.max("value").over(whole)
    span = F.col("_hi") - F.col("_lo")
    return (
        trailing_slice(obs, days)
        .withColumn("_rn", F.row_number().over(series_window()))
        .withColumn("_count", F.count("value").over(whole))
        .withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .where(F.col("_count") >= 3)
        .select(
            *SERIES_KEYS,
            "obs_date",
            ((F.col("_rn") - 1) / (F.col("_count") - 1)).alias("x"),
            F.when(span == 0.0, 0.5)
            .otherwise(F.try_divide(F.col("value") - F.col("_lo"), span))
            .alias("y"),
        )
    )


def scaled(df: DataFrame, column: str, factor: float, out: str) -> DataFrame:
    return df.withColumn(out, F.col(column) / factor)
