"""From landed rows to daily observations, and data-quality reports.

``obs``: scope, provider, series, obs_date, value. One row per series and day, no nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import params as P
from tideline.functions.frames import SERIES_KEYS, day_number

DAILY_KEYS = [*SERIES_KEYS, "obs_date"]


def usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def drop_missing(obs: DataFrame) -> DataFrame:
    """Null and NaN rows go; a series without any value vanishes with them."""
    return obs.where(usable(F.col("value")))


def load_bound(obs: DataFrame, first, last) -> DataFrame:
    """Observations of the days ``first`` to ``last``, columns or literals. A panel partitioned by
    month (:func:`sources.tables.save_months`) is read for the months of these days only."""
    inside = obs.where(F.col("obs_date").between(first, last))
    if "obs_month" in obs.columns:
        inside = inside.where(F.col("obs_month").between(F.trunc(first, "month"), F.trunc(last, "month")))
    return inside


def daily(raw: DataFrame, ts_col: str = "obs_ts") -> DataFrame:
    """Floor time stamps to local dates and keep the latest value of each day.

    The aggregation combines on the map side, so a series or day that holds much of the
    input is reduced before the shuffle. Equal time stamps resolve to the larger value,
    which makes a retried task give the same answer.
    """
    stamped = raw.withColumn("obs_date", F.to_date(ts_col))
    return (
        drop_missing(stamped)
        .groupBy(*DAILY_KEYS)
        .agg(F.max(F.struct(F.col(ts_col).alias("ts"), F.col("value").alias("v"))).alias("m"))
        .select(*DAILY_KEYS, F.col("m.v").alias("value"))
    )


def logical_name(provider: Column, symbol: Column) -> Column:
    """Catalog name of a provider symbol, null when it is not in the catalog."""
    pairs = [F.lit(x) for name, prov, sym in P.CATALOG for x in (f"{prov}|{sym}", name)]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws("|", provider, symbol))


def name_series(raw: DataFrame) -> DataFrame:
    """Symbol to logical series name. The catalog is a literal, so nothing is joined, and
    the symbol filter reaches the scan."""
    symbols = [sym for _, _, sym in P.CATALOG]
    return (
        raw.where(F.col("symbol").isin(symbols))
        .withColumn("series", logical_name(F.col("provider"), F.col("symbol")))
        .where(F.col("series").isNotNull())
    )


def missing_series(obs: DataFrame, expected: list[tuple[str, str]] | None = None) -> DataFrame:
    """Catalog series with no value, per scope.

    Collects at most the catalog per scope, as the filter drops every other name first.
    """
    wanted = expected or [(prov, name) for name, prov, _ in P.CATALOG]
    keys = [f"{prov}|{name}" for prov, name in wanted]
    key = F.concat_ws("|", "provider", "series")
    present = (
        drop_missing(obs)
        .select("scope", F.when(key.isin(keys), key).alias("k"))
        .groupBy("scope")
        .agg(F.collect_set("k").alias("have"))
    )
    gone = present.select(
        "scope",
        F.explode(F.array_except(F.array(*map(F.lit, keys)), "have")).alias("k"),
    )
    return gone.select(
        "scope",
        F.split_part("k", F.lit("|"), F.lit(1)).alias("provider"),
        F.split_part("k", F.lit("|"), F.lit(2)).alias("series"),
    )


def replace_series(batch: DataFrame, recovered: DataFrame) -> DataFrame:
    """A recovered series replaces the whole series; the others stay as they are.

    Both inputs are daily, so no key holds more rows than the history has days.
    """
    keys = recovered.select(*SERIES_KEYS).distinct()
    return batch.join(keys, SERIES_KEYS, "left_anti").unionByName(recovered)


def rescaled(value: Column, latest: Column) -> Column:
    """Undo a yield quoted tenfold: judged by the series' latest value only."""
    return F.when(latest > P.YIELD_RESCALE_ABOVE, value / 10.0).otherwise(value)


def rescale_yields(obs: DataFrame, series: list[str]) -> DataFrame:
    """Snapshot form of :func:`rescaled`: one decision per series from its last value."""
    last = (
        obs.where(F.col("series").isin(series))
        .groupBy(*SERIES_KEYS)
        .agg(F.max_by("value", "obs_date").alias("latest"))
    )
    return (
        obs.where(F.col("series").isin(series))
        .join(last, SERIES_KEYS)
        .select(*DAILY_KEYS, rescaled(F.col("value"), F.col("latest")).alias("value"))
    )


# Series behind the "newest observation" line.
HEADLINE_SERIES = [(P.QUOTES, "USDJPY"), (P.OFFICIAL, "US10Y"), (P.QUOTES, "VIX")]


def freshness(obs: DataFrame) -> DataFrame:
    """Last date of each headline series and the newest of them, per scope."""

    def last_date(provider, series):
        hit = (F.col("provider") == provider) & (F.col("series") == series)
        return F.max(F.when(hit, F.col("obs_date")))

    ends = drop_missing(obs).groupBy("scope").agg(
        *[last_date(p, s).alias(f"{s.lower()}_as_of") for p, s in HEADLINE_SERIES]
    )
    names = [f"{s.lower()}_as_of" for _, s in HEADLINE_SERIES]
    return ends.withColumn("newest", F.greatest(*names))


def feed_status(assessed: DataFrame) -> DataFrame:
    """Which feeds answered and which components are out, per scored row."""
    status = (
        F.when(~F.col("quotes_seen") & ~F.col("official_seen"), "no_data")
        .when(~F.col("quotes_seen"), "quotes_empty")
        .when(F.col("missing") != "", F.concat(F.lit("missing: "), F.col("missing")))
        .otherwise("ok")
    )
    return assessed.select("scope", "as_of", "scenario", status.alias("feed_status"))


def feed_counts(obs: DataFrame) -> DataFrame:
    def rows(provider):
        return F.count_if(F.col("provider") == provider)

    return drop_missing(obs).groupBy("scope").agg(
        rows(P.QUOTES).alias("quote_rows"), rows(P.OFFICIAL).alias("official_rows")
    )


def quality_metrics(catalog: list[tuple[str, str]] | None = None) -> list[Column]:
    """What a feed's status, freshness and missing series need, as aggregates over the panel's raw
    rows: to be attached to the one pass that writes them (``sources.tables.save_months``)."""
    good = usable(F.col("value"))

    def of(provider, series=None):
        hit = good & (F.col("provider") == provider)
        return hit if series is None else hit & (F.col("series") == series)

    return [
        F.count("*").alias("rows"), F.count_if(~good).alias("missing_rows"),
        F.count_if(of(P.QUOTES)).alias("quote_rows"), F.count_if(of(P.OFFICIAL)).alias("official_rows"),
        *[F.max(F.when(of(p, s), F.col("obs_date"))).alias(f"{s.lower()}_as_of") for p, s in HEADLINE_SERIES],
        *[F.count_if(of(p, s)).alias(f"rows_{s}") for s, p, _ in catalog or P.CATALOG],
    ]


def quality_report(metrics: dict) -> dict:
    """Counts, newest headline date, feed status and missing series of one pass's metrics."""
    ends = [metrics[f"{s.lower()}_as_of"] for _, s in HEADLINE_SERIES]
    quotes, official = metrics["quote_rows"] > 0, metrics["official_rows"] > 0
    missing = [k.removeprefix("rows_") for k, v in metrics.items() if k.startswith("rows_") and not v]
    return {
        "rows": metrics["rows"], "missing_rows": metrics["missing_rows"], "quote_rows": metrics["quote_rows"],
        "official_rows": metrics["official_rows"], "newest": max((d for d in ends if d is not None), default=None),
        "feed_status": "no_data" if not quotes and not official else "quotes_empty" if not quotes else f"missing: {', '.join(missing)}" if missing else "ok",
    }


def numbered(obs: DataFrame) -> DataFrame:
    """Add the day number ``n`` the series windows order by."""
    return obs.withColumn("n", day_number("obs_date"))
