"""The refresh stream over landed loads, against the assessments of the whole panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import manual_inputs, margin_table, market, market_sql, r6, rounded
from checks.q_ingest import folder
from checks.q_score import A
from checks.registry import query
from tideline.streaming import daily, refresh


def land(obs, path, load_id, kind):
    obs.select(
        "scope", "provider", "series", F.col("obs_date").cast("timestamp_ntz").alias("obs_ts"), "value",
        F.lit(load_id).cast("bigint").alias("load_id"), F.lit(kind).alias("kind"),
    ).write.mode("append").parquet(path)


def held(spark, df, name):
    """A table that several landings and refreshes read, built from the given ones once."""
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sources(spark, sf):
    """The panel, and what gives the margin and manual tables."""
    margin, manual = held(spark, margin_table(spark, sf), "margin"), held(spark, manual_inputs(spark, sf), "manual")
    return held(spark, market(spark, sf, outages=True), "panel"), lambda s: (margin, manual)


@query(
    "r1_refresh",
    f"WITH {A} SELECT scope, as_of, scenario, composite, regime, coverage_pct, rules_fired, missing FROM asmt",
)
def r1(spark, sf):
    """A first load with a wrong series and without the last years; the series again, right; the
    years, one file after another. What is stored then is what a rebuild gives."""
    landing, store = folder(spark, "landing"), folder(spark, "store")
    obs, side = sources(spark, sf)
    early = F.col("obs_date") < F.lit("2000-01-01").cast("date")
    wrong = F.when(F.col("series") == "VIX", F.col("value") * 3).otherwise(F.col("value"))
    land(obs.where(early).withColumn("value", wrong).repartition(3), landing, 1, refresh.REPLACE)
    land(obs.where(early & (F.col("series") == "VIX")), landing, 2, refresh.REPLACE)
    refresh.refresh(spark, landing, store, side, buckets=8)
    land(obs.where(~early).repartition(2), landing, 3, refresh.APPEND)
    refresh.refresh(spark, landing, store, side)
    return refresh.current_assessments(spark, store).select(
        "scope", "as_of", "scenario", "composite", "regime", "coverage_pct", "rules_fired", "missing"
    )


#: The last day that each of the refreshes below lands.
STEPS = ["1997-12-31", "1998-02-10", "1998-06-30", None]


def forward_store(spark, sf):
    """The panel lands up to 1997; then some weeks, then the whole history
    once more with some months added, then the rest."""
    landing, store = folder(spark, "landing"), folder(spark, "store")
    obs, side = sources(spark, sf)
    day = lambda d: F.lit(d).cast("date")

    def land_step(i, kind):
        low, high = None if i == 0 else STEPS[i - 1], STEPS[i]
        part = obs if low is None or kind == refresh.REPLACE else obs.where(F.col("obs_date") > day(low))
        land(part if high is None else part.where(F.col("obs_date") <= day(high)), landing, i + 1, kind)
        refresh.refresh(spark, landing, store, side, buckets=4)

    land_step(0, refresh.REPLACE)
    land_step(1, refresh.APPEND)
    land_step(2, refresh.REPLACE)
    land_step(3, refresh.APPEND)
    return store


@query(
    "r1_delta_forward",
    f"""WITH {A}, landings(after, high) AS (VALUES {", ".join(
        f"(DATE '{STEPS[i - 1] if i else '0001-01-01'}', DATE '{high or '9999-01-01'}')" for i, high in enumerate(STEPS)
    )}), scored AS (
      SELECT scope, high, date_trunc('month', min(obs_date))::DATE AS low FROM panel JOIN landings ON obs_date > after GROUP BY scope, high),
    t AS (SELECT asmt.*, (SELECT count(*) FROM scored s WHERE s.scope = asmt.scope AND as_of BETWEEN low AND high) AS times_scored FROM asmt)
    SELECT scope, as_of, scenario, composite, regime, coverage_pct, rules_fired, missing, times_scored FROM t""",
)
def r1_forward(spark, sf):
    """What the store holds after these refreshes is what a rebuild gives, and each date was scored
    by the refreshes that changed something at or before it in its month or earlier, by no other."""
    store = forward_store(spark, sf)
    keys = ["scope", "as_of", "scenario"]
    times = spark.read.parquet(f"{store}/assessment").groupBy(*keys).agg(F.count("*").alias("times_scored"))
    return refresh.current_assessments(spark, store).join(times, keys).select(
        *keys, "composite", "regime", "coverage_pct", "rules_fired", "missing", "times_scored"
    )


@query(
    "n1_stateful_stream",
    f"WITH {market_sql(outages=True)} SELECT scope, provider, series, obs_date, {r6('value')} FROM panel",
)
def n1_stream(spark, sf):
    """The panel kept by a stateful stream: a load with a wrong series, the series again, the first
    load once more; then newer days, and old files again."""
    landing, out = folder(spark, "landing"), folder(spark, "daily")
    obs = held(spark, market(spark, sf, outages=True), "panel")
    early = F.col("obs_date") < F.lit("1998-01-01").cast("date")
    wrong = obs.where(early).withColumn("value", F.when(F.col("series") == "VIX", F.col("value") * 3).otherwise(F.col("value")))
    right = obs.where(early & (F.col("series") == "VIX"))
    for rows, load in ((wrong, 1), (right, 2), (wrong, 1)):
        land(rows.repartition(3), landing, load, refresh.REPLACE)
    daily.keep_panel(spark, landing, out)
    land(obs.where(~early).repartition(2), landing, 3, refresh.APPEND)
    land(right.repartition(2), landing, 2, refresh.REPLACE)
    daily.keep_panel(spark, landing, out)
    return rounded(daily.current(spark, out))
