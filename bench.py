"""Headline benchmark. Prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Every query runs once to warm up
and then BENCH_RUNS times; the best time counts. Results go to a no-op sink, so a time is
scan, compute and shuffle of whole tables.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks.base import manual_inputs, margin_table, market, wide_panel
from checks.catalog import QUERIES
from tideline import params as P
from tideline.operators import ingest, lookback, score, sweep
from tideline.operators.features import feature_history
from tideline.plans import stress


def b1_lookbacks_wide(spark, sf):
    """30-day change, 60-day drawdown, realised vol and percentile of every row."""
    df = lookback.with_realised_vol(ingest.numbered(wide_panel(spark, sf)))
    df = lookback.with_drawdown(lookback.with_pct_change(df, 30, "m1"), 60, "dd60")
    return lookback.with_percentile(df, "pctile")


def b2_composite_history(spark, sf):
    """Assessment of every scope on every date with an observation."""
    return score.assessment_table(
        stress.history(
            market(spark, sf, outages=True), margin_table(spark, sf), manual_inputs(spark, sf)
        )
    )


def b3_thousand_scenarios(spark, sf):
    """A thousand weightings of every assessment, reduced to one line per scope and weighting."""
    keys = list(P.COMPONENTS)
    settings = {
        f"s{i}": {k: float((i * (j + 3)) % 41) for j, k in enumerate(keys)} for i in range(1000)
    }
    features = feature_history(
        market(spark, sf, outages=True), margin_table(spark, sf), manual_inputs(spark, sf)
    )
    return sweep.summary(score.with_scores(features), settings)


BENCHES = {
    "b1_lookbacks_wide": b1_lookbacks_wide,
    "b2_composite_history": b2_composite_history,
    "b3_thousand_scenarios": b3_thousand_scenarios,
    **{
        name: QUERIES[name][0]
        for name in (
            "t2_pct_change_calendar_days", "t5_percentile_of_latest", "t9_rolling_correlation",
            "c15_explanation", "l1_leverage_snapshot",
        )
    },
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        # Rows of these panels are few and costly: keep every core busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, fn in BENCHES.items():
        best = None
        for _ in range(runs + 1):
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_best_seconds", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
