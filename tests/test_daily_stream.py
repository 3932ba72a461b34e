"""The stateful stream gives the panel of a rebuild, whatever the order of files."""

import random

from pyspark.sql import functions as F

from tests.helpers import day, frame, rows
from tideline.streaming import daily, refresh


def land(spark, folder, batches):
    """One file for each (load, kind, rows), rows of (series, day number, hour, value)."""
    for load, kind, points in batches:
        data = [("ALL", "yahoo", s, day(n), None if v is None else float(v), h) for s, n, h, v in points]
        (
            spark.createDataFrame(data, "scope string, provider string, series string, d date, value double, h int")
            .select("scope", "provider", "series", F.expr("cast(d as timestamp_ntz) + make_interval(0, 0, 0, 0, h, 0, 0)").alias("obs_ts"), "value", F.lit(load).cast("bigint").alias("load_id"), F.lit(kind).alias("kind"))
            .coalesce(1).write.mode("append").parquet(folder)
        )


def rebuilt(spark, folder, since):
    landed = spark.read.schema(refresh.LANDING_SCHEMA).parquet(folder)
    days = refresh.landed_days(landed)
    return sorted(tuple(r) for r in refresh.resolved(days, days).where(F.col("obs_date") >= since).collect())


def held(spark, table, since):
    return sorted(tuple(r) for r in daily.current(spark, table).where(F.col("obs_date") >= since).collect())


def test_stream_equals_rebuild_in_any_order(spark, tmp_path):
    rng = random.Random(12)
    point = lambda s, n: (s, n, rng.randrange(24), rng.choice([None, float("nan"), *(round(rng.random(), 3) for _ in range(8))]))
    batches = [(k, rng.choice(["replace", "append", "append"]), [point(rng.choice("AB"), rng.randrange(300)) for _ in range(60)]) for k in range(5)]
    batches += [batches[2], (3, batches[3][1], [("A", 7, 1, 5.0), ("A", 7, 1, 6.0)])]  # a file again, a load in two files
    rng.shuffle(batches)
    landing, table = str(tmp_path / "in"), str(tmp_path / "out")
    start = day(-10)
    for part in (batches[:3], batches[3:]):
        land(spark, landing, part)
        daily.keep_panel(spark, landing, table, max_files=1)
        assert held(spark, table, start) == rebuilt(spark, landing, start)
    daily.keep_panel(spark, landing, table)
    assert held(spark, table, start) == rebuilt(spark, landing, start) != []


def test_days_before_the_window_are_late(spark, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, landing, [(1, "replace", [("A", n, 0, n) for n in range(0, 60, 2)])])
    daily.keep_panel(spark, landing, table, window_days=20)
    land(spark, landing, [(2, "append", [("A", 5, 0, -1), ("A", 51, 0, -2)])])
    daily.keep_panel(spark, landing, table, window_days=20)
    got = {r.obs_date: r.value for r in daily.current(spark, table).collect()}
    assert day(5) not in got and got[day(51)] == -2.0 and got[day(4)] == 4.0
    assert held(spark, table, day(40)) == rebuilt(spark, landing, day(40))
