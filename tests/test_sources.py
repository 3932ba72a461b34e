"""Landed files with headers of their own, months of a panel, months of a result."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.helpers import day, frame, random_panel
from tideline import params as P
from tideline.operators import features as FE
from tideline.sources import landing, tables

NAMES = ["USDJPY", "VIX", "VIX3M", "US2Y", "US10Y", "HY_OAS", "WTI", "SPX"]


def cells(df):
    return sorted((r.scope, r.obs_ts.date(), r.symbol, r.value) for r in df.collect() if r.value is not None)


def test_csv_columns_go_by_each_files_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,scope,^VIX,GC=F\n2024-01-02,ALL,20,2400\n2024-01-03,ALL,,2410\n")
    (tmp_path / "b.csv").write_text('﻿GC=F,"^VIX",date,scope\n2420,21,2024-01-04,ALL\nsoon,22,2024-01-05,ALL\n')
    (tmp_path / "c.csv").write_text("date,CL=F\n2024-01-04,75\nno day,76\n")
    (tmp_path / "d d.csv").write_text("^VIX,gc=f,GC=F,date,scope,^VIX\n1,2,3,2024-01-08,EU,4\n")
    (tmp_path / "no_date.csv").write_text("^VIX\n99\n")
    (tmp_path / "empty.csv").write_text("")
    got = landing.read_wide(spark, str(tmp_path), P.QUOTES, fmt="csv", keep=["scope"])
    d = lambda n: dt.date(2024, 1, n)
    rows = sorted((r.scope or "", r.obs_ts and r.obs_ts.date(), r.symbol, r.value) for r in got.collect() if r.value is not None and r.obs_ts)
    assert rows == sorted([
        ("ALL", d(2), "^VIX", 20.0), ("ALL", d(2), "GC=F", 2400.0), ("ALL", d(3), "GC=F", 2410.0),
        ("ALL", d(4), "GC=F", 2420.0), ("ALL", d(4), "^VIX", 21.0), ("ALL", d(5), "^VIX", 22.0),
        ("", d(4), "CL=F", 75.0), ("EU", d(8), "^VIX", 1.0), ("EU", d(8), "gc=f", 2.0), ("EU", d(8), "GC=F", 3.0), ("EU", d(8), "^VIX", 4.0),
    ])
    assert got.where("symbol = 'CL=F' and obs_ts is null").first().value == 76.0
    assert len(landing.header_groups(spark, str(tmp_path))) == 5
    assert landing.read_wide(spark, str(tmp_path / "nowhere"), P.QUOTES, fmt="csv").collect() == []
    assert got.where("provider <> 'yahoo'").isEmpty()


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_parquet_columns_go_by_name(spark, tmp_path, kind):
    """Files with other columns, in another order, and (second run) with another type."""
    a = spark.createDataFrame([("ALL", dt.date(2024, 1, 2), 20.0, 2400.0)], "scope string, date date, `^VIX` double, `GC=F` double")
    b = spark.createDataFrame([(21, dt.date(2024, 1, 3), 75, "ALL")], "`^VIX` bigint, date date, `CL=F` bigint, scope string")
    a.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    b.select(F.col("`^VIX`").cast(kind), "date", F.col("`CL=F`").cast(kind), "scope").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = cells(landing.read_wide(spark, f"{tmp_path}/in", P.QUOTES, keep=["scope"]))
    d = lambda n: dt.date(2024, 1, n)
    assert got == sorted([("ALL", d(2), "^VIX", 20.0), ("ALL", d(2), "GC=F", 2400.0), ("ALL", d(3), "^VIX", 21.0), ("ALL", d(3), "CL=F", 75.0)])


def read_files(df):
    """Files that the plan of ``df`` has read."""
    df.write.format("noop").mode("overwrite").save()
    files = df.select(F.input_file_name().alias("f")).where("f <> ''")
    return {r.f for r in files.distinct().collect()}


def test_bounded_load_reads_its_months_only(spark, tmp_path):
    path = str(tmp_path / "panel")
    obs = frame(spark, random_panel(3, 2200, NAMES))
    two = obs.unionByName(obs.where(F.col("obs_date") < day(1900)).withColumn("scope", F.lit("EU")))
    tables.save_months(two, path)
    panel = tables.load_months(spark, path)
    as_of = day(2000)
    load = landing.within_history(panel, as_of)
    plan = load._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(obs_month" in plan
    months = {f.split("obs_month=")[1][:7] for f in read_files(load)}
    assert min(months) == str(day(2000 - P.HISTORY_DAYS))[:7] and max(months) == str(as_of)[:7] and len(months) == 38
    assert len(list(Path(path).glob("obs_month=*"))) > 70

    inside = two.where(F.col("obs_date").between(day(2000 - P.HISTORY_DAYS), as_of))
    for bounded, cut in (
        (FE.feature_snapshot(panel, as_of, load_days=P.HISTORY_DAYS), FE.feature_snapshot(inside, as_of)),
        (FE.feature_latest(panel, load_days=P.HISTORY_DAYS), FE.feature_latest(
            two.where(F.when(F.col("scope") == "EU", F.col("obs_date") >= day(1899 - P.HISTORY_DAYS)).otherwise(F.col("obs_date") >= day(2199 - P.HISTORY_DAYS))))),
    ):
        order = ["scope"]
        got, want = bounded.orderBy(*order).toPandas(), cut.orderBy(*order).toPandas()
        assert len(want) == 2 and got.astype(str).equals(want.astype(str))
    ends = panel.groupBy("scope").agg(F.max("obs_date").alias("as_of"))
    plan = FE.loads_of(panel, ends, P.HISTORY_DAYS)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert FE.loads_of(panel.where("false"), ends.where("false"), 10).collect() == []


def test_rewriting_a_month_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "result")
    rows = lambda v, months: spark.createDataFrame([("ALL", dt.date(2024, m, d), float(v)) for m in months for d in (3, 9)], "scope string, as_of date, composite double")
    read = lambda: sorted((r.as_of, r.composite) for r in tables.read_result(spark, path).collect())
    tables.write_result(rows(1, [1, 2, 3]), path)
    for _ in range(2):
        tables.write_result(rows(2, [2]), path)
        assert read() == [(dt.date(2024, m, d), 2.0 if m == 2 else 1.0) for m in (1, 2, 3) for d in (3, 9)]
    tables.write_result(rows(3, [5]), path, whole=True)
    assert read() == [(dt.date(2024, 5, d), 3.0) for d in (3, 9)]
