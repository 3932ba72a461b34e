"""Hand-written edges of the series operators and the readers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import day, frame, rows
from tideline.functions.text import number_text, round_exact
from tideline.operators import ingest, leverage, lookback, pairs
from tideline.sources import landing, margin_csv, tables


def last(df, *cols):
    return df.orderBy(F.desc("obs_date")).select(*cols).first()


def numbered(spark, series, points):
    return ingest.numbered(frame(spark, rows(series, points)))


def test_single_observation(spark):
    df = numbered(spark, "SPX", [(0, 5.0)])
    df = lookback.with_abs_change(lookback.with_pct_change(df, 7, "p"), 7, "c")
    df = lookback.with_percentile(lookback.with_drawdown(df, 60, "dd"), "pc")
    assert tuple(last(df, "p", "c", "dd", "pc")) == (None, None, 0.0, None)


def test_zero_base(spark):
    df = numbered(spark, "SPX", [(0, 0.0), (30, 3.0)])
    df = lookback.with_abs_change(lookback.with_pct_change(df, 30, "p"), 30, "c")
    assert tuple(last(df, "p", "c")) == (None, 3.0)


def test_lookback_on_and_before_the_date(spark):
    on = lookback.with_abs_change(numbered(spark, "SPX", [(0, 1.0), (7, 4.0)]), 7, "c")
    assert last(on, "c")[0] == 3.0
    gap = lookback.with_abs_change(numbered(spark, "SPX", [(0, 1.0), (25, 9.0), (40, 4.0)]), 30, "c")
    assert last(gap, "c")[0] == 3.0


def test_window_edge_counts(spark):
    df = numbered(spark, "SPX", [(0, 400.0), (1, 200.0), (61, 100.0)])
    assert last(lookback.with_drawdown(df, 60, "dd"), "dd")[0] == -50.0


@pytest.mark.parametrize("count,filled", [(29, False), (30, True)])
def test_percentile_guard(spark, count, filled):
    df = numbered(spark, "SPX", [(i, i) for i in range(count)])
    value = last(lookback.with_percentile(df, "pc"), "pc")[0]
    assert value == (100.0 if filled else None)


@pytest.mark.parametrize("count,filled", [(24, False), (25, True)])
def test_vol_guard_is_on_the_row_read(spark, count, filled):
    df = numbered(spark, "WTI", [(i, 100 + (i % 3)) for i in range(count)])
    out = lookback.with_realised_vol(df)
    assert (last(out, "vol_now")[0] is not None) == filled
    # Rows 21 to 24 still belong to the distribution.
    assert out.where("vol is not null").count() == count - 20


def test_record_ties_take_the_first_month(spark):
    m = spark.createDataFrame(
        [("A", dt.date(2024, k, 1), v, None, None, False) for k, v in ((1, 5.0), (2, 9.0), (3, 9.0))],
        margin_csv.MARGIN_SCHEMA,
    )
    out = leverage.leverage_history(m).where("month = '2024-03-01'").first()
    assert out["peak_month"] == dt.date(2024, 2, 1) and out["pct_of_peak"] == 100.0
    assert out["net_credit_musd"] is None


def test_month_end_is_clipped(spark):
    m = spark.createDataFrame(
        [("A", dt.date(2024, 2, 29), 5.0, 1.0, None, False), ("A", dt.date(2024, 3, 31), 6.0, None, 2.0, False)],
        margin_csv.MARGIN_SCHEMA,
    )
    out = leverage.leverage_history(m).where("month = '2024-03-31'").first()
    assert out["mom_pct"] == pytest.approx(20.0)
    assert out["net_credit_musd"] == -4.0


def test_placeholder_row_without_debit_blocks(spark):
    m = spark.createDataFrame(
        [("A", dt.date(2024, 1, 1), 5.0, None, None, False), ("A", dt.date(2024, 2, 1), None, None, None, True)],
        margin_csv.MARGIN_SCHEMA,
    )
    out = {r["month"].month: r for r in leverage.leverage_history(m).collect()}
    assert out[1]["usable"] and not out[2]["usable"] and out[2]["latest_debit_musd"] == 5.0


def test_daily_keeps_the_latest_of_a_hot_day(spark):
    """Half of all rows fall on one series and day; the result is one row for it."""
    hot = spark.range(20_000).selectExpr(
        "'ALL' as scope", "'yahoo' as provider", "'SPX' as series",
        "cast(timestamp_micros(id * 1000000) as timestamp_ntz) as obs_ts", "cast(id as double) as value",
    )
    out = {r["obs_date"]: r["value"] for r in ingest.daily(hot).collect()}
    assert out == {dt.date(1970, 1, 1): 19_999.0}
    plan = ingest.daily(hot)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan  # reduced before the shuffle


def test_rank_ties_of_reordered_windows(spark):
    steps = [1.0, 1.1] * 40
    df = numbered(spark, "WTI", list(enumerate(steps)))
    out = lookback.with_vol_percentile(df).orderBy("n").collect()
    assert out[-1]["vol_pctile"] == out[-3]["vol_pctile"]


def test_pair_keeps_joint_dates_only(spark):
    obs = frame(spark, rows("HYG", [(0, 8.0), (1, 9.0)]) + rows("LQD", [(1, 3.0), (2, 4.0)]))
    assert [tuple(r) for r in pairs.ratio(obs, "HYG", "LQD").collect()] == [("ALL", day(1), 3.0)]


def test_sparkline_flat_and_short(spark):
    obs = ingest.numbered(frame(spark, rows("SPX", [(0, 5), (1, 5), (2, 5)]) + rows("VIX", [(0, 1), (1, 2)])))
    out = lookback.sparkline_points(obs).orderBy("obs_date").collect()
    assert [(r["x"], r["y"]) for r in out] == [(0.0, 0.5), (0.5, 0.5), (1.0, 0.5)]


def test_stale_series_still_counts_and_null_stays(spark):
    obs = ingest.numbered(frame(spark, rows("SPX", [(0, 1.0), (5, 2.0)])))
    obs = obs.withColumn("f", F.when(F.col("n") == F.unix_date(F.lit(day(0))), 7.0))
    calendar = spark.createDataFrame([("ALL", day(45))], "scope string, as_of date")
    got = lookback.carry_to(obs, calendar, ["value", "f"]).first()
    assert (got["value"], got["f"], got["last_date"]) == (2.0, None, day(5))


def test_missing_margin_file_is_empty(spark):
    assert margin_csv.read_margin_csv(spark, "/tmp/no/such/file.csv").count() == 0


def test_margin_csv_repair(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        "# note\n Month , DEBIT_BALANCES_MUSD,extra,is_placeholder\n"
        "2024-02-01,\"1,234\",x,TRUE\n2024-01-01,100.5,x,1 # inline\nsoon,3,x,no\n2024-03,7,x,\n"
    )
    got = {r["month"].month: r for r in margin_csv.read_margin_csv(spark, str(path)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1]["debit_balances_musd"] == 100.5 and got[1]["is_placeholder"]
    assert got[2]["debit_balances_musd"] is None and got[2]["is_placeholder"]
    assert not got[3]["is_placeholder"] and got[3]["free_credit_cash_musd"] is None


def test_missing_month_column_is_empty(spark):
    raw = spark.createDataFrame([("1",)], "debit_balances_musd string")
    assert margin_csv.clean_margin(raw).count() == 0


def test_close_layouts(spark):
    assert landing.close_columns(["date", "Close|A", "Open|A"], ["A"]) == {"Close|A": "A"}
    assert landing.close_columns(["date", "A|Close", "A|Open"], ["A"]) == {"A|Close": "A"}
    assert landing.close_columns(["date", "Open", "Close"], ["A"]) == {"Close": "A"}
    assert landing.close_columns(["date", "Open", "Close"], ["A", "B"]) == {}


@pytest.mark.parametrize(
    "value,decimals", [(0.15, 1), (0.25, 1), (2.5, 0), (3.5, 0), (-2.5, 0), (1.005, 2), (61.96, 1), (-0.04, 1)]
)
def test_rounding_is_by_the_exact_value(spark, value, decimals):
    got = spark.range(1).select(round_exact(F.lit(value), decimals)).first()[0]
    assert got == round(value, decimals)


def test_number_text(spark):
    row = spark.range(1).select(
        number_text(F.lit(1234567.891), 2, "pp", "$", signed=True, thousands=True),
        number_text(F.lit(None).cast("double")), number_text(F.lit(float("nan"))),
        number_text(F.lit(-0.001), 2),
    ).first()
    assert tuple(row) == ("$+1,234,567.89pp", "—", "—", "-0.00")


def test_bucketed_panel_needs_no_shuffle(spark, tmp_path):
    spark.sql(f"create database if not exists panels location '{tmp_path}'")
    obs = frame(spark, rows("SPX", [(i, i) for i in range(50)]) + rows("VIX", [(i, i) for i in range(50)]))
    tables.save_panel(obs, "panels.obs", 4)
    try:
        saved = ingest.numbered(spark.table("panels.obs"))
        plan = lookback.with_pct_change(saved, 7, "w1")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.sql("drop database panels cascade")
