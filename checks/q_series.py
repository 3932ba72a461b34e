"""Time-series operators over the market, supplier and priority panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    MARGIN_SQL, MANUAL_SQL, PRIORITY_SQL, WIDE_SQL, base_at, manual_inputs, margin_table,
    market, market_sql, pct, priority_panel, r6, rounded, w, wide_panel,
)
from checks.registry import query
from tideline.functions import scoring as C
from tideline.operators import ingest, leverage, lookback, pairs

KEY = ["scope", "provider", "series", "obs_date"]
KEYS = "scope, provider, series, obs_date"
MARKET_SQL = market_sql()


def keyed(df, *cols):
    return rounded(df.select(*KEY, *cols))


@query(
    "oil_shock_level",
    f"""WITH {MARKET_SQL}, m AS (
      SELECT scope, obs_date, abs({pct('value', base_at(30))}) AS move
      FROM panel WHERE series = 'WTI'),
    s AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (move - 8.0::DOUBLE) / 17.0::DOUBLE)) AS g
          FROM m)
    SELECT scope, obs_date, {r6('move')}, {r6('CASE WHEN move IS NOT NULL THEN g END', 'score')},
      CASE WHEN move IS NULL THEN 'na' WHEN g >= 0.62 THEN 'high' WHEN g >= 0.34 THEN 'elevated'
           ELSE 'low' END AS level FROM s""",
)
def oil_shock_level(spark, sf):
    obs = ingest.numbered(market(spark, sf).where("series = 'WTI'"))
    move = lookback.with_pct_change(obs, 30, "chg").withColumn("move", F.abs("chg"))
    scored = move.withColumn("score", C.ramp(F.col("move"), 8.0, 25.0))
    return rounded(
        scored.select("scope", "obs_date", "move", "score", C.level_of(F.col("score")).alias("level"))
    )


@query(
    "t1_latest_value",
    f"""WITH {MARKET_SQL}
    SELECT scope, provider, series, {r6('arg_max(value, obs_date)', 'latest')},
      max(obs_date) AS last_date FROM panel GROUP BY 1, 2, 3""",
)
def t1(spark, sf):
    return rounded(lookback.latest(market(spark, sf)))


@query(
    "t2_pct_change_calendar_days",
    f"""WITH {MARKET_SQL} SELECT {KEYS}, {r6(pct('value', base_at(1)), 'd1')},
      {r6(pct('value', base_at(7)), 'w1')}, {r6(pct('value', base_at(30)), 'm1')} FROM panel""",
)
def t2(spark, sf):
    df = ingest.numbered(market(spark, sf))
    for days, out in ((1, "d1"), (7, "w1"), (30, "m1")):
        df = lookback.with_pct_change(df, days, out)
    return keyed(df, "d1", "w1", "m1")


@query(
    "t3_abs_change_calendar_days",
    f"""WITH {MARKET_SQL} SELECT {KEYS}, {r6('value - ' + base_at(7), 'c7')},
      {r6('value - ' + base_at(90), 'c90')} FROM panel""",
)
def t3(spark, sf):
    df = ingest.numbered(market(spark, sf))
    df = lookback.with_abs_change(lookback.with_abs_change(df, 7, "c7"), 90, "c90")
    return keyed(df, "c7", "c90")


def high(days):
    return f"max(value) OVER {w(f'RANGE BETWEEN {days} PRECEDING AND CURRENT ROW')}"


@query(
    "t4_drawdown_from_high",
    f"""WITH {MARKET_SQL} SELECT {KEYS}, {r6(pct('value', high(60)), 'dd60')},
      {r6(pct('value', high(365)), 'dd365')} FROM panel""",
)
def t4(spark, sf):
    df = ingest.numbered(market(spark, sf))
    df = lookback.with_drawdown(lookback.with_drawdown(df, 60, "dd60"), 365, "dd365")
    return keyed(df, "dd60", "dd365")


def ranked(col, src, keys=KEYS + ", n"):
    """SQL: percentile of every row within its trailing window."""
    frame = w("RANGE BETWEEN 1095 PRECEDING AND CURRENT ROW")
    return f"""(SELECT *, CASE WHEN {col} IS NOT NULL AND len(win) >= 30 THEN
        len(list_filter(win, lambda e: e <= {col}))::DOUBLE / len(win)::DOUBLE * 100.0::DOUBLE
      END AS pctile
      FROM (SELECT *, list({col}) FILTER (WHERE {col} IS NOT NULL) OVER {frame} AS win
            FROM {src}))"""


@query(
    "t5_percentile_of_latest",
    f"""WITH {MARKET_SQL} SELECT {KEYS}, {r6('pctile')} FROM {ranked('value', 'panel')}""",
)
def t5(spark, sf):
    df = lookback.with_percentile(ingest.numbered(market(spark, sf)), "pctile")
    return keyed(df, "pctile")


@query(
    "t5_percentile_of_latest_snapshot",
    f"""WITH {MARKET_SQL}, l AS (
      SELECT scope, provider, series, arg_max(value, n) AS latest, max(n) AS last_n
      FROM panel GROUP BY 1, 2, 3)
    SELECT scope, provider, series, {r6('''CASE WHEN count(*) >= 30
        THEN count(*) FILTER (WHERE value <= latest)::DOUBLE / count(*)::DOUBLE * 100.0 END''',
        'percentile')}
    FROM panel JOIN l USING (scope, provider, series) WHERE n >= last_n - 1095
    GROUP BY 1, 2, 3""",
)
def t5_snapshot(spark, sf):
    return rounded(lookback.latest_percentile(ingest.numbered(market(spark, sf))))


ROWS20 = w("ROWS BETWEEN 19 PRECEDING AND CURRENT ROW")
STEPS = f"""steps AS MATERIALIZED (
      SELECT *, value / nullif(pv, 0) - 1.0::DOUBLE AS ret, value - pv AS diff
      FROM (SELECT *, lag(value) OVER {w()} AS pv, row_number() OVER {w()} AS rn FROM panel))"""
VOLS = f"""vols AS MATERIALIZED (
      SELECT *,
        CASE WHEN count(ret) OVER {ROWS20} = 20
             THEN stddev_samp(ret) OVER {ROWS20} * sqrt(252.0::DOUBLE) * 100.0 END AS vol,
        CASE WHEN count(diff) OVER {ROWS20} = 20
             THEN stddev_samp(diff) OVER {ROWS20} * sqrt(252.0::DOUBLE) * 100.0 END AS proxy
      FROM steps)"""


@query(
    "t6_realised_vol",
    f"""WITH {MARKET_SQL}, {STEPS}, {VOLS} SELECT {KEYS}, {r6('vol')},
      {r6('CASE WHEN rn >= 25 THEN vol END', 'vol_now')} FROM vols""",
)
def t6(spark, sf):
    return keyed(lookback.with_realised_vol(ingest.numbered(market(spark, sf))), "vol", "vol_now")


@query(
    "t6_vol_percentile",
    f"""WITH {MARKET_SQL}, {STEPS}, {VOLS}
    SELECT {KEYS}, {r6('CASE WHEN rn >= 25 THEN pctile END', 'vol_pctile')}
    FROM {ranked('k', "(SELECT *, round(vol, 8) AS k FROM vols WHERE series IN ('WTI', 'WTI_FRED'))")}""",
)
def t6_pctile(spark, sf):
    oil = market(spark, sf).where("series in ('WTI', 'WTI_FRED')")
    return keyed(lookback.with_vol_percentile(ingest.numbered(oil)), "vol_pctile")


@query(
    "t7_yield_vol_proxy",
    f"""WITH {MARKET_SQL}, {STEPS}, {VOLS} SELECT {KEYS}, {r6('proxy')},
      {r6('CASE WHEN rn >= 60 THEN proxy END', 'proxy_now')}
    FROM vols WHERE series IN ('US10Y', 'US10Y_YF')""",
)
def t7(spark, sf):
    ten = market(spark, sf).where("series in ('US10Y', 'US10Y_YF')")
    return keyed(lookback.with_vol_proxy(ingest.numbered(ten)), "proxy", "proxy_now")


@query(
    "t8_one_row_return",
    f"WITH {MARKET_SQL}, {STEPS} SELECT {KEYS}, {r6('ret')}, rn FROM steps",
)
def t8(spark, sf):
    return keyed(lookback.with_returns(ingest.numbered(market(spark, sf))), "ret", "rn")


CORR = """joint AS (
      SELECT a.scope, a.obs_date, a.ret AS x, b.ret AS y
      FROM steps a JOIN steps b ON a.scope = b.scope AND a.obs_date = b.obs_date
      WHERE a.series = 'SPX' AND b.series = 'TLT' AND a.ret IS NOT NULL AND b.ret IS NOT NULL)"""
ROWS60 = w("ROWS BETWEEN 59 PRECEDING AND CURRENT ROW", "scope", "obs_date")


@query(
    "t9_rolling_correlation",
    f"""WITH {MARKET_SQL}, {STEPS}, {CORR}
    SELECT scope, obs_date, {r6(f'CASE WHEN count(*) OVER {ROWS60} >= 60 THEN corr(x, y) OVER {ROWS60} END',
                                'corr')} FROM joint""",
)
def t9(spark, sf):
    pair = market(spark, sf).where("series in ('SPX', 'TLT')")
    returns = lookback.with_returns(ingest.numbered(pair))
    return rounded(pairs.rolling_correlation(returns, "SPX", "TLT"))


DEBIT = "debit_balances_musd"


def months_back(k, col=DEBIT):
    frame = f"RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {k} MONTH PRECEDING"
    return f"last_value({col} IGNORE NULLS) OVER {w(frame, 'scope', 'month')}"


@query(
    "t10_pct_change_months",
    f"""WITH {MARGIN_SQL} SELECT scope, month, {r6(pct(DEBIT, months_back(12)), 'yoy_pct')},
      {r6(pct(DEBIT, months_back(1)), 'mom_pct')} FROM margin""",
)
def t10(spark, sf):
    out = leverage.month_changes(margin_table(spark, sf))
    return rounded(out.select("scope", "month", "yoy_pct", "mom_pct"))


@query(
    "t11_pct_change_rows",
    f"""WITH {MARGIN_SQL} SELECT scope, month,
      {r6(pct(DEBIT, f"lag({DEBIT}, 12) OVER {w('', 'scope', 'month')}"), 'yoy_rows_pct')} FROM margin""",
)
def t11(spark, sf):
    out = leverage.month_changes(margin_table(spark, sf))
    return rounded(out.select("scope", "month", "yoy_rows_pct"))


RECORD = f"""rec AS (
      SELECT a.scope, a.month, max(b.{DEBIT}) AS peak,
        min(a.{DEBIT}) AS debit, arg_min(b.month, (-b.{DEBIT}, b.month)) AS peak_month
      FROM margin a JOIN margin b ON a.scope = b.scope AND b.month <= a.month
      GROUP BY 1, 2)"""


@query(
    "t12_record_high",
    f"""WITH {MARGIN_SQL}, {RECORD} SELECT scope, month,
      {r6('debit / nullif(peak, 0) * 100.0', 'pct_of_peak')}, peak_month FROM rec""",
)
def t12(spark, sf):
    out = leverage.leverage_history(margin_table(spark, sf))
    return rounded(out.select("scope", "month", "pct_of_peak", "peak_month"))


SLICE = """cut AS MATERIALIZED (
      SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY scope, provider, series) AS last_n
                     FROM panel) WHERE n >= last_n - {days})"""


@query(
    "t13_display_window",
    f"WITH {MARKET_SQL}, {SLICE.format(days=90)} SELECT {KEYS}, {r6('value')} FROM cut",
)
def t13(spark, sf):
    return keyed(lookback.trailing_slice(ingest.numbered(market(spark, sf)), 90), "value")


@query(
    "t14_indexed_to_100",
    f"""WITH {MARKET_SQL}, {SLICE.format(days=365)}, f AS (
      SELECT *, first_value(value) OVER {w()} AS v0 FROM cut)
    SELECT {KEYS}, {r6('value / v0 * 100.0', 'indexed')} FROM f WHERE v0 <> 0""",
)
def t14(spark, sf):
    return keyed(lookback.indexed(ingest.numbered(market(spark, sf)), 365), "indexed")


@query(
    "t15_sparkline_points",
    f"""WITH {MARKET_SQL}, {SLICE.format(days=90)}, a AS (
      SELECT scope, provider, series, min(value) AS lo, max(value) AS hi, count(*) AS k
      FROM cut GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER {w()} AS i FROM cut)
    SELECT {KEYS}, {r6('(i - 1)::DOUBLE / (k - 1)::DOUBLE', 'x')},
      {r6('CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (value - lo) / (hi - lo) END', 'y')}
    FROM b JOIN a USING (scope, provider, series) WHERE k >= 3""",
)
def t15(spark, sf):
    return rounded(lookback.sparkline_points(ingest.numbered(market(spark, sf)), 90))


def pair_sql(left, right, expr):
    return f"""WITH {MARKET_SQL} SELECT scope, obs_date, {r6(expr, 'value')} FROM (
      SELECT scope, obs_date, max(value) FILTER (WHERE series = '{left}') AS x,
        max(value) FILTER (WHERE series = '{right}') AS y
      FROM panel WHERE series IN ('{left}', '{right}') GROUP BY scope, obs_date)
    WHERE x IS NOT NULL AND y IS NOT NULL"""


@query(
    "t16_pair_ratio",
    f"SELECT 'hyg_lqd' AS pair, * FROM ({pair_sql('HYG', 'LQD', 'x / y')}) UNION ALL "
    f"SELECT 'copper_gold' AS pair, * FROM ({pair_sql('COPPER', 'GOLD', 'x / y')})",
)
def t16(spark, sf):
    obs = market(spark, sf)
    return rounded(
        pairs.ratio(obs, "HYG", "LQD").withColumn("pair", F.lit("hyg_lqd")).unionByName(
            pairs.ratio(obs, "COPPER", "GOLD").withColumn("pair", F.lit("copper_gold"))
        )
    )


@query("t17_pair_spread", pair_sql("US10Y", "US2Y", "x - y"))
def t17(spark, sf):
    return rounded(pairs.spread(market(spark, sf), "US10Y", "US2Y"))


@query(
    "t18_minus_scalar",
    f"""WITH {MARKET_SQL}, {MANUAL_SQL}
    SELECT scope, obs_date, {r6('p.value - m.value', 'value')}
    FROM panel p JOIN manual m USING (scope) WHERE series = 'US2Y' AND key = 'JP2Y'""",
)
def t18(spark, sf):
    out = pairs.minus_scalar(market(spark, sf), "US2Y", manual_inputs(spark, sf), "JP2Y")
    return rounded(out)


@query(
    "t19_worst_of_set",
    f"""WITH {MARKET_SQL}, d AS (SELECT scope, obs_date, {pct('value', high(60))} AS dd FROM panel
      WHERE series IN ('AUDJPY', 'NZDJPY', 'MXNJPY', 'EURJPY'))
    SELECT scope, obs_date, {r6('min(dd)', 'worst_dd60')} FROM d GROUP BY 1, 2""",
)
def t19(spark, sf):
    names = ["AUDJPY", "NZDJPY", "MXNJPY", "EURJPY"]
    obs = market(spark, sf).where(F.col("series").isin(names))
    dd = lookback.with_drawdown(ingest.numbered(obs), 60, "dd60")
    return rounded(lookback.worst_of(dd, names, "dd60", "worst_dd60"))


@query(
    "t20_unit_scaled",
    f"WITH {MARGIN_SQL} SELECT scope, month, {r6(f'{DEBIT} / 1000000.0', 'debit_tn')} FROM margin",
)
def t20(spark, sf):
    out = lookback.scaled(margin_table(spark, sf), DEBIT, 1_000_000.0, "debit_tn")
    return rounded(out.select("scope", "month", "debit_tn"))


@query(
    "wide_panel_lookbacks",
    f"""WITH {WIDE_SQL}, {STEPS}, {VOLS} SELECT {KEYS}, {r6(pct('value', base_at(30)), 'm1')},
      {r6(pct('value', high(60)), 'dd60')}, {r6('vol')}, {r6('pctile')}
    FROM {ranked('value', 'vols')}""",
)
def wide_lookbacks(spark, sf):
    df = lookback.with_realised_vol(ingest.numbered(wide_panel(spark, sf)))
    df = lookback.with_drawdown(lookback.with_pct_change(df, 30, "m1"), 60, "dd60")
    return keyed(lookback.with_percentile(df, "pctile"), "m1", "dd60", "vol", "pctile")


@query(
    "priority_panel_lookbacks",
    f"""WITH {PRIORITY_SQL} SELECT {KEYS}, {r6(pct('value', base_at(30)), 'm1')},
      {r6(pct('value', high(365)), 'dd365')} FROM panel""",
)
def priority_lookbacks(spark, sf):
    df = ingest.numbered(priority_panel(spark, sf))
    df = lookback.with_drawdown(lookback.with_pct_change(df, 30, "m1"), 365, "dd365")
    return keyed(df, "m1", "dd365")
