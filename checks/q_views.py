"""View tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import feature_sql as S
from checks.base import (
    MANUAL_SQL, MARGIN_SQL, manual_inputs, margin_table, market, market_sql, r6, rounded, table,
)
from checks.q_features import ORDER_CAL, features, order_calendar
from checks.q_score import COMPONENTS_SQL, assessed
from checks.registry import query
from tideline import params as P
from tideline.functions.text import number_text
from tideline.operators import resolved, views
from tideline.plans import stress

A = S.ASSESSED
FEAT = f"WITH {S.FEATURES} "


@query(
    "snapshot_assessment",
    "WITH " + A.replace("panel AS MATERIALIZED (", "panel0 AS MATERIALIZED (", 1)
    .replace("steps AS MATERIALIZED",
             "panel AS MATERIALIZED (SELECT * FROM panel0 WHERE obs_date <= DATE '1999-06-30'), "
             "steps AS MATERIALIZED", 1)
    .replace(S.MARGIN_SQL.split("(", 1)[0], "margin0 AS MATERIALIZED ", 1)
    .replace("rec AS (", "margin AS MATERIALIZED (SELECT * FROM margin0 WHERE month <= DATE "
             "'1999-06-30'), rec AS (", 1)
    .replace("SELECT DISTINCT scope, n AS d FROM panel",
             "SELECT DISTINCT scope, DATE '1999-06-30' - DATE '1970-01-01' AS d FROM panel")
    + f""" SELECT scope, as_of, scenario, {r6('composite_raw')}, {r6('base_raw')}, regime,
      coverage_pct, rules_fired, missing FROM asmt""",
)
def snapshot_assessment(spark, sf):
    """One date, from data cut at that date."""
    rows = stress.snapshot(
        market(spark, sf, outages=True), "1999-06-30", margin_table(spark, sf),
        manual_inputs(spark, sf),
    )
    return rounded(
        rows.select("scope", "as_of", "scenario", "composite_raw", "base_raw", "regime",
                    "coverage_pct", "rules_fired", "missing")
    )


@query(
    "v1_component_bars",
    COMPONENTS_SQL + f"""SELECT scope, as_of, scenario, row_number() OVER (
        PARTITION BY scope, as_of, scenario ORDER BY score IS NULL, -coalesce(score, 0), ordinal) AS rank,
      label, {r6('score')}, level,
      CASE WHEN score IS NULL THEN 'no data'
        ELSE printf('%.0f · w%.0f', score * 100.0::DOUBLE, weight) END AS text FROM comps""",
)
def v1(spark, sf):
    return rounded(views.component_bars(assessed(spark, sf)))


CROSSES_SQL = " UNION ALL ".join(
    f"""SELECT scope, as_of, {i}::BIGINT AS ordinal, '{s}' AS cross_name,
      CASE WHEN {s.lower()} <> 0 THEN printf('%.3f', {s.lower()})::DOUBLE END AS level,
      printf('%.2f', {s.lower()}_1d)::DOUBLE AS d1, printf('%.2f', {s.lower()}_1w)::DOUBLE AS w1,
      printf('%.2f', {s.lower()}_1m)::DOUBLE AS m1, printf('%.2f', {s.lower()}_dd60)::DOUBLE AS dd60,
      CASE WHEN {s.lower()}_dd60 <= -8 THEN 'high' WHEN {s.lower()}_dd60 <= -2 THEN 'elevated'
           ELSE 'low' END AS status FROM feat WHERE {s.lower()} IS NOT NULL"""
    for i, s in enumerate(S.CROSSES)
)


@query(
    "v2_crosses_table",
    FEAT + f"""SELECT scope, as_of, ordinal, cross_name, {r6('level')}, {r6('d1')}, {r6('w1')},
      {r6('m1')}, {r6('dd60')} FROM ({CROSSES_SQL})""",
)
def v2(spark, sf):
    return rounded(views.crosses(features(spark, sf)).drop("status"))


@query("v3_cross_level", FEAT + f"SELECT scope, as_of, cross_name, status FROM ({CROSSES_SQL})")
def v3(spark, sf):
    return views.crosses(features(spark, sf)).select("scope", "as_of", "cross_name", "status")


def alert(name, key, cases, default, known="true"):
    """Register an alert ladder: cases are (condition, level, title)."""
    levels = " ".join(f"WHEN {c} THEN '{lv}'" for c, lv, _ in cases)
    titles = " ".join(f"WHEN {c} THEN '{t}'" for c, _, t in cases)
    end_level, end_title = default if default else (None, None)
    other = f"ELSE '{end_level}'" if default else ""
    other_title = f"ELSE '{end_title}'" if default else ""

    @query(
        name,
        FEAT + f"""SELECT scope, as_of, '{key}' AS alert, CASE {levels} {other} END AS level,
          CASE {titles} {other_title} END AS title FROM feat WHERE coalesce({known}, false)""",
    )
    def run(spark, sf):
        return views.alert_table(features(spark, sf), [key])


alert(
    "v4_carry_alert", "carry",
    [("usdjpy_1w < -2 AND diff_2y > 2", "high", "Carry unwind pattern detected"),
     ("usdjpy_1w < -1", "elevated", "Yen firming")],
    ("low", "No carry unwind signature"),
)
STEEP = "curve_change_3m > 0.25 AND coalesce(curve_10_2, 0) < 0.5"
alert(
    "v5_curve_alert", "curve",
    [(STEEP, "elevated", "Curve steepening from a flat/inverted base")], None, known=STEEP,
)
alert(
    "v6_oil_vol_alert", "oil",
    [("wti_vol_pctile >= 90", "high", "Oil volatility at an extreme"),
     ("wti_vol_pctile >= 60", "elevated", "Oil volatility above normal")],
    ("low", "Oil volatility normal"), known="wti_vol_pctile IS NOT NULL",
)
PEAK, YOY = "margin_pct_of_peak", "margin_yoy_pct"
alert(
    "v7_margin_alert", "margin",
    [(f"{PEAK} >= 99 AND {YOY} >= 25", "high", "Record margin debt, rising fast"),
     (f"{PEAK} >= 95 AND {YOY} >= 15", "elevated", "Leverage building"),
     (f"{YOY} < 0 AND {PEAK} < 95", "elevated", "Leverage contracting from a peak")],
    ("low", "Leverage not at an extreme"),
    known=f"margin_usable AND {PEAK} IS NOT NULL AND {YOY} IS NOT NULL",
)
alert(
    "v9_vix_ratio_alert", "vix_ratio",
    [("vix_ratio > 1.0", "high", "BACKWARDATION — acute near-term stress"),
     ("vix_ratio > 0.95", "elevated", "Flat — the curve is warning")],
    ("low", "Contango — normal"), known="vix_ratio IS NOT NULL",
)
alert(
    "v10_correlation_alert", "correlation",
    [("stock_bond_corr > 0.3", "high", "moving together"),
     ("stock_bond_corr > 0.0", "elevated", "weakly positive"),
     ("stock_bond_corr > -0.3", "elevated", "near zero")],
    ("low", "solidly negative"), known="stock_bond_corr IS NOT NULL",
)


@query(
    "v5_slope_note",
    FEAT + """SELECT scope, as_of, CASE WHEN coalesce(curve_10_2, 0) < 0 THEN 'Inverted'
      ELSE 'Positive' END AS slope FROM feat""",
)
def v5_note(spark, sf):
    return features(spark, sf).select("scope", "as_of", views.slope_note().alias("slope"))


@query(
    "v8_credit_balance_state",
    FEAT + f"""SELECT scope, as_of, {r6('margin_net_credit_musd')},
      CASE WHEN margin_net_credit_musd < 0 THEN 'net borrowers'
           WHEN margin_net_credit_musd >= 0 THEN 'net creditors' END AS state FROM feat""",
)
def v8(spark, sf):
    return rounded(
        features(spark, sf).select(
            "scope", "as_of", "margin_net_credit_musd",
            views.credit_balance_state().alias("state"),
        )
    )


def tone_sql(col, good):
    if good is None:
        return "'none'"
    op = ">=" if good == "up" else "<="
    return f"CASE WHEN {col} IS NULL THEN 'none' WHEN {col} {op} 0 THEN 'up' ELSE 'down' END"


@query(
    "v11_delta_tones",
    FEAT + f"""SELECT scope, as_of, {tone_sql('usdjpy_1d', 'up')} AS usdjpy_1d_tone,
      {tone_sql('hy_oas_change_1m', 'down')} AS hy_oas_tone,
      {tone_sql('margin_yoy_pct', 'down')} AS margin_tone, 'none' AS gold_tone FROM feat""",
)
def v11(spark, sf):
    return views.delta_tones(features(spark, sf))


def num(col, fmt, suffix="", prefix=""):
    return f"CASE WHEN {col} IS NULL THEN '—' ELSE '{prefix}' || printf('{fmt}', {col}) || '{suffix}' END"


def card_sql(i, name, value, comp, sub, deltas, good, fmt="%+.2f", suffix="%", text="NULL"):
    parts = []
    for k in range(1, 4):
        if k <= len(deltas):
            label, col = deltas[k - 1]
            parts.append(f"'{label} ' || {num(col, fmt, suffix)} AS delta_{k}, {tone_sql(col, good)} AS tone_{k}")
        else:
            parts.append(f"NULL::VARCHAR AS delta_{k}, NULL::VARCHAR AS tone_{k}")
    lv = S.level("comp_" + comp)
    return f"""SELECT scope, as_of, scenario, {i}::BIGINT AS ordinal, '{name}' AS card, {value} AS value,
      {lv} AS level, coalesce({text}, CASE {lv} WHEN 'low' THEN 'Low' WHEN 'elevated' THEN 'Elevated'
        WHEN 'high' THEN 'High' ELSE 'No data' END) AS level_text, {sub} AS sub, {', '.join(parts)} FROM asmt"""


DEBT = "margin_latest_debit_musd"
HELD = f"(margin_is_placeholder AND {DEBT} <> 0)"
CARDS_SQL = " UNION ALL ".join([
    card_sql(1, "USDJPY", num("usdjpy", "%.2f"), "carry_fx",
             "'Falling = yen strengthening = carry stress'",
             [("1d", "usdjpy_1d"), ("1w", "usdjpy_1w"), ("1m", "usdjpy_1m")], "up"),
    card_sql(2, "VIX", num("vix", "%.2f"), "equity_vol",
             "CASE WHEN vix_ratio IS NULL THEN '—' WHEN vix_ratio > 1.0 THEN "
             "'Backwardation — acute stress' ELSE 'Contango — normal' END",
             [("VIX/3M", "vix_ratio")], None, "%+.3f", ""),
    card_sql(3, "US–JP 2y differential", num("diff_2y", "%.2f", "pp"), "rate_diff",
             "'Wide = carry fuel · narrowing = exit trigger'", [("3m", "diff_2y_change_3m")],
             None, "%+.2f", "pp"),
    card_sql(4, "High-yield spread",
             f"CASE WHEN credit_kind = 'oas' THEN {num('hy_oas', '%.2f', 'pp')} "
             f"ELSE {num('credit_pctile', '%.0f', 'th pct')} END",
             "credit", "credit_source", [("1m", "hy_oas_change_1m")], "down", "%+.2f", "pp"),
    card_sql(5, "Margin debt",
             f"CASE WHEN {DEBT} <> 0 THEN printf('$%.2fT', {DEBT} / 1000000.0::DOUBLE) ELSE '—' END",
             "leverage",
             f"CASE WHEN {HELD} THEN 'Example figures — replace with FINRA data to score this' "
             "WHEN margin_latest_month IS NOT NULL THEN 'FINRA, ' || strftime(margin_latest_month, '%b %Y') "
             "ELSE '—' END",
             [("YoY", "margin_yoy_pct")], "down", "%+.1f", "%",
             text=f"CASE WHEN {HELD} THEN 'Placeholder' END"),
])


@query("v12_headline_cards", f"WITH {A} {CARDS_SQL}")
def v12(spark, sf):
    return views.headline_cards(assessed(spark, sf))


# Customs of the derived calendar: two series of meetings and a few other days per year.
EVENTS = [
    (f"{y}-{m:02d}-15", "FOMC", "fomc") for y in range(1995, 2002) for m in (1, 3, 6, 9, 12)
] + [
    (f"{y}-{m:02d}-20", "BOJ", "boj") for y in range(1995, 2002) for m in (2, 4, 6, 10)
] + [(f"{y}-08-21", "Symposium", "other") for y in range(1995, 2002)] + [
    ("1998-09-30", "Fiscal year end", "other")
]
EVENTS_SQL = ", ".join(f"(DATE '{d}', '{label}', '{kind}')" for d, label, kind in EVENTS)


@query(
    "v13_event_countdown",
    f"""WITH cal AS ({ORDER_CAL}), ev(event_date, label, kind) AS (VALUES {EVENTS_SQL}),
    up AS (SELECT scope, {S.day('d')} AS as_of, ev.*, row_number() OVER (
             PARTITION BY scope, d, kind ORDER BY event_date, label) AS k
           FROM cal JOIN ev ON event_date >= {S.day('d')}),
    top AS (SELECT *, row_number() OVER (PARTITION BY scope, as_of ORDER BY event_date, label) AS rank
            FROM up WHERE k <= 3 OR kind = 'other')
    SELECT scope, as_of, rank, event_date, event_date - as_of AS days_away, label,
      event_date - as_of <= 14 AS soon FROM top WHERE rank <= 8""",
)
def v13(spark, sf):
    return views.next_events(order_calendar(spark, sf), EVENTS)


@query(
    "v14_number_text",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN '—'
        ELSE '$' || format('{:,.2f}', o_totalprice) || ' total' END AS plain,
      printf('%+.1f', o_totalprice / 1000.0::DOUBLE - 150.0::DOUBLE) || 'k' AS signed
    FROM orders""",
)
def v14(spark, sf):
    orders = table(spark, sf, "orders")
    price = F.expr("if(o_totalprice > 100000, null, o_totalprice)")
    return orders.select(
        "o_orderkey",
        number_text(price, 2, " total", "$", thousands=True).alias("plain"),
        number_text(F.expr("o_totalprice / 1000.0D - 150.0D"), 1, "k", signed=True).alias("signed"),
    )


CUT = """(SELECT *, max(n) OVER (PARTITION BY scope, {key}) AS last_n FROM {src})"""

JP = {"JP2Y": ("JP3M_MONTHLY", 1.20), "JP10Y": ("JP10Y_MONTHLY", 2.50)}
#: Chosen series of the load that ends with the scope's last observation, one row per line and day.
RESOLVED = f"""{market_sql(outages=True)}, {MANUAL_SQL}, ends AS (
      SELECT scope, max(n) AS end_n FROM panel GROUP BY 1),
    held AS (SELECT p.*, end_n FROM panel p JOIN ends USING (scope) WHERE n >= end_n - 1125),
    known AS (SELECT scope,
        {', '.join(f"count(*) FILTER (WHERE series = '{s}') AS n_{s}" for s in (
            'US2Y', 'US10Y', 'US30Y', 'US10Y_YF', 'CURVE_10_2', 'VIX', 'HY_OAS', 'HYG', 'LQD'))},
        {', '.join(f"arg_max(value, n) FILTER (WHERE series = '{s}') AS last_{s}" for s in (
            'US10Y_YF', 'US30Y_YF', 'JP3M_MONTHLY', 'JP10Y_MONTHLY'))}
      FROM held GROUP BY 1),
    typed AS (SELECT scope, {', '.join(
        f"max(value) FILTER (WHERE key = '{k}') AS typed_{k}" for k in JP)} FROM manual GROUP BY 1),
    days AS (SELECT scope, obs_date, n, {', '.join(
        f"max(value) FILTER (WHERE series = '{s}') AS {s}" for s in (
            'USDJPY', 'US2Y', 'US10Y', 'US30Y', 'US10Y_YF', 'US30Y_YF', 'CURVE_10_2', 'VIX', 'VIX_FRED',
            'HY_OAS', 'HYG', 'LQD', 'SPX'))} FROM held GROUP BY 1, 2, 3),
    yields AS (SELECT d.*, k.*, {', '.join(
        f"coalesce(typed_{k}, round(last_{s}, 3), {v}::DOUBLE) AS {k}" for k, (s, v) in JP.items())},
        CASE WHEN n_US2Y > 5 THEN US2Y END AS two,
        {', '.join(f"""CASE WHEN n_US{t} > 5 THEN US{t} WHEN last_US{t}_YF > 20 THEN US{t}_YF / 10.0::DOUBLE
          ELSE US{t}_YF END AS {name}""" for t, name in (('10Y', 'ten'), ('30Y', 'thirty')))}
      FROM days d JOIN known k USING (scope) LEFT JOIN typed USING (scope)),
    lines AS (
      SELECT scope, n, obs_date, unnest(['usdjpy', 'us2y', 'us10y', 'us30y', 'curve_10_2', 'vix', 'credit', 'spx',
          'diff_2y', 'diff_10y']) AS series,
        unnest([USDJPY, two, ten, thirty, CASE WHEN n_CURVE_10_2 > 0 THEN CURVE_10_2 ELSE ten - two END,
          CASE WHEN n_VIX > 0 THEN VIX ELSE VIX_FRED END,
          CASE WHEN n_HY_OAS > 30 THEN HY_OAS WHEN n_HYG > 0 AND n_LQD > 0 THEN HYG / LQD END, SPX,
          two - JP2Y, ten - JP10Y]) AS value
      FROM yields),
    shown AS (SELECT * FROM lines WHERE value IS NOT NULL)"""


def lines(spark, sf):
    return resolved.resolved_series(market(spark, sf, outages=True), manual_inputs(spark, sf))


@query("f_resolved_series", f"WITH {RESOLVED} SELECT scope, series, obs_date, {r6('value')} FROM shown")
def resolved_lines(spark, sf):
    return rounded(lines(spark, sf))


@query(
    "v15_chart_series",
    f"""WITH {RESOLVED}, c AS (SELECT * FROM {CUT.format(key='series', src='shown')}
      WHERE n >= last_n - 365)
    SELECT scope, CASE WHEN series LIKE 'us%y' AND series <> 'usdjpy' THEN 'yields' WHEN series = 'curve_10_2' THEN 'curve'
        WHEN series IN ('vix', 'credit') THEN series ELSE 'index' END AS chart,
      series, obs_date, {r6('value')},
      CASE series WHEN 'curve_10_2' THEN 0.0::DOUBLE WHEN 'vix' THEN 20.0::DOUBLE END AS ref_line
    FROM c WHERE series NOT IN ('usdjpy', 'diff_2y', 'diff_10y')""",
)
def v15(spark, sf):
    return rounded(views.chart_series(lines(spark, sf), 365))


@query(
    "v16_carry_panel",
    f"""WITH {RESOLVED}, c AS (SELECT * FROM {CUT.format(key='series', src='shown')} WHERE n >= last_n - 365)
    SELECT scope, CASE WHEN series = 'usdjpy' THEN 1 ELSE 2 END::BIGINT AS panel,
      CASE series WHEN 'usdjpy' THEN 'USDJPY' WHEN 'diff_2y' THEN '2-year differential'
        ELSE '10-year differential' END AS series, obs_date, {r6('value')}
    FROM c WHERE series IN ('usdjpy', 'diff_2y', 'diff_10y')""",
)
def v16(spark, sf):
    return rounded(views.carry_panel(lines(spark, sf), 365))


@query(
    "v17_margin_bars",
    f"""WITH {MARGIN_SQL} SELECT scope, month, {r6('debit_balances_musd / 1000000.0', 'debit_tn')},
      month = max(month) OVER (PARTITION BY scope) AS is_last FROM margin""",
)
def v17(spark, sf):
    return rounded(views.margin_bars(margin_table(spark, sf)))
