"""Source preference, as-of carry, leverage and feature assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import feature_sql as S
from checks.base import (
    MARGIN_SQL, manual_inputs, margin_table, market, market_sql, r6, rounded, table,
)
from checks.feature_sql import LEVELS, feature_query, latest_at
from checks.registry import query
from tideline.operators import ingest, leverage, lookback, preference
from tideline.operators import resolve as R
from tideline.operators.features import asof_state, feature_history


def untidy(obs):
    """Rows that must not count, beside the panel: another provider's series of the same names,
    and days without a number."""
    other = obs.withColumns({"provider": F.lit("desk"), "value": F.lit(999.0)})
    hole = F.expr("if(day(obs_date) % 2 = 0, double('NaN'), cast(null as double))")
    holes = obs.where("day(obs_date) % 5 = 0").withColumns({"obs_date": F.date_add("obs_date", 1), "value": hole})
    # Only days without an observation of that series, as daily rows are.
    holes = holes.join(obs.select("scope", "provider", "series", "obs_date"), ["scope", "provider", "series", "obs_date"], "left_anti")
    return obs.unionByName(other).unionByName(holes.select(obs.columns))


def inputs(spark, sf):
    return (
        untidy(market(spark, sf, outages=True)), margin_table(spark, sf), manual_inputs(spark, sf)
    )


def features(spark, sf, **options):
    """Feature rows of the outage panel: every fallback is taken on some dates."""
    return feature_history(*inputs(spark, sf), **options)


def register(name, columns):
    @query(name, feature_query(columns))
    def run(spark, sf):
        return rounded(features(spark, sf).select("scope", "as_of", *columns))


CROSS_COLUMNS = [
    c for s in ("audjpy", "nzdjpy", "mxnjpy", "eurjpy")
    for c in (s, f"{s}_1d", f"{s}_1w", f"{s}_1m", f"{s}_dd60")
]
register("a1_feature_history", list(LEVELS))
register("a3_fx_block", ["usdjpy", "usdjpy_1d", "usdjpy_1w", "usdjpy_1m"])
register("a4_cross_block", [*CROSS_COLUMNS, "carry_cross_drawdown"])
register("a5_rates_block", [
    "us2y", "us10y", "us30y", "us2y_1w", "us10y_1w", "us30y_1w", "diff_2y", "diff_10y",
    "diff_2y_change_3m", "curve_10_2", "curve_change_3m",
])
register("a6_commodity_block", [
    "wti", "wti_1w", "wti_1m", "wti_vol", "wti_vol_pctile", "gold", "gold_1w", "copper",
    "copper_1w",
])
register("a7_equity_block", ["spx", "spx_1w", "spx_drawdown", "stock_bond_corr"])
register("a8_credit_block", ["hy_oas", "hy_oas_change_1m", "hyg_lqd_drawdown"])
register("f1_us_yield_source", [
    "us2y", "us10y", "us30y", "us2y_series", "us10y_series", "us30y_series",
])
register("f2_treasury_vol_source", ["rate_vol_level", "rate_vol_pctile", "rate_vol_source"])
register("f3_credit_source", ["credit_kind", "credit_source", "credit_level", "credit_pctile"])
register("f4_vix_term_structure", ["vix", "vix3m", "vix_ratio"])
register("f5_vix_wti_source", ["vix_series", "wti_series", "vix", "wti"])
register("f6_curve_source", ["curve_source", "curve_10_2"])
register("f7_policy_gap", ["fed_funds", "boj_rate", "policy_gap"])
register("f10_differentials", ["diff_2y", "diff_10y"])
register("l3_yoy_mom_as_of", ["margin_latest_month", "margin_yoy_pct", "margin_mom_pct"])
register("l5_share_of_market_cap", ["margin_latest_debit_musd", "margin_pct_of_spx_mktcap"])
register("l7_margin_usable", ["margin_is_placeholder", "margin_usable"])


@query(
    "f8_jp_yield_library_mode",
    f"""WITH {S.FEATURES.split(', feat AS')[0]} SELECT scope, {S.day('d')} AS as_of,
      {r6('m_JP2Y', 'jp2y')}, {r6('coalesce(m_JP10Y, JP10Y_MONTHLY_value)', 'jp10y')},
      CASE WHEN m_JP2Y IS NOT NULL THEN coalesce(m_JP2Y_source, 'manual entry')
           ELSE 'unavailable' END AS jp2y_source,
      CASE WHEN m_JP10Y IS NOT NULL THEN coalesce(m_JP10Y_source, 'manual entry')
           WHEN JP10Y_MONTHLY_n IS NOT NULL
           THEN 'FRED monthly, ' || {S.day('JP10Y_MONTHLY_n')}::VARCHAR
           ELSE 'unavailable' END AS jp10y_source FROM st""",
)
def f8(spark, sf):
    rows = features(spark, sf, seeded=False)
    return rounded(rows.select("scope", "as_of", "jp2y", "jp10y", "jp2y_source", "jp10y_source"))


SEEDS = {
    "JP2Y": ("JP3M_MONTHLY", 1.2, "seeded from FRED 3-month interbank"),
    "JP10Y": ("JP10Y_MONTHLY", 2.5, "FRED monthly 10-year"),
    "BOJ_RATE": ("JP_OVERNIGHT", 0.85, "FRED call money rate"),
}


@query(
    "f9_jp_rate_seeds",
    f"WITH {S.BASE} " + " UNION ALL ".join(
        f"""SELECT scope, {S.day('d')} AS as_of, '{k}' AS key, {r6(S.seed(s, c), 'value')},
        {S.seed_source(s, label)} AS source, {s}_n IS NOT NULL AS is_live FROM st"""
        for k, (s, c, label) in SEEDS.items()
    ),
)
def f9(spark, sf):
    state = asof_state(*inputs(spark, sf))
    seeds = ", ".join(
        f"named_struct('key', '{k}', 'value', {R.seed_value(k)}, 'source', {R.seed_source(k)}, "
        f"'is_live', {R.seed_is_live(k)})"
        for k in R.SEEDS
    )
    return rounded(
        state.selectExpr("scope", "date_from_unix_date(n) as as_of", f"inline(array({seeds}))")
    )


# Order dates per customer nation: a calendar with gaps and days without observations.
def order_calendar(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.explode(
                F.array(F.lit("ALL"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
            ).alias("scope"),
            F.to_date("o_orderdate").alias("as_of"),
        )
        .distinct()
    )


ORDER_CAL = """SELECT DISTINCT scope, (day - DATE '1970-01-01') AS d FROM (
      SELECT unnest(['ALL', 'N' || c_nationkey::VARCHAR]) AS scope, o_orderdate::DATE AS day
      FROM orders JOIN customer ON o_custkey = c_custkey)"""
OWN_CAL = "SELECT DISTINCT scope, n AS d FROM panel"


@query(
    "a2_as_of_carry",
    f"""WITH {market_sql()}, names AS (SELECT DISTINCT scope, provider, series FROM panel),
    cal AS (SELECT scope, provider, series, d FROM ({ORDER_CAL}) JOIN names USING (scope))
    SELECT scope, provider, series, {S.day('d')} AS as_of, {S.day('o.n')} AS last_date,
      {r6('o.value', 'value')} FROM {latest_at('cal', 'panel', 'scope, provider, series')}
    WHERE o IS NOT NULL""",
)
def a2(spark, sf):
    obs = ingest.numbered(market(spark, sf))
    return rounded(lookback.carry_to(obs, order_calendar(spark, sf), ["value"]))


@query(
    "a2_features_on_calendar",
    feature_query(["usdjpy", "usdjpy_1w", "us10y", "wti_vol_pctile", "vix_ratio"]).replace(
        OWN_CAL, ORDER_CAL
    ),
)
def a2_calendar(spark, sf):
    rows = features(spark, sf, calendar=order_calendar(spark, sf))
    return rounded(
        rows.select("scope", "as_of", "usdjpy", "usdjpy_1w", "us10y", "wti_vol_pctile", "vix_ratio")
    )


LEV = f"WITH {MARGIN_SQL}, {S.LEVERAGE} "


@query(
    "l1_leverage_snapshot",
    f"""WITH {MARGIN_SQL}, {S.LEVERAGE}, {market_sql(name='panel')},
    spx AS (SELECT scope, arg_max(value, n) AS spx FROM panel WHERE series = 'SPX' GROUP BY 1),
    last AS (SELECT lev.* FROM lev JOIN (SELECT scope, max(month) AS month FROM lev GROUP BY 1)
             USING (scope, month))
    SELECT scope, month, latest_month, {r6('latest_debit_musd')}, {r6('yoy_pct')},
      {r6('mom_pct')}, {r6('pct_of_peak')}, peak_month, {r6('net_credit_musd')},
      is_placeholder, NOT is_placeholder AS usable,
      {r6('latest_debit_musd / (spx * 8.4::DOUBLE * 1000.0::DOUBLE) * 100.0::DOUBLE', 'pct_of_spx_mktcap')}
    FROM last LEFT JOIN spx USING (scope)""",
)
def l1(spark, sf):
    spx = (
        market(spark, sf).where("series = 'SPX'").groupBy("scope")
        .agg(F.max_by("value", "obs_date").alias("spx"))
    )
    return rounded(leverage.leverage_latest(margin_table(spark, sf), spx))


# One nation has no debit at all, another lacks it in some months.
NO_DEBIT = "(scope = 'N9' or (scope = 'N4' and month(month) = 7))"


@query(
    "l2_missing_debit",
    f"""WITH {MARGIN_SQL}, f AS (
      SELECT scope, month, CASE WHEN {NO_DEBIT} THEN NULL ELSE debit_balances_musd END AS debit,
             is_placeholder FROM margin)
    SELECT scope, month, last_value(CASE WHEN debit IS NOT NULL THEN month END IGNORE NULLS) OVER w AS latest_month,
      {r6('last_value(debit IGNORE NULLS) OVER w', 'latest_debit_musd')},
      bool_or(is_placeholder) OVER w OR last_value(debit IGNORE NULLS) OVER w IS NULL AS is_placeholder,
      NOT bool_or(is_placeholder) OVER w AND last_value(debit IGNORE NULLS) OVER w IS NOT NULL AS usable
    FROM f WINDOW w AS (PARTITION BY scope ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def l2(spark, sf):
    holes = margin_table(spark, sf).withColumn(
        "debit_balances_musd", F.expr(f"if({NO_DEBIT}, null, debit_balances_musd)")
    )
    return rounded(
        leverage.leverage_history(holes).select(
            "scope", "month", "latest_month", "latest_debit_musd", "is_placeholder", "usable"
        )
    )


@query("l4_net_credit", LEV + f"SELECT scope, month, {r6('net_credit_musd')} FROM lev")
def l4(spark, sf):
    out = leverage.leverage_history(margin_table(spark, sf))
    return rounded(out.select("scope", "month", "net_credit_musd"))


@query("l6_placeholder_flag", LEV + "SELECT scope, month, is_placeholder FROM lev")
def l6(spark, sf):
    out = leverage.leverage_history(margin_table(spark, sf))
    return out.select("scope", "month", "is_placeholder")


#: logical, provider, series, priority, min_obs, rescale_above
CANDIDATES = [
    ("us10y", "fred", "US10Y", 1, 6, None), ("us10y", "yahoo", "US10Y_YF", 2, 1, 20.0), ("us2y", "fred", "US2Y", 1, 6, None),
    ("vix", "yahoo", "VIX", 1, 1, None), ("vix", "fred", "VIX_FRED", 2, 1, None),
    ("fear", "yahoo", "MOVE", 1, 61, None), ("fear", "fred", "HY_OAS", 2, 31, None), ("fear", "fred", "VIX_FRED", 3, 1, None),
]


def candidates(spark):
    return spark.createDataFrame(CANDIDATES, preference.CANDIDATES)


CANDIDATES_SQL = "c(logical, provider, series, priority, min_obs, rescale_above) AS (VALUES " + ", ".join(
    f"('{lo}', '{p}', '{s}', {pr}, {mo}, {'NULL' if up is None else up}::DOUBLE)" for lo, p, s, pr, mo, up in CANDIDATES
) + ")"


def preference_sql(calendar: str) -> str:
    """The choice by a join of every date with all that is known of each candidate."""
    return f"""WITH {market_sql(outages=True)}, {CANDIDATES_SQL},
    seen AS (SELECT panel.*, c.* EXCLUDE (provider, series) FROM panel JOIN c USING (provider, series)),
    cal AS (SELECT DISTINCT scope, logical, d FROM ({calendar})),
    st AS (SELECT cal.scope, cal.logical, d, provider, series, priority, min_obs, rescale_above, max(n) AS last_n,
             arg_max(value, n) AS value, count(*) FILTER (WHERE n >= d - 1125) AS n_obs
           FROM cal JOIN seen ON seen.scope = cal.scope AND seen.logical = cal.logical AND n <= d GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY scope, logical, d ORDER BY priority) AS k
          FROM st WHERE n_obs >= min_obs)
    SELECT scope, logical, {S.day('d')} AS as_of, series, priority::BIGINT AS priority, {S.day('last_n')} AS last_date, n_obs,
      {r6('CASE WHEN value > rescale_above THEN value / 10.0 ELSE value END', 'value')} FROM r WHERE k = 1"""


@query("f_preference_table", preference_sql("SELECT scope, logical, n AS d FROM seen"))
def f_preference(spark, sf):
    """Four logical series from one table, one of them of three unlike sources and in no code."""
    return rounded(preference.resolve(market(spark, sf, outages=True), candidates(spark)))


@query(
    "f_preference_on_calendar",
    preference_sql(f"SELECT scope, logical, d FROM ({ORDER_CAL}) JOIN (SELECT DISTINCT scope, logical FROM seen) USING (scope)"),
)
def f_preference_calendar(spark, sf):
    return rounded(preference.resolve(market(spark, sf, outages=True), candidates(spark), order_calendar(spark, sf)))


@query(
    "f_preference_equals_features",
    feature_query(["us10y", "us10y_series", "us2y", "vix", "vix_series"]),
)
def f_preference_features(spark, sf):
    """The table's choices where the feature row makes the same ones."""
    obs = market(spark, sf, outages=True)
    rows = preference.resolve(obs, candidates(spark), obs.select("scope", F.col("obs_date").alias("as_of")))
    pick = lambda k, c: F.max(F.when(F.col("logical") == k, F.col(c)))
    dates = obs.select("scope", F.col("obs_date").alias("as_of")).distinct()
    by_date = rows.groupBy("scope", "as_of").agg(
        pick("us10y", "value").alias("us10y"), pick("us10y", "series").alias("us10y_series"), pick("us2y", "value").alias("us2y"),
        pick("vix", "value").alias("vix"), pick("vix", "series").alias("vix_series"),
    )
    return rounded(dates.join(by_date, ["scope", "as_of"], "left"))
