"""SQL for the feature rows and their scores, by windows over the long panel.

Written independently of the Spark plans: long instead of wide, one carry per series and
date, guard counts from row numbers.
"""

from __future__ import annotations

from checks.base import MANUAL_SQL, MARGIN_SQL, base_at, market_sql, pct, r6, w
from checks.q_series import DEBIT, RECORD, STEPS, VOLS, months_back, ranked
from tideline import params as P

CROSSES = ["AUDJPY", "NZDJPY", "MXNJPY", "EURJPY"]
QUOTES = ["USDJPY", *CROSSES, "SPX", "TLT", "VIX", "VIX3M", "MOVE", "WTI", "GOLD", "COPPER",
          "HYG", "LQD", "US10Y_YF", "US30Y_YF"]
OFFICIAL = ["US2Y", "US10Y", "US30Y", "CURVE_10_2", "FED_FUNDS", "HY_OAS", "VIX_FRED",
            "WTI_FRED", "JP10Y_MONTHLY", "JP_OVERNIGHT", "JP3M_MONTHLY"]
FIELDS = ["pct1", "pct7", "pct30", "chg7", "chg30", "chg90", "dd60", "dd365", "vol", "proxy",
          "pctile"]


LEV_FIELDS = ["latest_month", "latest_debit_musd", "yoy_pct", "mom_pct", "pct_of_peak",
              "peak_month", "net_credit_musd", "is_placeholder"]


def high(days, keys="scope, provider, series"):
    return f"max(value) OVER {w(f'RANGE BETWEEN {days} PRECEDING AND CURRENT ROW', keys)}"


def latest_at(left: str, right: str, keys: str, day: str = "n") -> str:
    """SQL: rows of ``left`` (keys, d) with struct ``o``, the last row of ``right`` whose
    ``day`` is at or before ``d``; null when there is none."""
    return f"""(
      SELECT {keys}, d, o FROM (
        SELECT {keys}, d, wanted,
          last_value(o IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY d, wanted
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o
        FROM (SELECT {keys}, d, 1 AS wanted, NULL AS o FROM {left}
              UNION ALL SELECT {keys}, {day}, 0, r FROM {right} r)
      ) WHERE wanted = 1)"""


LOOKBACKS = f"""lb AS MATERIALIZED (
      SELECT scope, series, n, value, rn,
        {pct('value', base_at(1))} AS pct1, {pct('value', base_at(7))} AS pct7,
        {pct('value', base_at(30))} AS pct30, value - {base_at(7)} AS chg7,
        value - {base_at(30)} AS chg30, value - {base_at(90)} AS chg90,
        {pct('value', high(60))} AS dd60, {pct('value', high(365))} AS dd365,
        CASE WHEN rn >= 25 THEN vol END AS vol, proxy
      FROM vols)"""

RANKS = f"""ranks AS MATERIALIZED (
      SELECT scope, series, n,
        CASE WHEN rn >= 25 OR series NOT IN ('WTI', 'WTI_FRED') THEN pctile END AS pctile
      FROM {ranked('k', '''(
        SELECT *, CASE WHEN series IN ('WTI', 'WTI_FRED') THEN round(vol, 8)
                       WHEN series = 'MOVE' THEN value ELSE round(proxy, 8) END AS k
        FROM vols WHERE series IN ('WTI', 'WTI_FRED', 'MOVE', 'US10Y', 'US10Y_YF'))''')}),
    own AS MATERIALIZED (SELECT lb.*, pctile FROM lb LEFT JOIN ranks USING (scope, series, n))"""

PAIRS = f"""ratio0 AS (
      SELECT a.scope, 'quotes' AS provider, 'RATIO' AS series, a.n, a.value / b.value AS value
      FROM panel a JOIN panel b ON a.scope = b.scope AND a.n = b.n
      WHERE a.series = 'HYG' AND b.series = 'LQD'),
    ratios AS MATERIALIZED (
      SELECT scope, n, value, {pct('value', high(180))} AS dd180, pctile
      FROM {ranked('value', 'ratio0')}),
    spreads AS MATERIALIZED (
      SELECT *, {base_at(90, 'ten', 'scope, kind')} AS bten,
             {base_at(90, 'two', 'scope, kind')} AS btwo
      FROM (SELECT a.scope, a.series AS kind, a.n, a.value AS ten, b.value AS two
            FROM panel a JOIN panel b ON a.scope = b.scope AND a.n = b.n
            WHERE a.series IN ('US10Y', 'US10Y_YF') AND b.series = 'US2Y')),
    corrs AS MATERIALIZED (
      SELECT scope, n, CASE WHEN count(*) OVER w60 >= 60 THEN corr(x, y) OVER w60 END AS corr
      FROM (SELECT a.scope, a.n, a.ret AS x, b.ret AS y
            FROM steps a JOIN steps b ON a.scope = b.scope AND a.n = b.n
            WHERE a.series = 'SPX' AND b.series = 'TLT'
              AND a.ret IS NOT NULL AND b.ret IS NOT NULL)
      WINDOW w60 AS (PARTITION BY scope ORDER BY n ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""

LEVERAGE = f"""{RECORD},
    lev AS MATERIALIZED (
      SELECT scope, month, (month - DATE '1970-01-01') AS n, month AS latest_month,
        m.{DEBIT} AS latest_debit_musd,
        {pct('m.' + DEBIT, months_back(12, 'm.' + DEBIT))} AS yoy_pct,
        {pct('m.' + DEBIT, months_back(1, 'm.' + DEBIT))} AS mom_pct,
        rec.debit / nullif(peak, 0) * 100.0::DOUBLE AS pct_of_peak, peak_month,
        CASE WHEN free_credit_cash_musd IS NOT NULL OR free_credit_margin_musd IS NOT NULL
          THEN coalesce(free_credit_cash_musd, 0) + coalesce(free_credit_margin_musd, 0)
               - m.{DEBIT} END AS net_credit_musd,
        bool_or(is_placeholder) OVER {w('', 'scope', 'month')} AS is_placeholder
      FROM margin m JOIN rec USING (scope, month))"""

STATE = f"""cal AS MATERIALIZED (SELECT DISTINCT scope, n AS d FROM panel),
    names AS (SELECT unnest({QUOTES + OFFICIAL}) AS series),
    lastobs AS MATERIALIZED (
      SELECT scope, d, series, o.n AS n, o.value AS value,
        {', '.join(f'o.{f} AS {f}' for f in FIELDS)}
      FROM {latest_at('(SELECT * FROM cal CROSS JOIN names)', 'own', 'scope, series')}),
    guarded AS (SELECT * FROM cal CROSS JOIN
      (SELECT unnest(['US2Y', 'US10Y', 'US30Y', 'US10Y_YF', 'MOVE', 'HY_OAS']) AS series)),
    counted AS (SELECT scope, series, n, rn, n + 1126 AS gone FROM own),
    upto AS (SELECT scope, d, series, o.rn AS rn
             FROM {latest_at('guarded', 'counted', 'scope, series')}),
    older AS (SELECT scope, d, series, o.rn AS rn
              FROM {latest_at('guarded', 'counted', 'scope, series', 'gone')}),
    guards AS MATERIALIZED (
      SELECT u.scope, u.d,
        {', '.join(f"max(coalesce(u.rn, 0) - coalesce(o.rn, 0)) FILTER (WHERE u.series = '{s}') AS k_{s}"
                   for s in ('US2Y', 'US10Y', 'US30Y', 'US10Y_YF', 'MOVE', 'HY_OAS'))}
      FROM upto u LEFT JOIN older o USING (scope, d, series) GROUP BY 1, 2)"""


def _pivot() -> str:
    out = []
    for s in QUOTES + OFFICIAL:
        live = f"series = '{s}' AND d - n <= 1125"
        for f in ["n", "value", *FIELDS]:
            out.append(f"max({f}) FILTER (WHERE {live}) AS {s}_{f}")
    return ", ".join(out)


ASSEMBLY = f"""piv AS MATERIALIZED (SELECT scope, d, {_pivot()} FROM lastobs GROUP BY 1, 2),
    typed AS (
      SELECT scope, max(value) FILTER (WHERE key = 'JP2Y') AS m_JP2Y,
        max(value) FILTER (WHERE key = 'JP10Y') AS m_JP10Y,
        max(value) FILTER (WHERE key = 'BOJ_RATE') AS m_BOJ,
        max(value) FILTER (WHERE key = 'FED_FUNDS') AS m_FED,
        max(source) FILTER (WHERE key = 'JP2Y') AS m_JP2Y_source,
        max(source) FILTER (WHERE key = 'JP10Y') AS m_JP10Y_source
      FROM manual GROUP BY scope),
    j1 AS (SELECT piv.*, coalesce(k_US2Y, 0) AS k_US2Y, coalesce(k_US10Y, 0) AS k_US10Y,
             coalesce(k_US30Y, 0) AS k_US30Y, coalesce(k_US10Y_YF, 0) AS k_US10Y_YF,
             coalesce(k_MOVE, 0) AS k_MOVE, coalesce(k_HY_OAS, 0) AS k_HY_OAS
           FROM piv LEFT JOIN guards USING (scope, d)),
    lr AS {latest_at('cal', 'ratios', 'scope')},
    ls AS {latest_at('cal', "(SELECT * FROM spreads WHERE kind = 'US10Y')", 'scope')},
    ly AS {latest_at('cal', "(SELECT * FROM spreads WHERE kind = 'US10Y_YF')", 'scope')},
    lc AS {latest_at('cal', 'corrs', 'scope')},
    ll AS {latest_at('cal', 'lev', 'scope')},
    j6 AS (SELECT j1.*, lr.o.n AS r_n, lr.o.value AS r_value, lr.o.dd180 AS r_dd180,
             lr.o.pctile AS r_pctile, ls.o.ten AS s_ten, ls.o.two AS s_two,
             ls.o.bten AS s_bten, ls.o.btwo AS s_btwo, ly.o.ten AS y_ten,
             ly.o.two AS y_two, ly.o.bten AS y_bten, ly.o.btwo AS y_btwo,
             lc.o.corr AS corr,
             {', '.join(f'll.o.{f} AS {f}' for f in LEV_FIELDS)}
           FROM j1 LEFT JOIN lr USING (scope, d) LEFT JOIN ls USING (scope, d)
             LEFT JOIN ly USING (scope, d) LEFT JOIN lc USING (scope, d)
             LEFT JOIN ll USING (scope, d)),
    st AS MATERIALIZED (
      SELECT j6.*, typed.* EXCLUDE (scope),
        k_US10Y > 5 AS ten_official,
        CASE WHEN US10Y_YF_value > 20 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS ten_scale,
        CASE WHEN US30Y_YF_value > 20 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS thirty_scale,
        CASE WHEN k_HY_OAS > 30 THEN 'oas'
             WHEN HYG_n IS NOT NULL AND LQD_n IS NOT NULL AND d - r_n <= 1125 THEN 'ratio'
             ELSE 'none' END AS kind,
        CASE WHEN k_MOVE > 60 THEN 'move'
             WHEN k_US10Y > 5 THEN CASE WHEN k_US10Y >= 60 THEN 'proxy' END
             WHEN k_US10Y_YF >= 60 THEN 'proxy_yf' END AS volkind
      FROM j6 LEFT JOIN typed USING (scope))"""

BASE = ", ".join(
    [market_sql(outages=True), STEPS, VOLS, LOOKBACKS, RANKS, PAIRS, MARGIN_SQL, LEVERAGE,
     MANUAL_SQL, STATE, ASSEMBLY]
)


def day(n: str) -> str:
    return f"(DATE '1970-01-01' + ({n})::INTEGER)"


def fallback(field):
    def of(quote, official):
        return (
            f"CASE WHEN {quote}_n IS NOT NULL THEN {quote}_{field} ELSE {official}_{field} END"
        )
    return of


def seed(series, constant):
    return (
        f"CASE WHEN {series}_n IS NOT NULL THEN round({series}_value, 3) "
        f"ELSE {constant}::DOUBLE END"
    )


def seed_source(series, label):
    return (
        f"CASE WHEN {series}_n IS NOT NULL "
        f"THEN '{label}, ' || strftime({day(series + '_n')}, '%b %Y') "
        "ELSE 'built-in fallback (2026-08-02)' END"
    )


def us(tenor, field="value"):
    scale = {"10Y": "ten_scale", "30Y": "thirty_scale"}.get(tenor)
    fall = f"US{tenor}_YF_{field} / {scale}" if scale else "NULL"
    return f"CASE WHEN k_US{tenor} > 5 THEN US{tenor}_{field} ELSE {fall} END"


def curve(published, own, quoted):
    return f"""CASE WHEN CURVE_10_2_n IS NOT NULL THEN {published}
      WHEN k_US2Y > 5 AND ten_official THEN {own}
      WHEN k_US2Y > 5 AND US10Y_YF_n IS NOT NULL THEN {quoted} END"""


# First step: name -> (is double, SQL)
LEVELS: dict[str, tuple[bool, str]] = {"usdjpy": (True, "USDJPY_value")}
LEVELS |= {f"usdjpy_{k}": (True, f"USDJPY_{f}") for k, f in
           (("1d", "pct1"), ("1w", "pct7"), ("1m", "pct30"))}
for _s in CROSSES:
    LEVELS[_s.lower()] = (True, f"{_s}_value")
    for _k, _f in (("1d", "pct1"), ("1w", "pct7"), ("1m", "pct30"), ("dd60", "dd60")):
        LEVELS[f"{_s.lower()}_{_k}"] = (True, f"{_s}_{_f}")
LEVELS["carry_cross_drawdown"] = (True, f"least({', '.join(s + '_dd60' for s in CROSSES)})")
for _t in ("2Y", "10Y", "30Y"):
    LEVELS[f"us{_t.lower()}"] = (True, us(_t))
    LEVELS[f"us{_t.lower()}_1w"] = (True, us(_t, "chg7"))
    _fall = "NULL" if _t == "2Y" else f"CASE WHEN US{_t}_YF_n IS NOT NULL THEN 'US{_t}_YF' END"
    LEVELS[f"us{_t.lower()}_series"] = (
        False, f"CASE WHEN k_US{_t} > 5 THEN 'US{_t}' ELSE {_fall} END")
JP2Y = f"coalesce(m_JP2Y, {seed('JP3M_MONTHLY', 1.2)})"
JP10Y = f"coalesce(m_JP10Y, {seed('JP10Y_MONTHLY', 2.5)})"
US2Y_3M = "CASE WHEN k_US2Y > 5 THEN US2Y_chg90 END"
LEVELS |= {
    "jp2y": (True, JP2Y),
    "jp10y": (True, JP10Y),
    "jp2y_source": (False, f"""CASE WHEN m_JP2Y IS NOT NULL
        THEN coalesce(m_JP2Y_source, 'manual entry')
        ELSE {seed_source('JP3M_MONTHLY', 'seeded from FRED 3-month interbank')} END"""),
    "jp10y_source": (False, f"""CASE WHEN m_JP10Y IS NOT NULL
        THEN coalesce(m_JP10Y_source, 'manual entry')
        ELSE {seed_source('JP10Y_MONTHLY', 'FRED monthly 10-year')} END"""),
    "curve_10_2": (True, curve("CURVE_10_2_value", "s_ten - s_two", "y_ten / ten_scale - y_two")),
    "curve_change_3m": (True, curve(
        "CURVE_10_2_chg90", "(s_ten - s_two) - (s_bten - s_btwo)",
        "(y_ten / ten_scale - y_two) - (y_bten / ten_scale - y_btwo)")),
    "curve_source": (False, curve("'published'", "'spread'", "'spread'")),
    "fed_funds": (True, "CASE WHEN FED_FUNDS_n IS NOT NULL THEN FED_FUNDS_value "
                        "ELSE coalesce(m_FED, 3.6::DOUBLE) END"),
    "boj_rate": (True, f"coalesce(m_BOJ, {seed('JP_OVERNIGHT', 0.85)})"),
    "vix": (True, fallback("value")("VIX", "VIX_FRED")),
    "vix_series": (False, "CASE WHEN VIX_n IS NOT NULL THEN 'VIX' "
                          "WHEN VIX_FRED_n IS NOT NULL THEN 'VIX_FRED' END"),
    "vix3m": (True, "VIX3M_value"),
    "credit_kind": (False, "kind"),
    "wti": (True, fallback("value")("WTI", "WTI_FRED")),
    "wti_1w": (True, fallback("pct7")("WTI", "WTI_FRED")),
    "wti_1m": (True, fallback("pct30")("WTI", "WTI_FRED")),
    "wti_vol": (True, fallback("vol")("WTI", "WTI_FRED")),
    "wti_vol_pctile": (True, fallback("pctile")("WTI", "WTI_FRED")),
    "wti_series": (False, "CASE WHEN WTI_n IS NOT NULL THEN 'WTI' "
                          "WHEN WTI_FRED_n IS NOT NULL THEN 'WTI_FRED' END"),
    "gold": (True, "GOLD_value"), "gold_1w": (True, "GOLD_pct7"),
    "copper": (True, "COPPER_value"), "copper_1w": (True, "COPPER_pct7"),
    "spx": (True, "SPX_value"), "spx_1w": (True, "SPX_pct7"),
    "spx_drawdown": (True, "SPX_dd365"),
    "stock_bond_corr": (True, "CASE WHEN SPX_n IS NOT NULL AND TLT_n IS NOT NULL THEN corr END"),
    "newest": (False, day("greatest(USDJPY_n, US10Y_n, VIX_n)")),
    "quotes_seen": (False, "(" + " OR ".join(f"{s}_n IS NOT NULL" for s in QUOTES) + ")"),
    "official_seen": (False, "(" + " OR ".join(f"{s}_n IS NOT NULL" for s in OFFICIAL) + ")"),
    "margin_latest_month": (False, "latest_month"),
    "margin_latest_debit_musd": (True, "latest_debit_musd"),
    "margin_yoy_pct": (True, "yoy_pct"), "margin_mom_pct": (True, "mom_pct"),
    "margin_pct_of_peak": (True, "pct_of_peak"), "margin_peak_month": (False, "peak_month"),
    "margin_net_credit_musd": (True, "net_credit_musd"),
    "margin_is_placeholder": (False, "coalesce(is_placeholder, true)"),
    "margin_usable": (False, "coalesce(NOT is_placeholder, false)"),
    "diff_2y": (True, f"({us('2Y')}) - ({JP2Y})"),
    "diff_10y": (True, f"({us('10Y')}) - ({JP10Y})"),
    "diff_2y_change_3m": (True, US2Y_3M),
    "policy_gap": (True, "(CASE WHEN FED_FUNDS_n IS NOT NULL THEN FED_FUNDS_value ELSE "
                   f"coalesce(m_FED, 3.6::DOUBLE) END) - coalesce(m_BOJ, {seed('JP_OVERNIGHT', 0.85)})"),
    "rate_vol_level": (True, """CASE volkind WHEN 'move' THEN MOVE_value
        WHEN 'proxy' THEN US10Y_proxy WHEN 'proxy_yf' THEN US10Y_YF_proxy / ten_scale END"""),
    "rate_vol_pctile": (True, """CASE volkind WHEN 'move' THEN MOVE_pctile
        WHEN 'proxy' THEN US10Y_pctile WHEN 'proxy_yf' THEN US10Y_YF_pctile END"""),
    "rate_vol_source": (False, """CASE WHEN volkind = 'move' THEN 'MOVE index (Yahoo)'
        WHEN volkind IS NOT NULL THEN 'proxy: 20d realised vol of 10y yield (annualised bp)'
        ELSE 'unavailable' END"""),
    "vix_ratio": (True, f"nullif({fallback('value')('VIX', 'VIX_FRED')}, 0) / nullif(VIX3M_value, 0)"),
    "credit_source": (False, """CASE kind WHEN 'oas' THEN 'ICE BofA US High Yield OAS (FRED)'
        WHEN 'ratio' THEN 'HYG / LQD price ratio (Yahoo)' ELSE 'unavailable' END"""),
    "hy_oas": (True, "CASE WHEN kind = 'oas' THEN HY_OAS_value END"),
    "hy_oas_change_1m": (True, "CASE WHEN kind = 'oas' THEN HY_OAS_chg30 END"),
    "hyg_lqd_drawdown": (True, "CASE WHEN kind = 'ratio' THEN r_dd180 END"),
    "credit_level": (True, "CASE kind WHEN 'oas' THEN HY_OAS_value WHEN 'ratio' THEN r_value END"),
    "credit_pctile": (True, "CASE WHEN kind = 'ratio' THEN r_pctile END"),
    "margin_pct_of_spx_mktcap": (True, """CASE WHEN SPX_value * 8.4::DOUBLE * 1000 > 0
        THEN latest_debit_musd / (SPX_value * 8.4::DOUBLE * 1000.0::DOUBLE) * 100.0 END"""),
}

FEATURES = BASE + ", feat AS MATERIALIZED (SELECT scope, " + day("d") + " AS as_of, d, " + ", ".join(
    f"{sql} AS {name}" for name, (_, sql) in LEVELS.items()
) + " FROM st)"


def feature_query(names, where: str = "") -> str:
    cols = ", ".join(r6(n) if LEVELS[n][0] else n for n in names)
    return f"WITH {FEATURES} SELECT scope, as_of, {cols} FROM feat {where}"


# --- scoring ---------------------------------------------------------------------------
# signal -> (component, sub-weight, calm, stress, SQL value)
SIGNALS = {
    "usdjpy_1m_pct": ("carry_fx", 0.35, -2.0, -7.0, "usdjpy_1m"),
    "usdjpy_1w_pct": ("carry_fx", 0.40, -1.0, -4.0, "usdjpy_1w"),
    "carry_cross_drawdown_pct": ("carry_fx", 0.25, -2.0, -8.0, "carry_cross_drawdown"),
    "diff_2y_change_3m": ("rate_diff", 0.70, -0.15, -0.75, "diff_2y_change_3m"),
    "diff_2y_level": ("rate_diff", 0.30, 1.0, 4.0, "diff_2y"),
    "rate_vol_pctile": ("rate_vol", 1.0, 60.0, 92.0, "rate_vol_pctile"),
    "curve_steepening_3m": ("curve", 1.0, 0.25, 1.0, "curve_change_3m"),
    "vix_level": ("equity_vol", 0.60, 15.0, 32.0, "vix"),
    "vix_term_structure": ("equity_vol", 0.40, 0.92, 1.05, "vix_ratio"),
    "hy_oas_change_1m": ("credit", 0.60, 0.10, 0.90, "hy_oas_change_1m"),
    "hy_oas_level": ("credit", 0.40, 3.0, 6.0, "hy_oas"),
    "hyg_lqd_drawdown_pct": ("credit", 1.0, -1.0, -5.0, "hyg_lqd_drawdown"),
    "margin_debt_yoy": ("leverage", 0.55, 10.0, 30.0, "CASE WHEN margin_usable THEN margin_yoy_pct END"),
    "margin_debt_vs_peak": ("leverage", 0.45, 90.0, 100.0, "CASE WHEN margin_usable THEN margin_pct_of_peak END"),
    "oil_abs_move_1m": ("commodity", 0.60, 8.0, 25.0, "abs(wti_1m)"),
    "oil_vol_pctile": ("commodity", 0.40, 60.0, 90.0, "wti_vol_pctile"),
}
COMPONENTS = {
    "carry_fx": ("Yen carry / FX stress", 20.0), "rate_diff": ("Rate differentials", 10.0),
    "rate_vol": ("Treasury volatility", 10.0), "curve": ("Yield curve", 5.0),
    "equity_vol": ("Equity volatility", 15.0), "credit": ("Credit spreads", 15.0),
    "leverage": ("Leverage / margin debt", 15.0),
    "commodity": ("Commodity / inflation shock", 10.0),
}
RULE_TEXTS = P.RULE_TEXTS
RULES = {
    "carry_unwind": (70.0, "usdjpy_1w < -2.0 AND diff_2y > 2.0"),
    "vol_backwardation": (66.0, "vix_ratio > 1.0"),
    "credit_crack": (66.0, "hy_oas_change_1m > 1.0"),
    "leverage_at_peak_and_vol_rising": (
        60.0, "margin_usable AND margin_pct_of_peak >= 97.0 AND vix > 22.0"),
}


def lit(x) -> str:
    return f"{x}::DOUBLE"


def level(score: str) -> str:
    return (
        f"CASE WHEN {score} IS NULL THEN 'na' WHEN {score} >= 0.62 THEN 'high' "
        f"WHEN {score} >= 0.34 THEN 'elevated' ELSE 'low' END"
    )


def ramp(v: str, calm: float, stress: float) -> str:
    return (
        f"CASE WHEN ({v}) IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
        f"(({v}) - {lit(calm)}) / {lit(stress - calm)})) END"
    )


def weighted(pairs) -> tuple[str, str]:
    """SQL for (weighted sum, available weight) in a fixed order."""
    used = [(s, wt) for s, wt in pairs]
    num = " + ".join(
        f"CASE WHEN {s} IS NOT NULL AND {wt} > 0 THEN {s} * {wt} ELSE 0.0::DOUBLE END" for s, wt in used)
    den = " + ".join(
        f"CASE WHEN {s} IS NOT NULL AND {wt} > 0 THEN {wt} ELSE 0.0::DOUBLE END" for s, wt in used)
    return f"({num})", f"({den})"


def _component(name, signals):
    num, den = weighted([(f"sig_{s}", lit(v[1])) for s, v in signals.items() if v[0] == name])
    return f"{num} / nullif({den}, 0)"


def scored(signals=SIGNALS, rules=RULES) -> str:
    return FEATURES + ", sg AS (SELECT *, " + ", ".join(
        [f"{v[4]} AS val_{s}" for s, v in signals.items()]
        + [f"{ramp(v[4], v[2], v[3])} AS sig_{s}" for s, v in signals.items()]
        + [f"coalesce({cond}, false) AS rule_{r}" for r, (_, cond) in rules.items()]
    ) + " FROM feat), sc AS MATERIALIZED (SELECT *, " + ", ".join(
        f"{_component(k, signals)} AS comp_{k}" for k in COMPONENTS
    ) + " FROM sg)"


SCORED = scored()


def assessed(scenarios: dict[str, dict[str, float]] | None = None, signals=SIGNALS, rules=RULES, bands=(62, 34)) -> str:
    """CTEs up to ``asmt``: one row per scope, date and scenario."""
    rows = ", ".join(
        "('" + name + "', " + ", ".join(
            lit(float(over.get(k, COMPONENTS[k][1]))) for k in COMPONENTS) + ")"
        for name, over in (scenarios or {"base": {}}).items()
    )
    names = ", ".join(f"w_{k}" for k in COMPONENTS)
    num, den = weighted([(f"comp_{k}", f"w_{k}") for k in COMPONENTS])
    total = " + ".join(f"greatest(w_{k}, 0.0::DOUBLE)" for k in COMPONENTS)
    floor = "greatest(" + ", ".join(
        f"CASE WHEN rule_{r} THEN {lit(f)} ELSE 0.0::DOUBLE END" for r, (f, _) in rules.items()) + ")"
    missing = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN comp_{k} IS NULL THEN '{label}' END" for k, (label, _) in COMPONENTS.items()) + ")"
    fired = " + ".join(f"rule_{r}::BIGINT" for r in rules)
    return scored(signals, rules) + f""", wt(scenario, {names}) AS (VALUES {rows}),
    a1 AS (SELECT sc.*, wt.*, {den} AS avail, {total} AS total_w,
             {num} / nullif({den}, 0) * 100.0::DOUBLE AS mean100 FROM sc CROSS JOIN wt),
    a2 AS (SELECT *, CASE WHEN avail > 0 THEN mean100 ELSE 0.0::DOUBLE END AS base_raw,
             CASE WHEN avail > 0 THEN {floor} ELSE 0.0::DOUBLE END AS floor_,
             CASE WHEN avail > 0 THEN avail / total_w * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS cov_raw,
             CASE WHEN avail > 0 THEN {fired} ELSE 0 END AS rules_fired,
             {missing} AS missing FROM a1),
    a3 AS (SELECT *, greatest(base_raw, floor_) AS composite_raw FROM a2),
    asmt AS MATERIALIZED (SELECT *,
        CASE WHEN NOT avail > 0 THEN 'na' WHEN composite_raw >= {bands[0]} THEN 'high'
             WHEN composite_raw >= {bands[1]} THEN 'elevated' ELSE 'low' END AS regime,
        printf('%.1f', composite_raw)::DOUBLE AS composite,
        printf('%.1f', base_raw)::DOUBLE AS base_composite,
        printf('%.0f', cov_raw)::DOUBLE AS coverage_pct
      FROM a3)"""


ASSESSED = assessed()
