"""Model parameters: catalogs, thresholds, weights, rules, calendar and display texts.

Everything here is a fixed value of the model. The tables are tiny by nature (they are
hand-edited configuration, not data), so operators turn them into literal expressions
instead of joining them.
"""

from __future__ import annotations

# --------------------------------------------------------------------------------------
# Series catalogs, logical name -> provider symbol
# --------------------------------------------------------------------------------------
QUOTE_SYMBOLS = {
    "USDJPY": "USDJPY=X",
    "AUDJPY": "AUDJPY=X",
    "NZDJPY": "NZDJPY=X",
    "MXNJPY": "MXNJPY=X",
    "EURJPY": "EURJPY=X",
    "DXY": "DX-Y.NYB",
    "SPX": "^GSPC",
    "NDX": "^NDX",
    "VIX": "^VIX",
    "VIX3M": "^VIX3M",
    "MOVE": "^MOVE",
    "WTI": "CL=F",
    "GOLD": "GC=F",
    "COPPER": "HG=F",
    "HYG": "HYG",
    "LQD": "LQD",
    "TLT": "TLT",
    "US10Y_YF": "^TNX",
    "US30Y_YF": "^TYX",
    "US05Y_YF": "^FVX",
}

OFFICIAL_SERIES = {
    "US2Y": "DGS2",
    "US10Y": "DGS10",
    "US30Y": "DGS30",
    "CURVE_10_2": "T10Y2Y",
    "FED_FUNDS": "DFF",
    "HY_OAS": "BAMLH0A0HYM2",
    "IG_OAS": "BAMLC0A0CM",
    "VIX_FRED": "VIXCLS",
    "WTI_FRED": "DCOILWTICO",
    "JP10Y_MONTHLY": "IRLTLT01JPM156N",
    "JP_OVERNIGHT": "IRSTCI01JPM156N",
    "JP3M_MONTHLY": "IR3TIB01JPM156N",
}

QUOTES = "yahoo"
OFFICIAL = "fred"

CATALOG = [(name, QUOTES, symbol) for name, symbol in QUOTE_SYMBOLS.items()] + [
    (name, OFFICIAL, symbol) for name, symbol in OFFICIAL_SERIES.items()
]

CARRY_CROSSES = ["AUDJPY", "NZDJPY", "MXNJPY", "EURJPY"]

# --------------------------------------------------------------------------------------
# History bound, source guards, manual inputs
# --------------------------------------------------------------------------------------
HISTORY_DAYS = 365 * 3 + 30
PERCENTILE_DAYS = 365 * 3
PERCENTILE_MIN_OBS = 30
VOL_ROWS = 20
VOL_MIN_OBS = 25
PROXY_MIN_OBS = 60
CORR_ROWS = 60
YIELD_MIN_OBS = 5  # more than
MOVE_MIN_OBS = 60  # more than
OAS_MIN_OBS = 30  # more than
YIELD_RESCALE_ABOVE = 20.0

MANUAL_JP_YIELDS = {"JP2Y": 1.20, "JP10Y": 2.50}
MANUAL_POLICY_RATES = {"FED_FUNDS": 3.60, "BOJ_RATE": 0.85}
MANUAL_AS_OF = "2026-08-02"
INDEX_CAP_BN_PER_POINT = 8.40

SEED_LABELS = {
    "JP2Y": "seeded from FRED 3-month interbank",
    "JP10Y": "FRED monthly 10-year",
    "BOJ_RATE": "FRED call money rate",
}
SEED_FALLBACK_LABEL = f"built-in fallback ({MANUAL_AS_OF})"

SOURCE_MOVE = "MOVE index (Yahoo)"
SOURCE_VOL_PROXY = "proxy: 20d realised vol of 10y yield (annualised bp)"
SOURCE_OAS = "ICE BofA US High Yield OAS (FRED)"
SOURCE_RATIO = "HYG / LQD price ratio (Yahoo)"
SOURCE_NONE = "unavailable"

# --------------------------------------------------------------------------------------
# Event calendar
# --------------------------------------------------------------------------------------
FOMC_MEETINGS = [
    "2026-01-28", "2026-03-18", "2026-04-29", "2026-06-17", "2026-07-29",
    "2026-09-16", "2026-10-28", "2026-12-09", "2027-01-27", "2027-03-17",
]
BOJ_MEETINGS = [
    "2026-01-23", "2026-03-19", "2026-05-01", "2026-06-16", "2026-07-31",
    "2026-09-18", "2026-10-30", "2026-12-18", "2027-01-22", "2027-03-18",
]
OTHER_EVENTS = [
    ("2026-08-21", "Jackson Hole symposium (approx.)"),
    ("2026-09-30", "US fiscal year end"),
]

# --------------------------------------------------------------------------------------
# scoring
# --------------------------------------------------------------------------------------
# component -> (label, weight), in component order
COMPONENTS = {
    "carry_fx": ("Yen carry / FX stress", 20.0),
    "rate_diff": ("Rate differentials", 10.0),
    "rate_vol": ("Treasury volatility", 10.0),
    "curve": ("Yield curve", 5.0),
    "equity_vol": ("Equity volatility", 15.0),
    "credit": ("Credit spreads", 15.0),
    "leverage": ("Leverage / margin debt", 15.0),
    "commodity": ("Commodity / inflation shock", 10.0),
}

# signal -> (calm, stress)
THRESHOLDS = {
    "usdjpy_1m_pct": (-2.0, -7.0),
    "usdjpy_1w_pct": (-1.0, -4.0),
    "carry_cross_drawdown_pct": (-2.0, -8.0),
    "diff_2y_change_3m": (-0.15, -0.75),
    "diff_2y_level": (1.0, 4.0),
    "rate_vol_pctile": (60.0, 92.0),
    "curve_steepening_3m": (0.25, 1.00),
    "vix_level": (15.0, 32.0),
    "vix_term_structure": (0.92, 1.05),
    "hy_oas_level": (3.0, 6.0),
    "hy_oas_change_1m": (0.10, 0.90),
    "hyg_lqd_drawdown_pct": (-1.0, -5.0),
    "margin_debt_yoy": (10.0, 30.0),
    "margin_debt_vs_peak": (90.0, 100.0),
    "oil_abs_move_1m": (8.0, 25.0),
    "oil_vol_pctile": (60.0, 90.0),
}

# signal -> (component, sub-weight, label, decimals, signed, suffix), in display order
SIGNALS = {
    "usdjpy_1m_pct": ("carry_fx", 0.35, "USDJPY 1-month change", 2, True, "%"),
    "usdjpy_1w_pct": ("carry_fx", 0.40, "USDJPY 1-week change", 2, True, "%"),
    "carry_cross_drawdown_pct": (
        "carry_fx", 0.25, "Worst carry cross vs 60d high", 2, True, "%"),
    "diff_2y_change_3m": ("rate_diff", 0.70, "US-JP 2y differential, 3m change", 2, True, "pp"),
    "diff_2y_level": ("rate_diff", 0.30, "US-JP 2y differential level", 2, False, "pp"),
    "rate_vol_pctile": ("rate_vol", 1.0, "Treasury vol percentile (3y)", 0, False, "th pctile"),
    "curve_steepening_3m": ("curve", 1.0, "10y-2y slope, 3m change", 2, True, "pp"),
    "vix_level": ("equity_vol", 0.60, "VIX level", 2, False, ""),
    "vix_term_structure": ("equity_vol", 0.40, "VIX / VIX3M", 3, False, ""),
    "hy_oas_change_1m": ("credit", 0.60, "HY spread, 1m change", 2, True, "pp"),
    "hy_oas_level": ("credit", 0.40, "HY spread level", 2, False, "pp"),
    "hyg_lqd_drawdown_pct": ("credit", 1.0, "HYG/LQD vs 6m high", 2, True, "%"),
    "margin_debt_yoy": ("leverage", 0.55, "Margin debt YoY", 1, True, "%"),
    "margin_debt_vs_peak": (
        "leverage", 0.45, "Margin debt vs record high", 1, False, "% of peak"),
    "oil_abs_move_1m": ("commodity", 0.60, "WTI 1-month move (absolute)", 1, False, "%"),
    "oil_vol_pctile": (
        "commodity", 0.40, "WTI realised vol percentile (3y)", 0, False, "th pctile"),
}

# Signals that exist only for one kind of credit source.
CREDIT_SIGNAL_KIND = {
    "hy_oas_change_1m": "oas",
    "hy_oas_level": "oas",
    "hyg_lqd_drawdown_pct": "ratio",
}

LEVEL_HIGH, LEVEL_ELEVATED = 0.62, 0.34
REGIME_HIGH, REGIME_ELEVATED = 62.0, 34.0
LEVEL_LABELS = {"low": "Low", "elevated": "Elevated", "high": "High", "na": "No data"}

# rule -> floor, in rule order
RULE_FLOORS = {
    "carry_unwind": 70.0,
    "vol_backwardation": 66.0,
    "credit_crack": 66.0,
    "leverage_at_peak_and_vol_rising": 60.0,
}
# Texts of the rules, in rule order
RULE_TEXTS = {
    "carry_unwind": (
        "Yen strengthening fast (USDJPY down >2% in a week) while the US-Japan 2y differential "
        "is still wide (>2.0pp). This is the signature of a forced carry-trade unwind rather "
        "than an orderly rate-driven move."
    ),
    "vol_backwardation": (
        "VIX term structure in backwardation (VIX above VIX3M) — the options market is pricing "
        "near-term stress above longer-term stress."
    ),
    "credit_crack": (
        "High-yield spreads widened more than 100bp in a month — credit is repricing risk "
        "faster than equities."
    ),
    "leverage_at_peak_and_vol_rising": (
        "Margin debt within 3% of its record high while volatility is already elevated — "
        "maximum leverage meeting rising volatility is the classic setup for a forced-selling "
        "cascade."
    ),
}
RULE_PARAMS = {
    "carry_unwind_usdjpy_1w": -2.0,
    "carry_unwind_min_diff": 2.0,
    "vol_backwardation_ratio": 1.00,
    "credit_crack_oas_1m": 1.00,
    "leverage_peak_proximity": 97.0,
    "leverage_vix_trigger": 22.0,
}

# --------------------------------------------------------------------------------------
# Explanation texts
# --------------------------------------------------------------------------------------
EXPLAIN_NO_DATA = "No data available — check your connection and hit Refresh."
EXPLAIN_HEADLINE = {
    "low": "Conditions are calm. No systematic action indicated.",
    "elevated": "Conditions are deteriorating. Tighten risk, avoid adding leverage.",
    "high": "Systematic stress is elevated. Consider reducing equity exposure.",
}
EXPLAIN_COMPOSITE = "**%s** Composite score %.0f/100."
EXPLAIN_FLOORED = (
    "The score was **floored by %d escalation rule(s)** (%s) — "
    "the weighted average alone was %.0f."
)
EXPLAIN_DRIVER = "%s (%s, %.0f/100)"
EXPLAIN_DRIVERS = "Main contributors: %s."
EXPLAIN_NO_DRIVERS = "No individual component is above its 'calm' band."
EXPLAIN_MISSING = "_Excluded for lack of data (%.0f%% of total weight): %s._"
EXPLAIN_BREAK = "\n\n"

NOTE_RATE_VOL = (
    "Source: %s. Scored as a percentile so the proxy and the real MOVE index are "
    "interchangeable."
)
NOTE_CREDIT = (
    "Source: %s. Credit usually reprices risk before equities do, which is what makes it "
    "worth watching daily."
)
NOTE_LEVERAGE_NONE = "No margin debt data loaded — component excluded from the score."
NOTE_LEVERAGE_PLACEHOLDER = (
    "Margin data is flagged as PLACEHOLDER, so this component is excluded from the score. "
    "Enter real FINRA figures to enable it."
)
NOTE_LEVERAGE_REAL = (
    "Leverage does not cause a selloff, but it sets how violent one becomes. Record margin "
    "debt still rising is the condition under which an ordinary 5% drop becomes a "
    "forced-selling 15%."
)

# --------------------------------------------------------------------------------------
# Margin file
# --------------------------------------------------------------------------------------
MARGIN_COLUMNS = [
    "month", "debit_balances_musd", "free_credit_cash_musd", "free_credit_margin_musd",
    "is_placeholder",
]
MARGIN_TRUE_WORDS = ["true", "1", "yes", "y"]
MARGIN_PRELUDE = [
    "# FINRA margin statistics. Units: millions of USD.",
    "# Source: https://www.finra.org/investors/insights/investing/margin-statistics",
    "# Set is_placeholder to FALSE once you have entered real figures.",
]
