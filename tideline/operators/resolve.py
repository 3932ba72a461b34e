"""Source preference: which candidate series answers for a logical one, as of each date.

Expressions over the row-per-date form of ``operators.features``: ``at_<series>`` is the
struct of a series' last observation as of the date (``n`` is its day), ``count_<series>``
the number of observations in the trailing load window. A candidate whose last observation
is older than the load window counts as absent.

They are SQL texts because a feature row has over a hundred of them.
"""

from __future__ import annotations

from tideline import params as P


def present(series: str) -> str:
    return f"coalesce(at_{series}.n >= n - {P.HISTORY_DAYS}, false)"


def seen(series: str, field: str = "value") -> str:
    """A field of the carried observation, null when the series counts as absent."""
    return f"if({present(series)}, at_{series}.{field}, null)"


def quote_else_official(quote: str, official: str, field: str = "value") -> str:
    return f"if({present(quote)}, at_{quote}.{field}, {seen(official, field)})"


def quote_else_official_source(quote: str, official: str) -> str:
    return f"case when {present(quote)} then '{quote}' when {present(official)} then '{official}' end"


def official_yield(tenor: str) -> str:
    return f"count_US{tenor} > {P.YIELD_MIN_OBS}"


def yield_source(tenor: str) -> str:
    """Name of the series that answers for a US yield; the 2-year has no fallback."""
    fallback = "null" if tenor == "2Y" else f"if({present(f'US{tenor}_YF')}, 'US{tenor}_YF', null)"
    return f"if({official_yield(tenor)}, 'US{tenor}', {fallback})"


def rescaled(value: str, latest: str) -> str:
    """Undo a yield quoted tenfold: judged by the series' latest value only."""
    return f"if({latest} > {P.YIELD_RESCALE_ABOVE}D, {value} / 10.0D, {value})"


def us_yield(tenor: str, field: str = "value") -> str:
    fallback = "null"
    if tenor != "2Y":
        quote = f"US{tenor}_YF"
        scaled = rescaled(f"at_{quote}.{field}", f"at_{quote}.value")
        fallback = f"if({present(quote)}, {scaled}, null)"
    return f"if({official_yield(tenor)}, at_US{tenor}.{field}, {fallback})"


def rate_vol_kind() -> str:
    """'move', 'proxy' (of the official 10-year), 'proxy_yf' (of the quoted one) or null."""
    has = P.PROXY_MIN_OBS
    return (
        f"case when count_MOVE > {P.MOVE_MIN_OBS} then 'move' "
        f"when {official_yield('10Y')} then if(count_US10Y >= {has}, 'proxy', null) "
        f"when count_US10Y_YF >= {has} then 'proxy_yf' end"
    )


def rate_vol_level() -> str:
    quoted = rescaled("at_US10Y_YF.vol", "at_US10Y_YF.value")
    return (
        "case rate_vol_kind when 'move' then at_MOVE.value when 'proxy' then at_US10Y.vol "
        f"when 'proxy_yf' then {quoted} end"
    )


def rate_vol_pctile() -> str:
    """Scaling a whole series leaves its percentile alone."""
    return (
        "case rate_vol_kind when 'move' then at_MOVE.pctile when 'proxy' then at_US10Y.pctile "
        "when 'proxy_yf' then at_US10Y_YF.pctile end"
    )


def rate_vol_source() -> str:
    return (
        f"case when rate_vol_kind = 'move' then '{P.SOURCE_MOVE}' "
        f"when rate_vol_kind is not null then '{P.SOURCE_VOL_PROXY}' else '{P.SOURCE_NONE}' end"
    )


def credit_kind() -> str:
    pair = " and ".join(present(s) for s in ("HYG", "LQD", "RATIO"))
    return (
        f"case when count_HY_OAS > {P.OAS_MIN_OBS} then 'oas' when {pair} then 'ratio' "
        "else 'none' end"
    )


def credit_source() -> str:
    return (
        f"case credit_kind when 'oas' then '{P.SOURCE_OAS}' when 'ratio' then "
        f"'{P.SOURCE_RATIO}' else '{P.SOURCE_NONE}' end"
    )


def curve(published: str, spread: str, quoted: str) -> str:
    """Published spread, else the chosen 10-year minus the 2-year on their joint dates."""
    return (
        f"case when {present('CURVE_10_2')} then {published} "
        f"when {official_yield('2Y')} and {official_yield('10Y')} then {spread} "
        f"when {official_yield('2Y')} and {present('US10Y_YF')} then {quoted} end"
    )


def curve_level() -> str:
    quoted = rescaled("at_SPREAD_YF.ten", "at_US10Y_YF.value")
    return curve(
        "at_CURVE_10_2.value", "at_SPREAD.ten - at_SPREAD.two", f"{quoted} - at_SPREAD_YF.two"
    )


def curve_change() -> str:
    now = rescaled("at_SPREAD_YF.ten", "at_US10Y_YF.value")
    then = rescaled("at_SPREAD_YF.base.ten", "at_US10Y_YF.value")
    return curve(
        "at_CURVE_10_2.c90",
        "(at_SPREAD.ten - at_SPREAD.two) - (at_SPREAD.base.ten - at_SPREAD.base.two)",
        f"({now} - at_SPREAD_YF.two) - ({then} - at_SPREAD_YF.base.two)",
    )


def curve_source() -> str:
    return curve("'published'", "'spread'", "'spread'")


# Monthly series behind each seeded input, and the constant behind it.
SEEDS = {
    "JP2Y": ("JP3M_MONTHLY", P.MANUAL_JP_YIELDS["JP2Y"]),
    "JP10Y": ("JP10Y_MONTHLY", P.MANUAL_JP_YIELDS["JP10Y"]),
    "BOJ_RATE": ("JP_OVERNIGHT", P.MANUAL_POLICY_RATES["BOJ_RATE"]),
}


def seed_value(key: str) -> str:
    series, constant = SEEDS[key]
    return f"if({present(series)}, round(at_{series}.value, 3), {constant}D)"


def seed_source(key: str) -> str:
    series, _ = SEEDS[key]
    month = f"date_format(date_from_unix_date(at_{series}.n), 'MMM yyyy')"
    return (
        f"if({present(series)}, concat('{P.SEED_LABELS[key]}, ', {month}), "
        f"'{P.SEED_FALLBACK_LABEL}')"
    )


def seed_is_live(key: str) -> str:
    return present(SEEDS[key][0])


def jp_yield(tenor: str, seeded: bool) -> str:
    """The manual value wins. With ``seeded`` an absent one is filled the way an input form
    is pre-filled; otherwise the 10-year falls back to the monthly series."""
    manual = f"manual_JP{tenor}"
    if seeded:
        return f"coalesce({manual}, {seed_value(f'JP{tenor}')})"
    if tenor == "10Y":
        return f"coalesce({manual}, {seen('JP10Y_MONTHLY')})"
    return manual


def jp_yield_source(tenor: str, seeded: bool) -> str:
    if seeded:
        other = seed_source(f"JP{tenor}")
    elif tenor == "10Y":
        day = "cast(date_from_unix_date(at_JP10Y_MONTHLY.n) as string)"
        other = (
            f"if({present('JP10Y_MONTHLY')}, concat('FRED monthly, ', {day}), "
            f"'{P.SOURCE_NONE}')"
        )
    else:
        other = f"'{P.SOURCE_NONE}'"
    typed = f"coalesce(manual_JP{tenor}_source, 'manual entry')"
    return f"if(manual_JP{tenor} is not null, {typed}, {other})"


def boj_rate(seeded: bool) -> str:
    return f"coalesce(manual_BOJ_RATE, {seed_value('BOJ_RATE')})" if seeded else "manual_BOJ_RATE"


def fed_funds(seeded: bool) -> str:
    manual = "manual_FED_FUNDS"
    if seeded:
        manual = f"coalesce({manual}, {P.MANUAL_POLICY_RATES['FED_FUNDS']}D)"
    return f"if({present('FED_FUNDS')}, at_FED_FUNDS.value, {manual})"
