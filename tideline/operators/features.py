"""One wide feature row per scope and as-of date.

The observations are shuffled once, by scope. Volatility and percentiles run on the long
rows of the few series that need them; then the scope turns into one row per date with one
column per series, where lookbacks, drawdowns and carrying are windows over few rows and
pair operators are row-wise expressions instead of joins. A partition holds whole scopes,
and a scope's size is bounded by the catalog times the days of history, however many raw
rows it had before ``ingest.daily``.

Expressions are SQL texts: there are hundreds of them, and a text is one call to the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import params as P
from tideline.functions.series import ANNUAL, percentile_in
from tideline.operators.ingest import load_bound, usable
from tideline.operators import resolve as R
from tideline.operators.leverage import leverage_history

SERIES = [
    "USDJPY", "AUDJPY", "NZDJPY", "MXNJPY", "EURJPY", "SPX", "TLT", "VIX", "VIX3M", "MOVE",
    "WTI", "GOLD", "COPPER", "HYG", "LQD", "US10Y_YF", "US30Y_YF", "US2Y", "US10Y", "US30Y",
    "CURVE_10_2", "FED_FUNDS", "HY_OAS", "VIX_FRED", "WTI_FRED", "JP10Y_MONTHLY",
    "JP_OVERNIGHT", "JP3M_MONTHLY",
]
GUARDED = ["US2Y", "US10Y", "US30Y", "US10Y_YF", "MOVE", "HY_OAS"]
OIL = ["WTI", "WTI_FRED"]
TEN_YEAR = ["US10Y", "US10Y_YF"]
EQUITY_BOND = ["SPX", "TLT"]
RANKED = [*OIL, *TEN_YEAR, "MOVE"]

LEVERAGE = {
    "latest_month": "date", "latest_debit_musd": "double", "yoy_pct": "double",
    "mom_pct": "double", "pct_of_peak": "double", "peak_month": "date",
    "net_credit_musd": "double", "is_placeholder": "boolean", "usable": "boolean",
}


def names(series: list[str]) -> str:
    return ", ".join(f"'{s}'" for s in series)


#: One literal predicate, so that it reaches the scan.
CATALOGED = " or ".join(
    f"(provider = '{provider}' and series in ({names([s for s, p, _ in P.CATALOG if p == provider and s in SERIES])}))"
    for provider in (P.QUOTES, P.OFFICIAL)
)


def panel_rows(
    obs: DataFrame, margin: DataFrame | None, calendar: DataFrame | None, lag_days: int
) -> DataFrame:
    """Observations, leverage figures and wanted dates as rows of one long table, by scope.

    A series counts only from its own catalog provider, and only where it has a number. Days are
    expected to hold one row per series, as :func:`ingest.daily` leaves them.
    """
    fields = ", ".join(f"{c}: {t}" for c, t in LEVERAGE.items())
    no_lev = f"cast(null as struct<{fields}>) as lev"
    no_obs = ["cast(null as string) as series", "cast(null as double) as value"]
    rows = obs.where(F.expr(CATALOGED) & usable(F.col("value"))).selectExpr(
        "scope", "unix_date(obs_date) as n", "series", "value",
        f"{str(calendar is None).lower()} as wanted", no_lev,
    )
    if margin is not None:
        figures = leverage_history(margin)
        rows = rows.unionByName(
            figures.selectExpr(
                "scope", f"unix_date(month) + {lag_days} as n", *no_obs, "false as wanted",
                f"struct({', '.join(LEVERAGE)}) as lev",
            )
        )
    if calendar is not None:
        rows = rows.unionByName(
            calendar.selectExpr(
                "scope", "unix_date(as_of) as n", *no_obs, "true as wanted", no_lev
            )
        )
    # One shuffle serves every step after it. Rows cost far more time than bytes here, so
    # the count is fixed: adaptive coalescing would go by bytes.
    partitions = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "scope")


def ranked(rows: DataFrame, key: str, keys: str, out: str, latest_only: bool) -> DataFrame:
    """Percentile of ``key`` in its trailing window, within partitions ``keys``.

    For a whole history every row collects its window. A snapshot reads only the last row of
    each partition, so there two counts over the partition do, in one pass.
    """
    days = P.PERCENTILE_DAYS
    if not latest_only:
        window = f"(partition by {keys} order by n range between {days} preceding and current row)"
        return (
            rows.selectExpr("*", f"collect_list(0.0D - {key}) over {window} as _window")
            .withColumn(out, percentile_in(F.col("_window"), F.col(key)))
            .drop("_window")
        )
    whole = f"(partition by {keys})"
    inside = f"{key} is not null and n >= _last_n - {days}"
    return (
        rows.selectExpr(
            "*", f"max(n) over {whole} as _last_n", f"max_by({key}, n) over {whole} as _last_key"
        )
        .selectExpr(
            "*",
            f"count_if({inside}) over {whole} as _size",
            f"count_if({inside} and {key} <= _last_key) over {whole} as _below",
        )
        .selectExpr(
            "* except (_last_n, _last_key, _size, _below)",
            f"if(n = _last_n and {key} is not null and _size >= {P.PERCENTILE_MIN_OBS}, "
            f"_below / cast(_size as double) * 100.0D, null) as {out}",
        )
    )


def with_volatility(rows: DataFrame, latest_only: bool = False) -> DataFrame:
    """Returns, twenty-row deviations and trailing percentiles on each series' own calendar.

    Rows of other series get a window partition of their own each, so they pay for no frame.
    """
    stepped = names([*RANKED, *EQUITY_BOND])
    keys = f"scope, series, if(series in ({stepped}), null, n)"
    own = f"partition by {keys} order by n"
    last20 = f"({own} rows between {P.VOL_ROWS - 1} preceding and current row)"
    deviation = f"stddev_samp(step) over {last20} * {ANNUAL * 100.0}D"
    guarded = f"(series not in ({names(OIL)}) or rn >= {P.VOL_MIN_OBS})"
    keyed = (
        rows.selectExpr(
            "*", f"lag(value) over ({own}) as previous", f"row_number() over ({own}) as rn"
        )
        .selectExpr(
            "*", "try_divide(value, previous) - 1.0D as ret",
            f"if(series in ({names(TEN_YEAR)}), value - previous, "
            "try_divide(value, previous) - 1.0D) as step",
        )
        .selectExpr(
            "*",
            f"if(series in ({names(OIL + TEN_YEAR)}) and count(step) over {last20} = "
            f"{P.VOL_ROWS}, {deviation}, null) as deviation",
        )
        # Ranked without the last bits, so that windows over the same steps tie.
        .selectExpr(
            "*", "if(series = 'MOVE', value, round(deviation, 8)) as rank_key"
        )
    )
    return ranked(keyed, "rank_key", keys, "rank", latest_only).selectExpr(
        "scope", "n", "series", "value", "wanted", "lev", "ret",
        f"if({guarded}, deviation, null) as vol", f"if({guarded}, rank, null) as pctile",
    )


def by_date(rows: DataFrame) -> DataFrame:
    """One row per scope and day. The rows are partitioned by scope already, so grouping
    needs no shuffle."""

    def pick(series, column):
        return F.expr(f"max(if(series = '{series}', {column}, null))")

    return (
        rows.groupBy("scope", "n")
        .agg(
            F.max("wanted").alias("wanted"),
            *[pick(s, "value").alias(s) for s in SERIES],
            *[pick(s, "vol").alias(f"{s}_vol") for s in OIL + TEN_YEAR],
            *[pick(s, "pctile").alias(f"{s}_pctile") for s in RANKED],
            *[pick(s, "ret").alias(f"{s}_ret") for s in EQUITY_BOND],
            *[F.max(f"lev.{c}").alias(f"lev_{c}") for c in LEVERAGE],
        )
        .selectExpr(
            "*", "try_divide(HYG, LQD) as RATIO",
            "if(SPX_ret is not null and TLT_ret is not null, true, null) as joint",
            *[
                f"if({ten} is not null and US2Y is not null, "
                f"named_struct('ten', {ten}, 'two', US2Y), null) as {name}"
                for ten, name in (("US10Y", "SPREAD"), ("US10Y_YF", "SPREAD_YF"))
            ],
        )
    )


def with_pairs(days: DataFrame, latest_only: bool = False) -> DataFrame:
    """Joint correlation and ratio percentile, each over the dates both series have."""

    def own(column):
        return f"scope, if({column} is null, n, null)"

    last = (
        f"(partition by {own('joint')} order by n rows between {P.CORR_ROWS - 1} preceding "
        "and current row)"
    )
    rows = days.selectExpr(
        "*",
        f"if(joint and count(joint) over {last} >= {P.CORR_ROWS}, "
        f"nanvl(corr(SPX_ret, TLT_ret) over {last}, null), null) as corr",
    )
    return ranked(rows, "RATIO", own("RATIO"), "RATIO_pctile", latest_only)


BY_DAY = "partition by scope order by n"


def base(column: str, days: int) -> str:
    """Last value at or before ``days`` days earlier, from a frame that only grows."""
    return (
        f"last({column}, true) over ({BY_DAY} range between unbounded preceding and "
        f"{days} preceding)"
    )


def pct(column: str, days: int) -> str:
    return f"(try_divide({column}, {base(column, days)}) - 1.0D) * 100.0D"


def change(column: str, days: int) -> str:
    return f"{column} - {base(column, days)}"


def drawdown(column: str, days: int) -> str:
    high = f"max({column}) over ({BY_DAY} range between {days} preceding and current row)"
    return f"(try_divide({column}, {high}) - 1.0D) * 100.0D"


def trailing_count(column: str, days: int) -> str:
    """Observations within ``[n - days, n]`` as the difference of two growing frames."""
    upto = f"count({column}) over ({BY_DAY} range between unbounded preceding and current row)"
    before = (
        f"count({column}) over ({BY_DAY} range between unbounded preceding and "
        f"{days + 1} preceding)"
    )
    return f"{upto} - {before}"


def observations() -> dict[str, tuple[str, dict[str, str]]]:
    """What each series shows at an observation: (is there one, field -> expression)."""
    fields: dict[str, dict[str, str]] = {s: {"value": s} for s in SERIES}
    for s in ["USDJPY", *P.CARRY_CROSSES]:
        fields[s] |= {"d1": pct(s, 1), "w1": pct(s, 7), "m1": pct(s, 30)}
    for s in P.CARRY_CROSSES:
        fields[s] |= {"dd60": drawdown(s, 60)}
    for s in ("SPX", "GOLD", "COPPER"):
        fields[s] |= {"w1": pct(s, 7)}
    fields["SPX"] |= {"dd365": drawdown("SPX", 365)}
    for s in OIL:
        fields[s] |= {"w1": pct(s, 7), "m1": pct(s, 30)}
    for s in ("US2Y", *TEN_YEAR, "US30Y", "US30Y_YF"):
        fields[s] |= {"c7": change(s, 7)}
    for s, days in (("US2Y", 90), ("CURVE_10_2", 90), ("HY_OAS", 30)):
        fields[s] |= {f"c{days}": change(s, days)}
    for s in OIL + TEN_YEAR:
        fields[s] |= {"vol": f"{s}_vol"}
    for s in RANKED:
        fields[s] |= {"pctile": f"{s}_pctile"}

    out = {s: (f"{s} is not null", f) for s, f in fields.items()}
    out["RATIO"] = (
        "RATIO is not null",
        {"value": "RATIO", "dd180": drawdown("RATIO", 180), "pctile": "RATIO_pctile"},
    )
    for s in ("SPREAD", "SPREAD_YF"):
        out[s] = (
            f"{s} is not null", {"ten": f"{s}.ten", "two": f"{s}.two", "base": base(s, 90)}
        )
    out["CORR"] = ("joint", {"value": "corr"})
    out["LEV"] = ("lev_is_placeholder is not null", {k: f"lev_{k}" for k in LEVERAGE})
    return out


def carried(days: DataFrame) -> DataFrame:
    """Compute every field on its observation's row, then carry each series' last
    observation, whole, to each date. The struct keeps a null field of the last observation
    null instead of reviving an older one."""
    shown = {}
    for name, (there, fields) in observations().items():
        parts = ", ".join(f"'{k}', {v}" for k, v in fields.items())
        shown[name] = f"if({there}, named_struct('n', n, {parts}), null) as ob_{name}"
    counts = [f"{trailing_count(s, P.HISTORY_DAYS)} as count_{s}" for s in GUARDED]
    so_far = f"over ({BY_DAY} rows between unbounded preceding and current row)"
    return days.selectExpr("scope", "n", "wanted", *counts, *shown.values()).selectExpr(
        "scope", "n", "wanted", *[f"count_{s}" for s in GUARDED],
        *[f"last(ob_{name}, true) {so_far} as at_{name}" for name in shown],
    )


MANUAL_KEYS = ["JP2Y", "JP10Y", "BOJ_RATE", "FED_FUNDS"]


def with_manual(rows: DataFrame, manual: DataFrame | None) -> DataFrame:
    """Add the scope's manual inputs. The input table has one short group per scope; the
    join keeps the rows' partitioning and Spark broadcasts only below its size limit."""
    if manual is None:
        return rows.selectExpr(
            "*", *[f"cast(null as double) as manual_{k}" for k in MANUAL_KEYS],
            *[f"cast(null as string) as manual_{k}_source" for k in ("JP2Y", "JP10Y")],
        )

    def pick(key, column):
        return F.expr(f"max(if(key = '{key}', {column}, null))")

    per_scope = manual.groupBy("scope").agg(
        *[pick(k, "value").alias(f"manual_{k}") for k in MANUAL_KEYS],
        *[pick(k, "source").alias(f"manual_{k}_source") for k in ("JP2Y", "JP10Y")],
    )
    return rows.join(per_scope, "scope", "left")


def asof_state(
    obs: DataFrame,
    margin: DataFrame | None = None,
    manual: DataFrame | None = None,
    calendar: DataFrame | None = None,
    publication_lag_days: int = 0,
    latest_only: bool = False,
) -> DataFrame:
    """Per scope and date: every series' last observation and guard counts.

    ``latest_only``: the dates wanted are at or after every observation.
    """
    rows = panel_rows(obs, margin, calendar, publication_lag_days)
    days = by_date(with_volatility(rows, latest_only))
    state = carried(with_pairs(days, latest_only))
    return with_manual(state.where("wanted"), manual)


def resolved(state: DataFrame, seeded: bool = True) -> DataFrame:
    """Pick sources and assemble the feature row. Row-wise only."""
    seen = R.seen
    level = {
        "usdjpy": seen("USDJPY"), "usdjpy_1d": seen("USDJPY", "d1"),
        "usdjpy_1w": seen("USDJPY", "w1"), "usdjpy_1m": seen("USDJPY", "m1"),
    }
    for s in P.CARRY_CROSSES:
        low = s.lower()
        level |= {
            low: seen(s), f"{low}_1d": seen(s, "d1"), f"{low}_1w": seen(s, "w1"),
            f"{low}_1m": seen(s, "m1"), f"{low}_dd60": seen(s, "dd60"),
        }
    level["carry_cross_drawdown"] = f"least({', '.join(seen(s, 'dd60') for s in P.CARRY_CROSSES)})"
    for tenor in ("2Y", "10Y", "30Y"):
        low = tenor.lower()
        level |= {
            f"us{low}": R.us_yield(tenor), f"us{low}_1w": R.us_yield(tenor, "c7"),
            f"us{low}_series": R.yield_source(tenor),
        }
    for tenor in ("2Y", "10Y"):
        level |= {
            f"jp{tenor.lower()}": R.jp_yield(tenor, seeded),
            f"jp{tenor.lower()}_source": R.jp_yield_source(tenor, seeded),
        }
    quotes = " or ".join(R.present(s) for s in SERIES if s in P.QUOTE_SYMBOLS)
    official = " or ".join(R.present(s) for s in SERIES if s in P.OFFICIAL_SERIES)
    newest = ", ".join(seen(s, "n") for s in ("USDJPY", "US10Y", "VIX"))
    level |= {
        "us2y_3m": R.us_yield("2Y", "c90"),
        "curve_10_2": R.curve_level(),
        "curve_change_3m": R.curve_change(),
        "curve_source": R.curve_source(),
        "fed_funds": R.fed_funds(seeded),
        "boj_rate": R.boj_rate(seeded),
        "rate_vol_kind": R.rate_vol_kind(),
        "vix": R.quote_else_official("VIX", "VIX_FRED"),
        "vix_series": R.quote_else_official_source("VIX", "VIX_FRED"),
        "vix3m": seen("VIX3M"),
        "credit_kind": R.credit_kind(),
        **{
            f"wti{suffix}": R.quote_else_official("WTI", "WTI_FRED", field)
            for suffix, field in (
                ("", "value"), ("_1w", "w1"), ("_1m", "m1"), ("_vol", "vol"),
                ("_vol_pctile", "pctile"),
            )
        },
        "wti_series": R.quote_else_official_source("WTI", "WTI_FRED"),
        "gold": seen("GOLD"), "gold_1w": seen("GOLD", "w1"),
        "copper": seen("COPPER"), "copper_1w": seen("COPPER", "w1"),
        "spx": seen("SPX"), "spx_1w": seen("SPX", "w1"), "spx_drawdown": seen("SPX", "dd365"),
        "stock_bond_corr": (
            f"if({R.present('SPX')} and {R.present('TLT')}, at_CORR.value, null)"
        ),
        "newest": f"date_from_unix_date(greatest({newest}))",
        "quotes_seen": quotes,
        "official_seen": official,
        **{f"margin_{c}": f"at_LEV.{c}" for c in LEVERAGE},
        "margin_is_placeholder": "coalesce(at_LEV.is_placeholder, true)",
        "margin_usable": "coalesce(at_LEV.usable, false)",
    }
    chosen = state.selectExpr(
        "scope", "date_from_unix_date(n) as as_of", *[f"{v} as {k}" for k, v in level.items()],
        "at_HY_OAS", "at_RATIO", "at_MOVE", "at_US10Y", "at_US10Y_YF",
    )
    cap = f"spx * {P.INDEX_CAP_BN_PER_POINT}D * 1000.0D"
    combined = {
        "diff_2y": "us2y - jp2y",
        "diff_10y": "us10y - jp10y",
        # The Japanese leg shifts the whole history, so only the US leg changes.
        "diff_2y_change_3m": "if(jp2y is not null, us2y_3m, null)",
        "policy_gap": "fed_funds - boj_rate",
        "rate_vol_level": R.rate_vol_level(),
        "rate_vol_pctile": R.rate_vol_pctile(),
        "rate_vol_source": R.rate_vol_source(),
        "vix_ratio": "nullif(vix, 0.0D) / nullif(vix3m, 0.0D)",
        "credit_source": R.credit_source(),
        "hy_oas": "if(credit_kind = 'oas', at_HY_OAS.value, null)",
        "hy_oas_change_1m": "if(credit_kind = 'oas', at_HY_OAS.c30, null)",
        "hyg_lqd_drawdown": "if(credit_kind = 'ratio', at_RATIO.dd180, null)",
        "credit_level": (
            "case credit_kind when 'oas' then at_HY_OAS.value when 'ratio' then at_RATIO.value end"
        ),
        "credit_pctile": "if(credit_kind = 'ratio', at_RATIO.pctile, null)",
        "margin_pct_of_spx_mktcap": (
            f"if({cap} > 0.0D, margin_latest_debit_musd / ({cap}) * 100.0D, null)"
        ),
    }
    kept = [k for k in level if k not in ("us2y_3m", "rate_vol_kind")]
    return chosen.selectExpr(
        "scope", "as_of", *kept, *[f"{v} as {k}" for k, v in combined.items()]
    )


def feature_history(
    obs: DataFrame,
    margin: DataFrame | None = None,
    manual: DataFrame | None = None,
    calendar: DataFrame | None = None,
    seeded: bool = True,
    publication_lag_days: int = 0,
) -> DataFrame:
    """Features per scope and as-of date.

    ``calendar`` (scope, as_of) lists the dates wanted; without it, every date on which the
    scope has an observation.
    """
    return resolved(asof_state(obs, margin, manual, calendar, publication_lag_days), seeded)


def feature_snapshot(
    obs: DataFrame,
    as_of,
    margin: DataFrame | None = None,
    manual: DataFrame | None = None,
    seeded: bool = True,
    publication_lag_days: int = 0,
    load_days: int | None = None,
) -> DataFrame:
    """Features on one date, from data cut at that date.

    ``load_days`` (:data:`params.HISTORY_DAYS` for a feed's own load) cuts the observations on the
    other side as well: nothing older is read, as a base or otherwise. The margin table is a file
    of its own and always whole.
    """
    day = F.lit(as_of).cast("date")
    if load_days is None:
        cut = obs.where(F.col("obs_date") <= day)
    else:
        cut = load_bound(obs, F.date_sub(day, load_days), day)
    known = None
    if margin is not None:
        known = margin.where(F.date_add("month", publication_lag_days) <= day)
    calendar = cut.select("scope").distinct().withColumn("as_of", day)
    state = asof_state(cut, known, manual, calendar, publication_lag_days, latest_only=True)
    return resolved(state, seeded)


def loads_of(obs: DataFrame, ends: DataFrame, load_days: int) -> DataFrame:
    """Each scope's observations of the ``load_days`` days up to its own end.

    The earliest and the latest end come to the driver and prune months; within these a scope meets
    its own months by an equality, which prunes at run time where one side is small.
    """
    span = ends.agg(F.min("as_of").alias("first"), F.max("as_of").alias("last")).first()
    if span["first"] is None:
        return obs.where(F.lit(False))
    near = load_bound(obs, F.date_sub(F.lit(span["first"]), load_days), F.lit(span["last"]))
    start = F.date_sub("as_of", load_days)
    keys, wanted = ["scope"], ends
    if "obs_month" in obs.columns:
        keys = ["scope", "obs_month"]
        months = F.sequence(F.trunc(start, "month"), F.trunc("as_of", "month"), F.expr("interval 1 month"))
        wanted = ends.withColumn("obs_month", F.explode(months))
    return near.join(wanted, keys).where(F.col("obs_date").between(start, F.col("as_of"))).select(*obs.columns)


def feature_latest(
    obs: DataFrame,
    margin: DataFrame | None = None,
    manual: DataFrame | None = None,
    seeded: bool = True,
    publication_lag_days: int = 0,
    load_days: int | None = None,
) -> DataFrame:
    """Features of each scope on the date of its own last observation. Only those rows read their
    trailing windows; ``load_days`` as in :func:`feature_snapshot`, up to each scope's own end."""
    counted = obs.where(F.expr(CATALOGED) & usable(F.col("value")))
    ends = counted.groupBy("scope").agg(F.max("obs_date").alias("as_of"))
    known = None
    if margin is not None:
        known = margin.join(ends, "scope").where(F.date_add("month", publication_lag_days) <= F.col("as_of")).select(*margin.columns)
    rows = counted if load_days is None else loads_of(counted, ends, load_days)
    return resolved(asof_state(rows, known, manual, ends, publication_lag_days, latest_only=True), seeded)
