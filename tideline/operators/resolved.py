"""Resolved series: for each logical series of a chart, the rows of the source that answers.

Sources are chosen once per scope, as of its last observation, by the same expressions as the
feature row; the rows are those of the load that ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import params as P
from tideline.operators import resolve as R
from tideline.operators.features import CATALOGED, asof_state
from tideline.operators.ingest import usable

SOURCES = [
    "USDJPY", "US2Y", "US10Y", "US30Y", "US10Y_YF", "US30Y_YF", "CURVE_10_2", "VIX", "VIX_FRED",
    "HY_OAS", "HYG", "LQD", "SPX",
]


def _yield(tenor: str) -> str:
    return (
        f"case source_{tenor} when 'US{tenor}' then US{tenor} when 'US{tenor}_YF' then "
        f"{R.rescaled(f'US{tenor}_YF', f'quoted_{tenor}')} end"
    )


YIELDS = ("us2y", "us10y", "us30y")

#: logical series -> value on a day, from the sources' values and the scope's choices
SERIES = {
    "usdjpy": "USDJPY", "us2y": "if(source_2Y = 'US2Y', US2Y, null)", "us10y": _yield("10Y"), "us30y": _yield("30Y"),
    "curve_10_2": "if(source_curve = 'published', CURVE_10_2, if(source_curve = 'spread', line_us10y - line_us2y, null))",
    "vix": "case source_vix when 'VIX' then VIX when 'VIX_FRED' then VIX_FRED end",
    "credit": "case credit_kind when 'oas' then HY_OAS when 'ratio' then try_divide(HYG, LQD) end",
    "spx": "SPX", "diff_2y": "line_us2y - jp2y", "diff_10y": "line_us10y - jp10y",
}


def resolved_series(obs: DataFrame, manual: DataFrame | None = None, seeded: bool = True) -> DataFrame:
    """scope, series, obs_date, value of the load that ends with the scope's last observation.

    One row of choices per scope joins the observations; a day's sources meet by one aggregation.
    """
    rows = obs.where(F.expr(CATALOGED) & usable(F.col("value")))
    ends = rows.groupBy("scope").agg(F.max("obs_date").alias("as_of"))
    state = asof_state(rows, None, manual, ends, latest_only=True)
    choices = state.selectExpr(
        "scope", "n as last_n", *[f"{R.yield_source(t)} as source_{t}" for t in ("2Y", "10Y", "30Y")],
        *[f"at_US{t}_YF.value as quoted_{t}" for t in ("10Y", "30Y")], f"{R.curve_source()} as source_curve",
        f"{R.quote_else_official_source('VIX', 'VIX_FRED')} as source_vix", f"{R.credit_kind()} as credit_kind",
        *[f"{R.jp_yield(t, seeded)} as jp{t.lower()}" for t in ("2Y", "10Y")],
    )
    days = (
        rows.where(F.col("series").isin(SOURCES)).groupBy("scope", "obs_date")
        .agg(*[F.expr(f"max(if(series = '{s}', value, null)) as {s}") for s in SOURCES])
    )
    held = days.join(choices, "scope").where(f"unix_date(obs_date) between last_n - {P.HISTORY_DAYS} and last_n")
    # Yields first, as others refer to them; names of columns know no case, hence the prefix.
    held = held.selectExpr("*", *[f"{SERIES[k]} as line_{k}" for k in YIELDS])
    held = held.selectExpr("scope", "obs_date", *[f"line_{k} as {k}" if k in YIELDS else f"{v} as {k}" for k, v in SERIES.items()])
    return (
        held.unpivot(["scope", "obs_date"], list(SERIES), "series", "value")
        .where("value is not null").select("scope", "series", "obs_date", "value")
    )
