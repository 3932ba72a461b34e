"""View tables: the data behind each screen, one DataFrame per screen element.

Inputs are feature rows, scored rows or the observation panel. Everything over features is
row-wise; only the display windows of series partition (by series).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import params as P
from tideline.functions import scoring as C
from tideline.functions.text import fixed, number_text, round_exact, tone
from tideline.operators import lookback as L
from tideline.operators import score as SC

c = F.col


def component_bars(assessed: DataFrame) -> DataFrame:
    """Components worst first, those without data last."""
    ordered = F.sort_array(
        F.transform(
            SC.component_structs(),
            lambda s: F.struct(
                s.score.isNull().alias("empty"),
                (-F.coalesce(s.score, F.lit(0.0))).alias("neg"),
                s.ordinal.alias("ordinal"), s.label.alias("label"), s.score.alias("score"),
                s.weight.alias("weight"), s.level.alias("level"),
            ),
        )
    )
    bars = assessed.select(*SC.KEYS, F.posexplode(ordered).alias("pos", "b"))
    text = F.when(c("b.score").isNull(), "no data").otherwise(
        F.concat(fixed(c("b.score") * 100.0, 0), F.lit(" · w"), fixed(c("b.weight"), 0))
    )
    return bars.select(
        *SC.KEYS, (c("pos") + 1).cast("bigint").alias("rank"), "b.label", "b.score",
        "b.level", text.alias("text"),
    )


def cross_level(drawdown: Column) -> Column:
    return (
        F.when(drawdown <= -8.0, "high").when(drawdown <= -2.0, "elevated").otherwise("low")
    )


def crosses(features: DataFrame) -> DataFrame:
    """One row per carry cross that has data, rounded for the table."""

    def entry(i, s):
        low = s.lower()
        level = F.when(c(low) != 0.0, round_exact(c(low), 3))
        return F.when(
            c(low).isNotNull(),
            F.struct(
                F.lit(i).cast("bigint").alias("ordinal"), F.lit(s).alias("cross_name"),
                level.alias("level"),
                *[round_exact(c(f"{low}_{k}"), 2).alias(k) for k in ("1d", "1w", "1m", "dd60")],
                cross_level(c(f"{low}_dd60")).alias("status"),
            ),
        )

    rows = F.array(*[entry(i, s) for i, s in enumerate(P.CARRY_CROSSES)])
    out = features.select("scope", "as_of", F.explode(rows).alias("x"))
    return out.where(c("x").isNotNull()).select(
        "scope", "as_of", "x.ordinal", "x.cross_name", "x.level", c("x.1d").alias("d1"),
        c("x.1w").alias("w1"), c("x.1m").alias("m1"), "x.dd60", "x.status",
    )


def pick(*cases: tuple[Column, str, str], default: tuple[str, str]) -> Column:
    """First matching (condition, level, title), else the default, as a struct."""

    def alert(level, title):
        return F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"))

    chain = None
    for cond, level, title in cases:
        chain = (F if chain is None else chain).when(cond, alert(level, title))
    return chain.otherwise(alert(*default))


def carry_alert() -> Column:
    p = P.RULE_PARAMS
    unwind = (c("usdjpy_1w") < p["carry_unwind_usdjpy_1w"]) & (
        c("diff_2y") > p["carry_unwind_min_diff"]
    )
    return pick(
        (unwind, "high", "Carry unwind pattern detected"),
        (c("usdjpy_1w") < -1.0, "elevated", "Yen firming"),
        default=("low", "No carry unwind signature"),
    )


def curve_alert() -> Column:
    steep = (c("curve_change_3m") > 0.25) & (F.coalesce(c("curve_10_2"), F.lit(0.0)) < 0.5)
    return F.when(
        steep,
        F.struct(
            F.lit("elevated").alias("level"),
            F.lit("Curve steepening from a flat/inverted base").alias("title"),
        ),
    )


def slope_note() -> Column:
    return F.when(F.coalesce(c("curve_10_2"), F.lit(0.0)) < 0.0, "Inverted").otherwise(
        "Positive"
    )


def oil_alert() -> Column:
    p = c("wti_vol_pctile")
    banded = pick(
        (p >= 90.0, "high", "Oil volatility at an extreme"),
        (p >= 60.0, "elevated", "Oil volatility above normal"),
        default=("low", "Oil volatility normal"),
    )
    return F.when(p.isNotNull(), banded)


def margin_alert() -> Column:
    peak, yoy = c("margin_pct_of_peak"), c("margin_yoy_pct")
    known = c("margin_usable") & peak.isNotNull() & yoy.isNotNull()
    banded = pick(
        ((peak >= 99.0) & (yoy >= 25.0), "high", "Record margin debt, rising fast"),
        ((peak >= 95.0) & (yoy >= 15.0), "elevated", "Leverage building"),
        ((yoy < 0.0) & (peak < 95.0), "elevated", "Leverage contracting from a peak"),
        default=("low", "Leverage not at an extreme"),
    )
    return F.when(known, banded)


def credit_balance_state() -> Column:
    net = c("margin_net_credit_musd")
    return F.when(net < 0.0, "net borrowers").when(net >= 0.0, "net creditors")


def vix_ratio_alert() -> Column:
    r = c("vix_ratio")
    banded = pick(
        (r > 1.0, "high", "BACKWARDATION — acute near-term stress"),
        (r > 0.95, "elevated", "Flat — the curve is warning"),
        default=("low", "Contango — normal"),
    )
    return F.when(r.isNotNull(), banded)


def correlation_alert() -> Column:
    r = c("stock_bond_corr")
    banded = pick(
        (r > 0.3, "high", "moving together"),
        (r > 0.0, "elevated", "weakly positive"),
        (r > -0.3, "elevated", "near zero"),
        default=("low", "solidly negative"),
    )
    return F.when(r.isNotNull(), banded)


ALERTS = {
    "carry": carry_alert,
    "curve": curve_alert,
    "oil": oil_alert,
    "margin": margin_alert,
    "vix_ratio": vix_ratio_alert,
    "correlation": correlation_alert,
}


def alert_table(features: DataFrame, which: list[str] | None = None) -> DataFrame:
    """Alerts that apply, one row each."""
    names = which or list(ALERTS)
    rows = F.array(
        *[
            F.when(
                ALERTS[k]().isNotNull(),
                F.struct(F.lit(k).alias("alert"), ALERTS[k]().alias("a")),
            )
            for k in names
        ]
    )
    out = features.select("scope", "as_of", F.explode(rows).alias("r"))
    return out.where(c("r").isNotNull()).select(
        "scope", "as_of", "r.alert", "r.a.level", "r.a.title"
    )


def card(
    ordinal, label, value, level=None, level_text=None, sub=None, deltas=(), good=None,
    decimals=2, suffix="%",
) -> Column:
    """A headline card: texts, level and up to three deltas with their tone."""
    null = F.lit(None)
    padded = [*deltas, *[(None, null.cast("double"))] * (3 - len(deltas))]
    parts = []
    for i, (name, delta) in enumerate(padded, 1):
        text = (
            null.cast("string") if name is None
            else F.concat(
                F.lit(name + " "),
                number_text(delta, decimals, suffix, signed=True),
            )
        )
        parts += [text.alias(f"delta_{i}"),
                  (tone(delta, good) if name else null.cast("string")).alias(f"tone_{i}")]
    label_of = F.coalesce(
        *[F.when(level == k, v) for k, v in P.LEVEL_LABELS.items()]
    ) if level is not None else null.cast("string")
    if level_text is not None:
        label_of = F.coalesce(level_text, label_of)
    return F.struct(
        F.lit(ordinal).cast("bigint").alias("ordinal"), F.lit(label).alias("card"),
        value.alias("value"),
        (level if level is not None else null.cast("string")).alias("level"),
        label_of.alias("level_text"), (sub if sub is not None else null.cast("string")).alias("sub"),
        *parts,
    )


def headline_cards(assessed: DataFrame) -> DataFrame:
    """The five headline cards as rows."""

    def level(k):
        return C.level_of(c(f"comp_{k}"))

    debit = c("margin_latest_debit_musd")
    # A zero debit counts as no figure.
    has_debit = F.coalesce(debit != 0.0, F.lit(False))
    placeholder = c("margin_is_placeholder") & has_debit
    term = F.when(c("vix_ratio").isNull(), "—").when(
        c("vix_ratio") > 1.0, "Backwardation — acute stress"
    ).otherwise("Contango — normal")
    credit_value = F.when(
        c("credit_kind") == "oas", number_text(c("hy_oas"), 2, "pp")
    ).otherwise(number_text(c("credit_pctile"), 0, "th pct"))
    month = F.date_format("margin_latest_month", "MMM yyyy")
    margin_sub = (
        F.when(placeholder, "Example figures — replace with FINRA data to score this")
        .when(month.isNotNull(), F.concat(F.lit("FINRA, "), month))
        .otherwise("—")
    )
    margin_value = F.when(
        has_debit, F.concat(F.lit("$"), fixed(debit / 1000000.0, 2), F.lit("T"))
    ).otherwise("—")
    cards = F.array(
        card(1, "USDJPY", number_text(c("usdjpy"), 2), level("carry_fx"),
             sub=F.lit("Falling = yen strengthening = carry stress"), good="up",
             deltas=[("1d", c("usdjpy_1d")), ("1w", c("usdjpy_1w")), ("1m", c("usdjpy_1m"))]),
        card(2, "VIX", number_text(c("vix"), 2), level("equity_vol"), sub=term,
             deltas=[("VIX/3M", c("vix_ratio"))], decimals=3, suffix=""),
        card(3, "US–JP 2y differential", number_text(c("diff_2y"), 2, "pp"),
             level("rate_diff"), sub=F.lit("Wide = carry fuel · narrowing = exit trigger"),
             deltas=[("3m", c("diff_2y_change_3m"))], suffix="pp"),
        card(4, "High-yield spread", credit_value, level("credit"), sub=c("credit_source"),
             deltas=[("1m", c("hy_oas_change_1m"))], good="down", suffix="pp"),
        card(5, "Margin debt", margin_value, level("leverage"), sub=margin_sub,
             level_text=F.when(placeholder, "Placeholder"), good="down", decimals=1,
             deltas=[("YoY", c("margin_yoy_pct"))]),
    )
    return assessed.select(*SC.KEYS, F.inline(cards))


def event_calendar(spark) -> DataFrame:
    """The built-in event list: event_date, label, kind."""
    rows = (
        [(d, "FOMC", "fomc") for d in P.FOMC_MEETINGS]
        + [(d, "BOJ", "boj") for d in P.BOJ_MEETINGS]
        + [(d, label, "other") for d, label in P.OTHER_EVENTS]
    )
    return spark.createDataFrame(rows, "event_date string, label string, kind string").select(
        F.col("event_date").try_cast("date").alias("event_date"), "label", "kind"
    ).where(F.col("event_date").isNotNull())


BANK_EVENTS, SHOWN_EVENTS, SOON_DAYS = 3, 8, 14


def next_events(calendar: DataFrame, events: list[tuple[str, str, str]]) -> DataFrame:
    """Upcoming events per as-of date: three per bank, then the nearest eight.

    The event list is hand-kept configuration, so it enters as a literal array; each
    calendar row filters and sorts it in place.
    """
    listed = F.array(
        *[
            F.struct(
                F.lit(d).cast("date").alias("event_date"), F.lit(label).alias("label"),
                F.lit(kind).alias("kind"),
            )
            for d, label, kind in events
        ]
    )
    ahead = F.sort_array(F.filter(listed, lambda e: e.event_date >= c("as_of")))
    kinds = sorted({kind for _, _, kind in events})

    def of_kind(kind):
        mine = F.filter(c("ahead"), lambda e: e.kind == kind)
        return mine if kind == "other" else F.slice(mine, 1, BANK_EVENTS)

    shown = F.slice(F.sort_array(F.concat(*[of_kind(k) for k in kinds])), 1, SHOWN_EVENTS)
    rows = calendar.withColumn("ahead", ahead).select(
        "scope", "as_of", F.posexplode(shown).alias("pos", "e")
    )
    days = F.datediff("e.event_date", "as_of")
    return rows.select(
        "scope", "as_of", (c("pos") + 1).cast("bigint").alias("rank"), "e.event_date",
        days.cast("bigint").alias("days_away"), "e.label", (days <= SOON_DAYS).alias("soon"),
    )


CHARTS = {
    "yields": (["us2y", "us10y", "us30y"], None),
    "curve": (["curve_10_2"], 0.0),
    "vix": (["vix"], 20.0),
    "credit": (["credit"], None),
    "index": (["spx"], None),
}


def _shown(lines: DataFrame, series: list[str], days: int) -> DataFrame:
    """The display window of some resolved series, each up to its own last date."""
    picked = lines.where(c("series").isin(series)).withColumns({"provider": F.lit("panel"), "n": F.unix_date("obs_date")})
    return L.trailing_slice(picked, days)


def chart_series(lines: DataFrame, days: int = 365) -> DataFrame:
    """Lines of the level charts, from resolved series, with the chart's reference line."""
    cut = _shown(lines, [s for names, _ in CHARTS.values() for s in names], days)

    def per_chart(get):
        return F.coalesce(
            *[F.when(c("series").isin(names), get(k, ref)) for k, (names, ref) in CHARTS.items()]
        )

    return cut.select(
        "scope", per_chart(lambda k, _: F.lit(k)).alias("chart"), "series", "obs_date",
        "value", per_chart(lambda _, r: F.lit(r).cast("double")).alias("ref_line"),
    )


CARRY_LINES = {"usdjpy": ("USDJPY", 1), "diff_2y": ("2-year differential", 2), "diff_10y": ("10-year differential", 2)}


def carry_panel(lines: DataFrame, days: int = 365) -> DataFrame:
    """USDJPY above the two differentials, from resolved series; each line keeps its own window end."""
    cut = _shown(lines, list(CARRY_LINES), days)
    label, panel = (
        F.coalesce(*[F.when(c("series") == k, F.lit(v[i])) for k, v in CARRY_LINES.items()]) for i in (0, 1)
    )
    return cut.select("scope", panel.cast("bigint").alias("panel"), label.alias("series"), "obs_date", "value")


def margin_bars(margin: DataFrame) -> DataFrame:
    """Monthly debit in $ trillions with the last bar marked."""
    whole = Window.partitionBy("scope")
    return (
        margin.where(c("debit_balances_musd").isNotNull())
        .select(
            "scope", "month", (c("debit_balances_musd") / 1000000.0).alias("debit_tn"),
            (c("month") == F.max("month").over(whole)).alias("is_last"),
        )
    )


def delta_tones(features: DataFrame) -> DataFrame:
    """Tone of the deltas that carry a judgement."""
    return features.select(
        "scope", "as_of", tone(c("usdjpy_1d"), "up").alias("usdjpy_1d_tone"),
        tone(c("hy_oas_change_1m"), "down").alias("hy_oas_tone"),
        tone(c("margin_yoy_pct"), "down").alias("margin_tone"),
        tone(c("gold_1w"), None).alias("gold_tone"),
    )
