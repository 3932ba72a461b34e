"""From feature rows to signals, components, composite and explanation.

A feature row holds all sixteen signals, so scoring is row-wise: no shuffle, no join, one
stage of generated code. The long result tables are exploded from the scored row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import params as P
from tideline.functions import scoring as C
from tideline.functions.text import fixed, round_exact, signal_text

COMPONENTS = list(P.COMPONENTS)
Scenarios = Mapping[str, Mapping[str, float]]
#: Scenarios of a table meet the rows in blocks of about so many.
SCENARIO_BLOCK, BROADCAST_SCENARIOS = 1_000, 100_000
#: Change dates that a table of dated parameters may have.
MAX_CHANGES = 500


def signal_values() -> dict[str, str]:
    return {
        "usdjpy_1m_pct": "usdjpy_1m",
        "usdjpy_1w_pct": "usdjpy_1w",
        "carry_cross_drawdown_pct": "carry_cross_drawdown",
        "diff_2y_change_3m": "diff_2y_change_3m",
        "diff_2y_level": "diff_2y",
        "rate_vol_pctile": "rate_vol_pctile",
        "curve_steepening_3m": "curve_change_3m",
        "vix_level": "vix",
        "vix_term_structure": "vix_ratio",
        "hy_oas_change_1m": "hy_oas_change_1m",
        "hy_oas_level": "hy_oas",
        "hyg_lqd_drawdown_pct": "hyg_lqd_drawdown",
        # A placeholder table scores nothing rather than calm.
        "margin_debt_yoy": "if(margin_usable, margin_yoy_pct, null)",
        "margin_debt_vs_peak": "if(margin_usable, margin_pct_of_peak, null)",
        # A jump and a collapse are both shocks.
        "oil_abs_move_1m": "abs(wti_1m)",
        "oil_vol_pctile": "wti_vol_pctile",
    }


def standing_parameters(thresholds: Mapping[str, tuple[float, float]] = P.THRESHOLDS) -> dict[str, float]:
    """Every number that scoring goes by, named as in :func:`dated_parameters`."""
    return {
        **{f"calm_{s}": calm for s, (calm, _) in thresholds.items()},
        **{f"stress_{s}": stress for s, (_, stress) in thresholds.items()},
        **{f"sub_weight_{s}": spec[1] for s, spec in P.SIGNALS.items()},
        **{f"rule_{p}": value for p, value in P.RULE_PARAMS.items()},
        **{f"floor_{r}": value for r, value in P.RULE_FLOORS.items()},
        "band_high": P.REGIME_HIGH, "band_elevated": P.REGIME_ELEVATED,
    }


def dated_parameters(table: DataFrame, thresholds: Mapping[str, tuple[float, float]] = P.THRESHOLDS) -> tuple[list, DataFrame]:
    """(change dates, one row of ``p_*`` for each ``_version``: the dates passed so far).

    ``table``: kind, key, value, from_date. Kinds are ``calm``, ``stress`` and ``sub_weight`` of a signal,
    ``rule`` (a rule's own number), ``floor`` of a rule and ``band`` (high, elevated). A value holds from
    its date until the next one of the same name; before the first, and where none is given, the
    standing value. Unknown names, null values and null dates are left out; of values of one name and
    date the largest counts. The change dates, a model's history, come to the driver; more than
    MAX_CHANGES are refused.
    """
    standing = {k: float(v) for k, v in standing_parameters(thresholds).items()}
    name = F.concat_ws("_", "kind", "key")
    known = table.where(name.isin(list(standing)) & F.col("value").isNotNull() & F.col("from_date").isNotNull())
    picks = [F.max(F.when(name == n, F.col("value"))).alias(n) for n in standing]
    changes = known.groupBy("from_date").agg(*picks)
    dates = sorted(r["from_date"] for r in known.select("from_date").distinct().limit(MAX_CHANGES + 1).collect())
    if len(dates) > MAX_CHANGES:
        raise ValueError(f"more than {MAX_CHANGES} change dates")
    # One row for each change date: a window over so few rows is one small task.
    so_far = Window.orderBy("from_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = changes.select(
        F.row_number().over(Window.orderBy("from_date")).alias("_version"),
        *[F.coalesce(F.last(n, ignorenulls=True).over(so_far), F.lit(v)).alias(f"p_{n}") for n, v in standing.items()],
    )
    first = table.sparkSession.range(1).select(F.lit(0).alias("_version"), *[F.lit(v).alias(f"p_{n}") for n, v in standing.items()])
    return dates, first.unionByName(held)


def with_parameters(
    features: DataFrame, table: DataFrame, thresholds: Mapping[str, tuple[float, float]] = P.THRESHOLDS
) -> DataFrame:
    """Each row with the parameters of its own date as ``p_*``. A date's interval is a number, so rows
    meet parameters by an equality, with a side of one row for each interval."""
    dates, versions = dated_parameters(table, thresholds)
    passed = [F.when(F.col("as_of") >= F.lit(d), 1).otherwise(0) for d in dates]
    version = C.total(passed) if passed else F.lit(0)
    return features.withColumn("_version", version).join(versions, "_version", "left").drop("_version")


def rule_conditions(p: Mapping[str, str] | None = None) -> dict[str, str]:
    """``p``: the rules' numbers as SQL."""
    p = p or {k: f"{v}D" for k, v in P.RULE_PARAMS.items()}
    fired = {
        "carry_unwind": (
            f"usdjpy_1w < {p['carry_unwind_usdjpy_1w']} "
            f"and diff_2y > {p['carry_unwind_min_diff']}"
        ),
        "vol_backwardation": f"vix_ratio > {p['vol_backwardation_ratio']}",
        "credit_crack": f"hy_oas_change_1m > {p['credit_crack_oas_1m']}",
        "leverage_at_peak_and_vol_rising": (
            f"margin_usable and margin_pct_of_peak >= {p['leverage_peak_proximity']} "
            f"and vix > {p['leverage_vix_trigger']}"
        ),
    }
    return {rule: f"coalesce({cond}, false)" for rule, cond in fired.items()}


def ramp(value: str, calm: float, stress: float) -> str:
    """SQL twin of ``functions.scoring.ramp``; a null value stays null."""
    if stress == calm:
        return f"cast({value} >= {calm}D as double)"
    share = f"({value} - {calm}D) / {stress - calm}D"
    return f"if({value} is null, null, greatest(0.0D, least(1.0D, {share})))"


def ramp_between(value: str, calm: str, stress: str) -> str:
    """:func:`ramp` for thresholds that are columns."""
    share = f"try_divide({value} - {calm}, {stress} - {calm})"
    reached = f"cast({value} >= {calm} as double)"
    return f"if({value} is null, null, if({stress} = {calm}, {reached}, greatest(0.0D, least(1.0D, {share}))))"


def counts(score: str, weight: str) -> str:
    return f"({score} is not null and {weight} > 0.0D)"


def weighted_sum(pairs: list[tuple[str, str]]) -> str:
    """Terms in a fixed order, so a result never depends on partitioning."""
    return " + ".join(f"if({counts(s, w)}, {s} * {w}, 0.0D)" for s, w in pairs)


def available_weight(pairs: list[tuple[str, str]]) -> str:
    return " + ".join(f"if({counts(s, w)}, {w}, 0.0D)" for s, w in pairs)


def with_scores(
    features: DataFrame, thresholds: Mapping[str, tuple[float, float]] = P.THRESHOLDS, parameters: DataFrame | None = None
) -> DataFrame:
    """Add ``val_*``, ``sig_*``, ``calm_*`` and ``stress_*`` per signal, ``comp_*`` per component,
    ``rule_*`` per rule. ``parameters`` is a table of dated ones, see :func:`dated_parameters`."""
    values = signal_values()
    if parameters is None:
        named = {n: f"{v}D" for n, v in standing_parameters(thresholds).items()}
        ramps = {s: ramp(f"val_{s}", *thresholds[s]) for s in values}
    else:
        features = with_parameters(features, parameters, thresholds)
        named = {n: f"p_{n}" for n in standing_parameters(thresholds)}
        ramps = {s: ramp_between(f"val_{s}", named[f"calm_{s}"], named[f"stress_{s}"]) for s in values}
    components = {}
    for name in COMPONENTS:
        pairs = [(f"sig_{s}", named[f"sub_weight_{s}"]) for s, spec in P.SIGNALS.items() if spec[0] == name]
        components[name] = f"try_divide({weighted_sum(pairs)}, {available_weight(pairs)})"
    rules = rule_conditions({p: named[f"rule_{p}"] for p in P.RULE_PARAMS})
    return (
        features.selectExpr("*", *[f"{v} as val_{s}" for s, v in values.items()])
        .selectExpr(
            "*",
            *[f"{r} as sig_{s}" for s, r in ramps.items()],
            *[f"{named[f'{side}_{s}']} as {side}_{s}" for s in values for side in ("calm", "stress", "sub_weight")],
            *[f"{cond} as rule_{r}" for r, cond in rules.items()],
        )
        .selectExpr("*", *[f"{v} as comp_{k}" for k, v in components.items()])
    )


def scenario_weights(table: DataFrame) -> DataFrame:
    """``(scenario, component, weight)`` as one row per scenario. A component that a scenario
    does not name keeps its usual weight; rows of unknown components or without a weight are
    left out, of repeated ones the largest weight counts."""
    picks = [
        F.expr(f"coalesce(max(if(component = '{k}', weight, null)), {float(P.COMPONENTS[k][1])}D)").alias(f"w_{k}")
        for k in COMPONENTS
    ]
    return table.groupBy("scenario").agg(*picks)


def with_scenario_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Every row under every scenario of the table, which is the result asked for.

    Scenarios are gathered into blocks of bounded size, and rows meet each block by an equi-join,
    so neither the plan nor the driver's work grows with their number. The blocks are broadcast
    up to a checked number of scenarios.
    """
    settings = scenario_weights(table)
    count = settings.count()
    blocks = max(1, -(-count // SCENARIO_BLOCK))
    grouped = settings.groupBy(F.pmod(F.xxhash64("scenario"), F.lit(blocks)).cast("int").alias("_block")).agg(
        F.collect_list(F.struct("scenario", *[f"w_{k}" for k in COMPONENTS])).alias("_settings")
    )
    if count <= BROADCAST_SCENARIOS:
        grouped = F.broadcast(grouped)
    spread = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(grouped, "_block").selectExpr("* except (_block, _settings)", "inline(_settings)")


def with_weights(rows: DataFrame, scenarios: Scenarios | DataFrame | None = None) -> DataFrame:
    """Add ``scenario`` and ``w_*``. A few scenarios are a literal list of settings, so a sweep
    multiplies rows in place: nothing is joined or shuffled. Many come as a table."""
    if isinstance(scenarios, DataFrame):
        return with_scenario_table(rows, scenarios)
    named = scenarios or {"base": {}}

    def setting(name, overrides):
        unknown = set(overrides) - set(COMPONENTS)
        if unknown:
            raise ValueError(f"unknown components: {sorted(unknown)}")
        weights = {k: float(overrides.get(k, P.COMPONENTS[k][1])) for k in COMPONENTS}
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return [f"'{quoted}'", *[f"{w}D" for w in weights.values()]]

    columns = ["scenario", *[f"w_{k}" for k in COMPONENTS]]
    settings = [setting(name, overrides) for name, overrides in named.items()]
    if len(settings) == 1:
        return rows.selectExpr("*", *[f"{v} as {c}" for v, c in zip(settings[0], columns)])
    structs = ", ".join(
        "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in zip(columns, values)) + ")"
        for values in settings
    )
    return rows.selectExpr("*", f"inline(array({structs}))")


def with_composite(rows: DataFrame) -> DataFrame:
    """Weighted mean of the available components, lifted to the highest fired floor. Floors and bands
    are those of the row's date where it has dated parameters."""
    pairs = [(f"comp_{k}", f"w_{k}") for k in COMPONENTS]
    dated = "p_band_high" in rows.columns
    floors = ", ".join(f"if(rule_{r}, {f'p_floor_{r}' if dated else f'{f}D'}, 0.0D)" for r, f in P.RULE_FLOORS.items())
    bands = (F.col("p_band_high"), F.col("p_band_elevated")) if dated else (P.REGIME_HIGH, P.REGIME_ELEVATED)
    fired = " + ".join(f"cast(rule_{r} as bigint)" for r in P.RULE_FLOORS)
    # Labels of components without a score, in component order; weight plays no part.
    missing = ", ".join(
        f"if(comp_{k} is null, '{label}', null)" for k, (label, _) in P.COMPONENTS.items()
    )
    scored = rows.selectExpr(
        "*",
        f"{weighted_sum(pairs)} as weighted_score",
        f"{available_weight(pairs)} as avail_weight",
        f"{' + '.join(f'greatest(w_{k}, 0.0D)' for k in COMPONENTS)} as total_weight",
        f"concat_ws(', ', {missing}) as missing",
    ).selectExpr(
        "* except (weighted_score)",
        "coalesce(try_divide(weighted_score, avail_weight) * 100.0D, 0.0D) as base_raw",
        f"if(avail_weight > 0.0D, greatest({floors}), 0.0D) as floor",
        "coalesce(try_divide(avail_weight, total_weight) * 100.0D, 0.0D) as coverage_raw",
        f"if(avail_weight > 0.0D, {fired}, 0L) as rules_fired",
    ).selectExpr(
        "*", "greatest(base_raw, floor) as composite_raw"
    )
    # The regime follows the unrounded composite; rounding is for display.
    return scored.withColumns(
        {
            "regime": F.when(
                F.col("avail_weight") > 0.0, C.regime_of(F.col("composite_raw"), *bands)
            ).otherwise("na"),
            "composite": round_exact(F.col("composite_raw"), 1),
            "base_composite": round_exact(F.col("base_raw"), 1),
            "coverage_pct": round_exact(F.col("coverage_raw"), 0),
        }
    )


def assess(
    features: DataFrame,
    scenarios: Scenarios | DataFrame | None = None,
    thresholds: Mapping[str, tuple[float, float]] = P.THRESHOLDS,
    parameters: DataFrame | None = None,
) -> DataFrame:
    """Scored rows: one per scope, as-of date and scenario, every intermediate kept. ``parameters``
    is a table of dated thresholds, sub-weights, rules, floors and bands (:func:`dated_parameters`)."""
    return with_composite(with_weights(with_scores(features, thresholds, parameters), scenarios))


KEYS = ["scope", "as_of", "scenario"]
ASSESSMENT = [
    *KEYS, "composite", "composite_raw", "base_composite", "base_raw", "regime",
    "coverage_pct", "rules_fired", "missing",
]


def assessment_table(assessed: DataFrame) -> DataFrame:
    return assessed.select(*ASSESSMENT)


def signal_table(scored: DataFrame) -> DataFrame:
    """One row per signal. The credit component shows the signals of its source kind."""
    kind = F.col("credit_kind")
    rows = []
    for i, (s, (component, _, label, decimals, signed, suffix)) in enumerate(
        P.SIGNALS.items()
    ):
        value, score = F.col(f"val_{s}"), F.col(f"sig_{s}")
        wanted = P.CREDIT_SIGNAL_KIND.get(s)
        shown = F.lit(True)
        if wanted:
            shown = kind == "oas" if wanted == "oas" else kind != "oas"
        rows.append(
            F.when(
                shown,
                F.struct(
                    F.lit(i).cast("bigint").alias("ordinal"),
                    F.lit(component).alias("component"),
                    F.lit(s).alias("signal"),
                    F.lit(label).alias("label"),
                    value.alias("value"),
                    signal_text(value, decimals, signed, suffix).alias("display"),
                    score.alias("score"),
                    F.col(f"sub_weight_{s}").alias("sub_weight"),
                    F.col(f"calm_{s}").alias("calm"),
                    F.col(f"stress_{s}").alias("stress"),
                    C.level_of(score).alias("level"),
                ),
            )
        )
    exploded = scored.select("scope", "as_of", F.explode(F.array(*rows)).alias("s"))
    return exploded.where(F.col("s").isNotNull()).select("scope", "as_of", "s.*")


def component_structs() -> Column:
    """Array of one struct per component, in component order."""
    return F.array(
        *[
            F.struct(
                (-(F.coalesce(F.col(f"comp_{k}"), F.lit(0.0)) * F.col(f"w_{k}"))).alias(
                    "neg_contribution"
                ),
                F.lit(i).cast("bigint").alias("ordinal"),
                F.lit(k).alias("component"),
                F.lit(label).alias("label"),
                F.col(f"comp_{k}").alias("score"),
                F.col(f"w_{k}").alias("weight"),
                C.level_of(F.col(f"comp_{k}")).alias("level"),
                note(k).alias("note"),
            )
            for i, (k, (label, _)) in enumerate(P.COMPONENTS.items())
        ]
    )


def note(component: str) -> Column:
    """Notes that depend on data: where a series came from, whether margin data counts."""
    if component == "rate_vol":
        return F.format_string(P.NOTE_RATE_VOL, F.col("rate_vol_source"))
    if component == "credit":
        return F.format_string(P.NOTE_CREDIT, F.col("credit_source"))
    if component == "leverage":
        return (
            F.when(F.col("margin_latest_debit_musd").isNull(), P.NOTE_LEVERAGE_NONE)
            .when(F.col("margin_is_placeholder"), P.NOTE_LEVERAGE_PLACEHOLDER)
            .otherwise(P.NOTE_LEVERAGE_REAL)
        )
    return F.lit("")


def component_table(assessed: DataFrame) -> DataFrame:
    return (
        assessed.select(*KEYS, F.inline(component_structs()))
        .drop("neg_contribution")
    )


def component(assessed: DataFrame, key: str) -> DataFrame:
    """One component by key; the others are never computed."""
    score = F.col(f"comp_{key}")
    return assessed.select(
        *KEYS, F.lit(P.COMPONENTS[key][0]).alias("label"), score.alias("score"),
        F.col(f"w_{key}").alias("weight"), C.level_of(score).alias("level"),
    )


def ranked_components() -> Column:
    """Available components by contribution, ties in component order.

    Eight structs of one row, sorted in place: a window over exploded rows would shuffle
    them back together for the same answer.
    """
    return F.sort_array(F.filter(component_structs(), lambda s: s.score.isNotNull()))


def top_drivers(assessed: DataFrame, count: int = 4) -> DataFrame:
    top = F.slice(ranked_components(), 1, count)
    return assessed.select(*KEYS, F.posexplode(top).alias("pos", "d")).select(
        *KEYS,
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        "d.component", "d.label", "d.score", "d.weight", "d.level",
        (-F.col("d.neg_contribution")).alias("contribution"),
    )


def fired_rules(assessed: DataFrame) -> DataFrame:
    """One row per rule that lifted or could lift the composite."""
    rules = F.array(
        *[
            F.when(
                F.col(f"rule_{r}") & (F.col("avail_weight") > 0.0),
                F.struct(
                    F.lit(i).cast("bigint").alias("ordinal"), F.lit(r).alias("rule"),
                    F.lit(f).alias("floor"), F.lit(P.RULE_TEXTS[r]).alias("description"),
                ),
            )
            for i, (r, f) in enumerate(P.RULE_FLOORS.items())
        ]
    )
    rows = assessed.select(*KEYS, F.explode(rules).alias("r"))
    return rows.where(F.col("r").isNotNull()).select(*KEYS, "r.*")


def missing_components(assessed: DataFrame) -> DataFrame:
    labels = F.array(
        *[
            F.when(
                F.col(f"comp_{k}").isNull(),
                F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(label).alias("label")),
            )
            for i, (k, (label, _)) in enumerate(P.COMPONENTS.items())
        ]
    )
    rows = assessed.select(*KEYS, F.explode(labels).alias("m"))
    return rows.where(F.col("m").isNotNull()).select(*KEYS, "m.*")


def explanation() -> Column:
    """Plain-language reason for the regime, conclusion first."""
    c = F.col
    headline = F.coalesce(
        *[F.when(c("regime") == r, text) for r, text in P.EXPLAIN_HEADLINE.items()]
    )

    def whole(x):
        return round_exact(x, 0)

    first = F.format_string(P.EXPLAIN_COMPOSITE, headline, whole(c("composite")))
    names = F.concat_ws(
        ", ", *[F.when(c(f"rule_{r}"), f"`{r}`") for r in P.RULE_FLOORS]
    )
    floored = F.when(
        c("rules_fired") > 0,
        F.format_string(
            P.EXPLAIN_FLOORED, c("rules_fired"), names, whole(c("base_composite"))
        ),
    )
    leading = F.slice(
        F.filter(ranked_components(), lambda s: s.score >= P.LEVEL_ELEVATED), 1, 3
    )
    described = F.transform(
        leading,
        lambda s: F.format_string(
            P.EXPLAIN_DRIVER, s.label, s.level, whole(s.score * 100.0)
        ),
    )
    drivers = F.when(
        F.size(leading) > 0,
        F.format_string(P.EXPLAIN_DRIVERS, F.array_join(described, "; ")),
    ).otherwise(P.EXPLAIN_NO_DRIVERS)
    excluded = F.when(
        c("missing") != "",
        F.format_string(
            P.EXPLAIN_MISSING, whole(F.lit(100.0) - c("coverage_pct")), c("missing")
        ),
    )
    text = F.concat_ws(P.EXPLAIN_BREAK, first, floored, drivers, excluded)
    return F.when(c("regime") == "na", P.EXPLAIN_NO_DATA).otherwise(text)


def explain(assessed: DataFrame) -> DataFrame:
    return assessed.select(*KEYS, explanation().alias("explanation"))
