"""Signals, components, composite, rules and explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import feature_sql as S
from checks.base import r6, rounded
from checks.q_features import features, inputs
from checks.registry import query
from tideline import params as P
from tideline.functions import scoring as C
from tideline.operators import score, sweep
from tideline.plans import stress

A = S.ASSESSED
SWEEP = {
    "base": {}, "no_leverage": {"leverage": 0.0}, "carry_heavy": {"carry_fx": 40.0, "curve": 0.0},
    "credit_only": {k: 0.0 for k in P.COMPONENTS if k != "credit"},
    "equal": {k: 10.0 for k in P.COMPONENTS},
}


def assessed(spark, sf, scenarios=None):
    return score.assess(features(spark, sf), scenarios)


@query(
    "latest_assessment",
    f"""WITH {A}, l AS (SELECT scope, max(as_of) AS as_of FROM asmt GROUP BY 1)
    SELECT scope, as_of, scenario, composite, {r6('composite_raw')}, base_composite,
      {r6('base_raw')}, regime, coverage_pct, rules_fired, missing
    FROM asmt JOIN l USING (scope, as_of)""",
)
def latest_assessment(spark, sf):
    """Flagship: the newest assessment of every scope."""
    return rounded(score.assessment_table(stress.latest(*inputs(spark, sf))))


@query(
    "c1_ramp",
    f"""WITH {S.SCORED} SELECT scope, as_of, {', '.join(r6('sig_' + s) for s in S.SIGNALS)} FROM sc""",
)
def c1(spark, sf):
    """The library's column form, on the same rows."""
    rows = features(spark, sf)
    for s, v in score.signal_values().items():
        rows = rows.withColumn(f"sig_{s}", C.ramp(F.expr(v), *P.THRESHOLDS[s]))
    return rounded(rows.select("scope", "as_of", *[f"sig_{s}" for s in P.SIGNALS]))


@query(
    "c2_levels",
    f"""WITH {S.SCORED} SELECT scope, as_of, {', '.join(f"{S.level('comp_' + k)} AS level_{k}" for k in S.COMPONENTS)} FROM sc""",
)
def c2(spark, sf):
    rows = score.with_scores(features(spark, sf))
    return rows.select(
        "scope", "as_of",
        *[C.level_of(F.col(f"comp_{k}")).alias(f"level_{k}") for k in P.COMPONENTS],
    )


@query(
    "c3_regime",
    f"WITH {A} SELECT scope, as_of, regime, {r6('composite_raw')} FROM asmt",
)
def c3(spark, sf):
    return rounded(assessed(spark, sf).select("scope", "as_of", "regime", "composite_raw"))


def signal_rows():
    parts = []
    for i, (s, (comp, wt, calm, stress, _)) in enumerate(S.SIGNALS.items()):
        label, decimals, signed, suffix = P.SIGNALS[s][2:]
        fmt = f"%{'+' if signed else ''}.{decimals}f"
        kind = P.CREDIT_SIGNAL_KIND.get(s)
        where = {"oas": "WHERE credit_kind = 'oas'", "ratio": "WHERE credit_kind <> 'oas'"}.get(kind, "")
        parts.append(
            f"""SELECT scope, as_of, {i}::BIGINT AS ordinal, '{comp}' AS component, '{s}' AS signal,
            '{label}' AS label, val_{s} AS value,
            CASE WHEN val_{s} IS NULL THEN 'n/a' ELSE printf('{fmt}', val_{s}) || '{suffix}' END AS display,
            sig_{s} AS score, {wt}::DOUBLE AS sub_weight, {calm}::DOUBLE AS calm,
            {stress}::DOUBLE AS stress, {S.level('sig_' + s)} AS level FROM sc {where}"""
        )
    return " UNION ALL ".join(parts)


SIGNALS_SQL = f"WITH {S.SCORED}, sigs AS ({signal_rows()}) "


@query(
    "c4_signal_scores",
    SIGNALS_SQL + f"""SELECT scope, as_of, ordinal, component, signal, label, {r6('value')},
      {r6('score')}, sub_weight, calm, stress, level FROM sigs""",
)
def c4(spark, sf):
    return rounded(score.signal_table(score.with_scores(features(spark, sf))).drop("display"))


@query("c17_signal_display", SIGNALS_SQL + "SELECT scope, as_of, signal, display FROM sigs")
def c17(spark, sf):
    table = score.signal_table(score.with_scores(features(spark, sf)))
    return table.select("scope", "as_of", "signal", "display")


@query(
    "c5_component_blend",
    f"""WITH {S.SCORED} SELECT scope, as_of, {', '.join(r6('comp_' + k) for k in S.COMPONENTS)} FROM sc""",
)
def c5(spark, sf):
    rows = score.with_scores(features(spark, sf))
    return rounded(rows.select("scope", "as_of", *[f"comp_{k}" for k in P.COMPONENTS]))


def component_rows(src="asmt", extra=""):
    return " UNION ALL ".join(
        f"""SELECT scope, as_of, scenario, {i}::BIGINT AS ordinal, '{k}' AS component,
        '{label}' AS label, comp_{k} AS score, w_{k} AS weight, {S.level('comp_' + k)} AS level,
        {NOTES.get(k, "''")} AS note FROM {src}"""
        for i, (k, (label, _)) in enumerate(S.COMPONENTS.items())
    )


NOTES = {
    "rate_vol": "'Source: ' || rate_vol_source || '. Scored as a percentile so the proxy and "
                "the real MOVE index are interchangeable.'",
    "credit": "'Source: ' || credit_source || '. Credit usually reprices risk before equities "
              "do, which is what makes it worth watching daily.'",
    "leverage": f"""CASE WHEN margin_latest_debit_musd IS NULL THEN '{P.NOTE_LEVERAGE_NONE}'
        WHEN margin_is_placeholder THEN '{P.NOTE_LEVERAGE_PLACEHOLDER}'
        ELSE '{P.NOTE_LEVERAGE_REAL}' END""",
}
COMPONENTS_SQL = f"WITH {A}, comps AS MATERIALIZED ({component_rows()}) "


@query(
    "c6_component_scores",
    COMPONENTS_SQL + f"""SELECT scope, as_of, scenario, ordinal, component, label, {r6('score')},
      weight, level FROM comps""",
)
def c6(spark, sf):
    return rounded(score.component_table(assessed(spark, sf)).drop("note"))


@query("c18_component_notes", COMPONENTS_SQL + "SELECT scope, as_of, component, note FROM comps")
def c18(spark, sf):
    return score.component_table(assessed(spark, sf)).select("scope", "as_of", "component", "note")


@query(
    "c16_component_lookup",
    COMPONENTS_SQL + f"""SELECT scope, as_of, scenario, label, {r6('score')}, weight, level
      FROM comps WHERE component = 'credit'""",
)
def c16(spark, sf):
    return rounded(score.component(assessed(spark, sf), "credit"))


@query(
    "c7_composite",
    f"WITH {A} SELECT scope, as_of, scenario, {r6('base_raw')}, base_composite FROM asmt",
)
def c7(spark, sf):
    rows = assessed(spark, sf)
    return rounded(rows.select("scope", "as_of", "scenario", "base_raw", "base_composite"))


@query(
    "c8_weight_scenarios",
    f"""WITH {S.assessed(SWEEP)} SELECT scope, as_of, scenario, {r6('composite_raw')}, regime,
      coverage_pct FROM asmt""",
)
def c8(spark, sf):
    """The scenarios as a table; a component that one does not name has no row."""
    named = [(s, k, v) for s, over in SWEEP.items() for k, v in over.items()]
    named += [(s, "none such", 1.0) for s in SWEEP]
    rows = assessed(spark, sf, spark.createDataFrame(named, "scenario string, component string, weight double"))
    return rounded(
        rows.select("scope", "as_of", "scenario", "composite_raw", "regime", "coverage_pct")
    )


@query(
    "c9_coverage",
    f"WITH {S.assessed(SWEEP)} SELECT scope, as_of, scenario, {r6('cov_raw', 'coverage_raw')} FROM asmt",
)
def c9(spark, sf):
    rows = assessed(spark, sf, SWEEP)
    return rounded(rows.select("scope", "as_of", "scenario", "coverage_raw"))


@query(
    "c10_missing_components",
    COMPONENTS_SQL + "SELECT scope, as_of, scenario, ordinal, label FROM comps WHERE score IS NULL",
)
def c10(spark, sf):
    return score.missing_components(assessed(spark, sf))


NONE = {"nothing": {k: 0.0 for k in P.COMPONENTS}}


@query(
    "c11_no_weight",
    f"""WITH {S.assessed(NONE)} SELECT scope, as_of, scenario, composite, base_composite, regime,
      coverage_pct, rules_fired FROM asmt""",
)
def c11(spark, sf):
    return assessed(spark, sf, NONE).select(
        "scope", "as_of", "scenario", "composite", "base_composite", "regime", "coverage_pct",
        "rules_fired",
    )


RULES_SQL = " UNION ALL ".join(
    f"""SELECT scope, as_of, scenario, {i}::BIGINT AS ordinal, '{r}' AS rule, {f}::DOUBLE AS floor,
      '{S.RULE_TEXTS[r]}' AS description
    FROM asmt WHERE rule_{r} AND avail > 0""" for i, (r, (f, _)) in enumerate(S.RULES.items())
)


@query("c12_escalation_rules", f"WITH {A} {RULES_SQL}")
def c12(spark, sf):
    return score.fired_rules(assessed(spark, sf))


@query(
    "c13_floored_composite",
    f"""WITH {A} SELECT scope, as_of, scenario, {r6('base_raw')}, {r6('floor_', 'floor')},
      {r6('composite_raw')}, composite FROM asmt""",
)
def c13(spark, sf):
    rows = assessed(spark, sf)
    return rounded(
        rows.select("scope", "as_of", "scenario", "base_raw", "floor", "composite_raw", "composite")
    )


DRIVERS_SQL = """, ranked AS MATERIALIZED (
    SELECT *, score * weight AS contribution, row_number() OVER (
      PARTITION BY scope, as_of, scenario ORDER BY score * weight DESC, ordinal) AS rank
    FROM comps WHERE score IS NOT NULL) """


@query(
    "c14_top_drivers",
    COMPONENTS_SQL + DRIVERS_SQL + f"""SELECT scope, as_of, scenario, rank, component, label,
      {r6('score')}, weight, level, {r6('contribution')} FROM ranked WHERE rank <= 4""",
)
def c14(spark, sf):
    return rounded(score.top_drivers(assessed(spark, sf), 4))


EXPLAIN_SQL = COMPONENTS_SQL + DRIVERS_SQL + f""", lead3 AS (
    SELECT scope, as_of, scenario, string_agg(
        printf('%s (%s, %.0f/100)', label, level, score * 100.0::DOUBLE), '; ' ORDER BY rank) AS names
    FROM (SELECT *, row_number() OVER (PARTITION BY scope, as_of, scenario ORDER BY rank) AS k
          FROM ranked WHERE score >= 0.34) WHERE k <= 3 GROUP BY 1, 2, 3)
  SELECT scope, as_of, scenario, CASE WHEN regime = 'na' THEN '{P.EXPLAIN_NO_DATA}' ELSE
    concat_ws(chr(10) || chr(10),
      printf('**%s** Composite score %.0f/100.', CASE regime
        WHEN 'low' THEN '{P.EXPLAIN_HEADLINE['low']}'
        WHEN 'elevated' THEN '{P.EXPLAIN_HEADLINE['elevated']}'
        ELSE '{P.EXPLAIN_HEADLINE['high']}' END, composite),
      CASE WHEN rules_fired > 0 THEN printf('The score was **floored by %d escalation rule(s)** (%s) — the weighted average alone was %.0f.',
        rules_fired, concat_ws(', ', {', '.join(f"CASE WHEN rule_{r} THEN '`{r}`' END" for r in S.RULES)}), base_composite) END,
      CASE WHEN names IS NOT NULL THEN 'Main contributors: ' || names || '.'
        ELSE 'No individual component is above its ''calm'' band.' END,
      CASE WHEN missing <> '' THEN printf('_Excluded for lack of data (%.0f%% of total weight): %s._',
        100.0::DOUBLE - coverage_pct, missing) END) END AS explanation
  FROM asmt LEFT JOIN lead3 USING (scope, as_of, scenario)"""


@query("c15_explanation", EXPLAIN_SQL)
def c15(spark, sf):
    return score.explain(assessed(spark, sf))


#: kind, key, value, from_date: two days on which the model changed.
DATED = [
    ("calm", "vix_level", 18.0, "1996-07-01"), ("stress", "vix_level", 40.0, "1996-07-01"),
    ("sub_weight", "usdjpy_1w_pct", 0.2, "1996-07-01"), ("calm", "vix_level", 16.0, "1997-03-01"),
    ("rule", "vol_backwardation_ratio", 1.02, "1997-03-01"), ("floor", "credit_crack", 75.0, "1997-03-01"),
    ("band", "high", 55.0, "1997-03-01"), ("band", "elevated", 30.0, "1997-03-01"), ("calm", "unheard_of", 1.0, "1995-01-01"),
]


def dated_sql() -> str:
    """The history under each version of the model, of each the dates on which it held."""
    at = lambda calm: {
        **S.SIGNALS, "vix_level": ("equity_vol", 0.60, calm, 40.0, "vix"), "usdjpy_1w_pct": ("carry_fx", 0.2, -1.0, -4.0, "usdjpy_1w"),
    }
    rules = {**S.RULES, "vol_backwardation": (66.0, "vix_ratio > 1.02"), "credit_crack": (75.0, "hy_oas_change_1m > 1.0")}
    versions = [
        (S.assessed(), "as_of < DATE '1996-07-01'"),
        (S.assessed(signals=at(18.0)), "as_of >= DATE '1996-07-01' AND as_of < DATE '1997-03-01'"),
        (S.assessed(signals=at(16.0), rules=rules, bands=(55, 30)), "as_of >= DATE '1997-03-01'"),
    ]
    columns = f"scope, as_of, composite, {r6('comp_equity_vol')}, {r6('comp_carry_fx')}, regime, rules_fired"
    return " UNION ALL ".join(f"SELECT * FROM (WITH {ctes} SELECT {columns} FROM asmt WHERE {when})" for ctes, when in versions)


@query("c1_dated_parameters", dated_sql())
def c1_dated(spark, sf):
    """One history scored under three versions of thresholds, sub-weights, rules, floors and bands."""
    table = spark.createDataFrame(DATED, "kind string, key string, value double, from_date string").withColumn("from_date", F.to_date("from_date"))
    rows = score.assess(features(spark, sf), parameters=table)
    return rounded(rows.select("scope", "as_of", "composite", "comp_equity_vol", "comp_carry_fx", "regime", "rules_fired"))


SUMMARY_SQL = f"""WITH {S.assessed(SWEEP)} SELECT scope, scenario, count(*) AS dates, {r6('avg(composite_raw)', 'mean')},
  {r6('max(composite_raw)', 'worst')}, count(*) FILTER (WHERE regime = 'high') AS days_high FROM asmt GROUP BY 1, 2"""


@query("c8_sweep_summary", SUMMARY_SQL)
def c8_summary(spark, sf):
    """Each scope's mean, worst and high days under each weighting, rows never multiplied."""
    return rounded(sweep.summary(score.with_scores(features(spark, sf)), SWEEP))
