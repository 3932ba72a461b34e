"""Candidates from a table, parameters that change over time, sweeps reduced in place, one-pass counts."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import day, frame, random_panel, rows
from tideline import params as P
from tideline.operators import features as FE
from tideline.operators import ingest, preference, score, sweep
from tideline.sources import tables


def points(data, series):
    return sorted((r[3], r[4]) for r in data if r[2] == series and r[4] is not None and not math.isnan(r[4]))


def answer(data, candidates, logical, d, days=1125):
    """The rules in plain Python on one date."""
    for _, provider, series, priority, min_obs, above in sorted((c for c in candidates if c[0] == logical), key=lambda c: (c[3], c[1], c[2])):
        known = [(x, v) for x, v in points([r for r in data if r[1] == provider], series) if x <= d]
        n = sum(x >= d - dt.timedelta(days) for x, _ in known)
        if n >= max(1, min_obs):
            last, value = known[-1]
            return series, priority, value / 10 if above is not None and value > above else value, last, n
    return None


def test_table_of_candidates(spark):
    data = random_panel(21, 420, ["US10Y_YF", "VIX", "MOVE"])
    data += rows("US10Y", [(n, 4.0 + n / 100) for n in (5, 9, 200, 201, 202, 203, 204, 205, 260)])
    data += rows("VIX", [(3, None)]) + rows("HY_OAS", [(300, 3.5), (301, float("nan"))])
    candidates = [
        ("ten", "fred", "US10Y", 1, 6, None), ("ten", "yahoo", "US10Y_YF", 2, 1, 20.0), ("mix", "yahoo", "MOVE", 1, 250, None),
        ("mix", "fred", "HY_OAS", 2, 1, None), ("mix", "yahoo", "VIX", 3, 0, None), ("tie", "yahoo", "VIX", 1, 1, None),
        ("tie", "yahoo", "MOVE", 1, 1, None), ("none", "desk", "VIX", 1, 1, None),
    ]
    table = spark.createDataFrame(candidates, preference.CANDIDATES)
    obs = frame(spark, data)
    for days in (1125, 40):
        got = {(r.logical, r.as_of): (r.series, r.priority, r.value, r.last_date, r.n_obs) for r in preference.resolve(obs, table, days=days).collect()}
        want = {}
        for logical in ("ten", "mix", "tie", "none"):
            own = {(c[1], c[2]) for c in candidates if c[0] == logical}
            for d in {r[3] for r in data if (r[1], r[2]) in own and r[4] is not None and not math.isnan(r[4])}:
                a = answer(data, candidates, logical, d, days)
                if a:
                    want[logical, d] = a
        assert got == want and len({v[0] for k, v in got.items() if k[0] == "mix"}) >= 2
    calendar = spark.createDataFrame([("ALL", day(n)) for n in (-5, 4, 207, 500, 500, 2000)] + [("EU", day(9))], "scope string, as_of date")
    got = {(r.logical, r.as_of): r.series for r in preference.resolve(obs, table, calendar).collect()}
    want = {(lo, d): a[0] for lo in ("ten", "mix", "tie") for d in map(day, (-5, 4, 207, 500, 2000)) if (a := answer(data, candidates, lo, d))}
    assert got == want and not any(d == day(2000) for _, d in got)
    assert preference.resolve(obs.where("false"), table).collect() == [] and preference.resolve(obs, table.where("false")).collect() == []


NAMES = ["USDJPY", "AUDJPY", "VIX", "VIX3M", "US2Y", "US10Y", "HY_OAS", "WTI"]


@pytest.fixture(scope="module")
def features(spark):
    """A small history of two scopes, written once."""
    two = frame(spark, random_panel(7, 300, NAMES))
    rows_ = FE.feature_history(two.unionByName(two.where(F.col("obs_date") < day(120)).withColumn("scope", F.lit("EU"))))
    path = f"{tables.shared_folder(spark)}/test-features-{random.random()}"
    rows_.write.parquet(path)
    return spark.read.parquet(path)


DATED = "kind string, key string, value double, from_date date"


def test_parameters_hold_from_their_dates(spark, features):
    a, b = day(100), day(200)
    table = spark.createDataFrame(
        [
            ("calm", "vix_level", 10.0, a), ("calm", "vix_level", 9.0, a), ("stress", "vix_level", 10.0, b), ("sub_weight", "vix_level", 0.0, b),
            ("floor", "vol_backwardation", 90.0, b), ("rule", "vol_backwardation_ratio", 0.5, b), ("band", "high", 20.0, a), ("calm", "other", 1.0, a),
            ("calm", "hy_oas_level", None, a), ("calm", "hy_oas_level", 1.0, None),
        ], DATED,
    )
    columns = ["scope", "as_of", "comp_equity_vol", "rule_vol_backwardation", "composite_raw", "regime", "calm_vix_level", "stress_vix_level"]
    got = {(r.scope, r.as_of): r for r in score.assess(features, parameters=table).select(*columns).collect()}
    plain = {(r.scope, r.as_of): r for r in score.assess(features).select(*columns).collect()}
    one = {(r.scope, r.as_of): r for r in score.assess(features, thresholds={**P.THRESHOLDS, "vix_level": (10.0, 32.0)}).select(*columns).collect()}
    assert set(got) == set(plain) and len(got) > 300
    for key, r in got.items():
        if key[1] < a:
            assert r == plain[key]
        elif key[1] < b:
            assert (r.comp_equity_vol, r.composite_raw) == (one[key].comp_equity_vol, one[key].composite_raw) and r.calm_vix_level == 10.0
            assert (r.regime == "high") == (r.composite_raw >= 20.0)
        else:
            assert r.rule_vol_backwardation == (plain[key].comp_equity_vol is not None and r.composite_raw >= 90.0) and r.stress_vix_level == 10.0
    shown = score.signal_table(score.with_scores(features, parameters=table)).where("signal = 'vix_level'")
    assert {(r.calm, r.stress, r.sub_weight) for r in shown.collect()} == {(15.0, 32.0, 0.6), (10.0, 32.0, 0.6), (10.0, 10.0, 0.0)}
    empty = score.assess(features, parameters=table.where("false")).select(*columns)
    assert {(r.scope, r.as_of): r for r in empty.collect()} == plain
    many = spark.range(score.MAX_CHANGES + 1).select(F.lit("calm").alias("kind"), F.lit("vix_level").alias("key"), F.lit(1.0).alias("value"), F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("from_date"))
    with pytest.raises(ValueError):
        score.dated_parameters(many)


def test_signal_table_shows_the_thresholds_it_was_given(features):
    shown = score.signal_table(score.with_scores(features, {**P.THRESHOLDS, "vix_level": (1.0, 2.0)}))
    assert {(r.calm, r.stress) for r in shown.where("signal = 'vix_level'").collect()} == {(1.0, 2.0)}


def test_sweep_in_place_equals_multiplied_rows(spark, features, monkeypatch):
    rng = random.Random(3)
    settings = {f"s{i}": {k: float(rng.choice([0, 0, 5, 20])) for k in rng.sample(list(P.COMPONENTS), 5)} for i in range(40)}
    settings |= {"base": {}, "nothing": {k: 0.0 for k in P.COMPONENTS}}
    scored = score.with_scores(features)
    want = score.assess(features, settings).groupBy("scope", "scenario").agg(
        F.count("*").alias("dates"), F.avg("composite_raw").alias("mean"), F.max("composite_raw").alias("worst"), F.count_if(F.col("regime") == "high").alias("days_high"),
    )
    key = lambda df: {(r.scope, r.scenario): (r.dates, round(r["mean"], 9), r.worst, r.days_high) for r in df.collect()}
    want = key(want)
    assert len(want) == 84
    assert key(sweep.summary(scored, settings)) == want
    table = spark.createDataFrame([(s, k, w) for s, own in settings.items() for k, w in (own or {"curve": P.COMPONENTS["curve"][1]}).items()], "scenario string, component string, weight double")
    assert key(sweep.summary(scored.repartition(7), table)) == want
    monkeypatch.setattr(sweep, "BROADCAST_SCENARIOS", 5)
    assert key(sweep.summary(scored, table)) == want
    with pytest.raises(ValueError):
        sweep.summary(scored, {"x": {"unknown": 1.0}})
    assert sweep.summary(scored.where("false"), settings).collect() == []


def test_composites_are_the_same_doubles():
    score_ = np.array([[0.1, np.nan], [np.nan, np.nan], [0.7, 0.2]])
    got, there = sweep.composites(score_, np.array([0.0, 70.0, 66.0]), np.array([[1.0, 3.0], [0.0, 2.0]]))
    assert got.tolist() == [[0.1 * 1.0 / 1.0 * 100.0, 0.0], [0.0, 0.0], [66.0, 66.0]]
    assert there.tolist() == [[True, False], [False, False], [True, True]]


def test_counts_of_the_pass_that_writes(spark, tmp_path):
    data = random_panel(4, 90, NAMES) + rows("GOLD", [(1, None), (2, float("nan"))])
    obs = frame(spark, data)
    seen = tables.save_months(obs, f"{tmp_path}/p", metrics=ingest.quality_metrics())
    report = ingest.quality_report(seen)
    status = {r.scope: r for r in ingest.freshness(obs).collect()}["ALL"]
    counts = ingest.feed_counts(obs).first()
    missing = [r.series for r in ingest.missing_series(obs).collect()]
    assert report["rows"] == len(data) and report["missing_rows"] == 2 and report["newest"] == status.newest
    assert (report["quote_rows"], report["official_rows"]) == (counts.quote_rows, counts.official_rows)
    assert report["feed_status"].startswith("missing: ") and sorted(report["feed_status"][9:].split(", ")) == sorted(missing)
    assert tables.load_months(spark, f"{tmp_path}/p").count() == len(data)
    nothing = ingest.quality_report(tables.save_months(obs.where("false"), f"{tmp_path}/q", metrics=ingest.quality_metrics()))
    assert nothing["feed_status"] == "no_data" and nothing["rows"] == 0 and nothing["newest"] is None
