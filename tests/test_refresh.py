"""The refresh stream gives what a rebuild gives."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import day, frame, random_panel, rows
from tideline.operators.features import feature_history
from tideline.operators.ingest import replace_series
from tideline.operators.score import assess, assessment_table
from tideline.streaming import refresh

NAMES = ["USDJPY", "AUDJPY", "VIX", "US2Y", "US10Y", "HY_OAS"]
MARGIN = (
    "scope string, month date, debit_balances_musd double, free_credit_cash_musd double, "
    "free_credit_margin_musd double, is_placeholder boolean"
)


def land(obs, folder, load_id, kind="replace", files=1):
    obs.select(
        "scope", "provider", "series", F.col("obs_date").cast("timestamp_ntz").alias("obs_ts"), "value",
        F.lit(load_id).cast("bigint").alias("load_id"), F.lit(kind).alias("kind"),
    ).repartition(files).write.mode("append").parquet(folder)


def rebuilt(obs, margin=None):
    return assessment_table(assess(feature_history(obs, margin))).orderBy("scope", "as_of").toPandas()


def stored(spark, store):
    return refresh.current_assessments(spark, store).orderBy("scope", "as_of").toPandas()


def same(want, got):
    assert len(want) > 0 and want.equals(got[want.columns])


@pytest.mark.parametrize("max_files", [None, 1])
def test_loads_in_parts_equal_a_rebuild(spark, tmp_path, max_files):
    """A load of two scopes in several files; then one series replaced, and one day appended."""
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    first = frame(spark, random_panel(1, 120, NAMES))
    two = first.unionByName(first.withColumn("scope", F.lit("EU")))
    land(two, landing, 1, files=3)
    refresh.refresh(spark, landing, store, max_files=max_files, buckets=4)
    same(rebuilt(two), stored(spark, store))

    again = frame(spark, random_panel(2, 140, ["VIX"])).withColumn("scope", F.lit("EU"))
    more = frame(spark, rows("USDJPY", [(150, 151.0)]))
    land(again, landing, 2, files=2)
    land(more, landing, 3, kind="append")
    refresh.refresh(spark, landing, store, max_files=max_files)
    want = rebuilt(replace_series(two, again).unionByName(more))
    same(want, stored(spark, store))

    # Lost progress: everything lands once more and changes nothing.
    refresh.apply_batch(spark.read.schema(refresh.LANDING_SCHEMA).parquet(landing), 0, store, refresh.no_side_inputs)
    same(want, stored(spark, store))
    moved = str(tmp_path / "compacted")
    refresh.compact(spark, store, moved)
    same(want, stored(spark, moved))
    assert refresh.current_panel(spark, moved).count() == refresh.current_panel(spark, store).count()


def test_new_margin_rows_score_their_scopes_again(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    first = frame(spark, random_panel(1, 100, NAMES))
    two = first.unionByName(first.withColumn("scope", F.lit("EU")))
    land(two, landing, 1)
    figures = [(s, day(31 * k), 1000.0 + 10 * k, 100.0, 50.0, False) for s in ("ALL", "EU") for k in range(3)]
    margin = {"rows": figures}
    side = lambda s: (s.createDataFrame(margin["rows"], MARGIN), None)
    refresh.refresh(spark, landing, store, side)
    same(rebuilt(two, side(spark)[0]), stored(spark, store))
    assert refresh.changed_scopes(spark, store, side).count() == 0
    margin["rows"] = figures + [("EU", day(93), 5000.0, 100.0, 50.0, False)]
    assert [r.scope for r in refresh.changed_scopes(spark, store, side).collect()] == ["EU"]
    refresh.refresh(spark, landing, store, side)
    same(rebuilt(two, side(spark)[0]), stored(spark, store))
    again = spark.read.parquet(f"{store}/assessment").where("version = 1")
    assert [r["scope"] for r in again.select("scope").distinct().collect()] == ["EU"]


def dates_of(spark, store, version):
    rows = spark.read.parquet(f"{store}/assessment").where(F.col("version") == version)
    return {s: sorted(r.as_of for r in rows.where(F.col("scope") == s).select("as_of").distinct().collect()) for s in [r.scope for r in rows.select("scope").distinct().collect()]}


def test_only_dates_from_the_change_on_are_scored_again(spark, tmp_path):
    """Sparse, ended and late series; a day appended, a day revised, a whole history sent again."""
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    data = random_panel(5, 1700, [*NAMES, "TLT", "SPX", "HYG", "LQD", "WTI", "JP10Y_MONTHLY"])
    data = [r for r in data if not (r[2] == "LQD" and r[3] > day(900)) and not (r[2] == "TLT" and r[3].toordinal() % 9) and not (r[2] == "WTI" and day(500) < r[3] < day(1600))]
    first = frame(spark, data)
    two = first.unionByName(first.withColumn("scope", F.lit("EU")))
    figures = [(s, day(31 * k), 1000.0 + 10 * k, 100.0, 50.0, False) for s in ("ALL", "EU") for k in range(50)]
    side_rows = {"rows": figures}
    side = lambda s: (s.createDataFrame(side_rows["rows"], MARGIN), None)
    go = lambda: refresh.refresh(spark, landing, store, side, buckets=2)
    land(two, landing, 1)
    go()
    all_dates = sorted({r[3] for r in data})
    same(rebuilt(two, side(spark)[0]), stored(spark, store))
    assert dates_of(spark, store, 0) == {"ALL": all_dates, "EU": all_dates}

    # A new last day of one scope: dates of its month.
    more = frame(spark, rows("USDJPY", [(1703, 151.0)])).withColumn("scope", F.lit("EU"))
    land(more, landing, 2, "append")
    go()
    now = two.unionByName(more)
    same(rebuilt(now, side(spark)[0]), stored(spark, store))
    assert dates_of(spark, store, 1) == {"EU": [d for d in [*all_dates, day(1703)] if d >= day(1703).replace(day=1)]}

    # A day revised in the middle: from its month on.
    revised = frame(spark, rows("SPX", [(1400, 4321.0)]))
    land(revised, landing, 3, "append")
    go()
    key = ["scope", "provider", "series", "obs_date"]
    now = now.join(revised, key, "left_anti").unionByName(revised)
    same(rebuilt(now, side(spark)[0]), stored(spark, store))
    assert dates_of(spark, store, 2) == {"ALL": [d for d in all_dates if d >= day(1400).replace(day=1)]}

    # A series sent again whole, the same but for two days less and one more at its end.
    vix = frame(spark, [r for r in data if r[2] == "VIX" and r[3] < day(1650)] + rows("VIX", [(1701, 18.0)]))
    land(vix, landing, 4)
    go()
    now = now.where("scope <> 'ALL' or series <> 'VIX'").unionByName(vix)
    same(rebuilt(now, side(spark)[0]), stored(spark, store))
    again = dates_of(spark, store, 3)
    assert set(again) == {"ALL"} and min(again["ALL"]) >= day(1650).replace(day=1)

    # A margin month revised: from that month on; the same again changes nothing.
    side_rows["rows"] = [(s, d, x + 500 if (s, d) == ("EU", day(31 * 40)) else x, *rest) for s, d, x, *rest in figures]
    assert [(r.scope, r.from_date) for r in refresh.changed_scopes(spark, store, side).collect()] == [("EU", day(31 * 40).replace(day=1))]
    go()
    same(rebuilt(now, side(spark)[0]), stored(spark, store))
    go()
    refresh.apply_batch(spark.read.schema(refresh.LANDING_SCHEMA).parquet(landing), 9, store, side)
    assert refresh._next_version(spark, store) == 5
    # Prints of months before the margin's change were kept for the next restart.
    last = frame(spark, rows("VIX", [(1704, 30.0)])).withColumn("scope", F.lit("EU"))
    land(last, landing, 5, "append")
    go()
    same(rebuilt(now.unionByName(last), side(spark)[0]), stored(spark, store))
    assert min(dates_of(spark, store, 5)["EU"]) >= day(1704).replace(day=1)


def test_old_days_are_not_read(spark, tmp_path):
    """What a restart needs: one load window and the warm-up before a series' last day."""
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    land(frame(spark, random_panel(6, 2600, ["USDJPY", "VIX", "WTI"])), landing, 1)
    refresh.refresh(spark, landing, store, buckets=1)
    prints = refresh._live(spark, store, "prints", "month")
    restarts = spark.createDataFrame([("ALL", day(2590).replace(day=1))], "scope string, from_date date")
    need = {r.series: r.need for r in refresh.needed_from(prints, restarts).collect()}
    assert set(need) == {"USDJPY", "VIX", "WTI"} and all(day(2590 - 1125 - 230) < d < day(2590 - 1125) for d in need.values())
