"""What the refresh queries build from the given tables, and how often they read these."""

from __future__ import annotations

from datetime import date

from checks import base, q_refresh
from tests.conftest import SF


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_landings_and_refreshes_read_what_was_built_once(spark, monkeypatch):
    """Four landings and refreshes, none of which goes back to the lines and orders."""
    read = []

    def land(obs, path, load_id, kind):
        read.append(obs.inputFiles())

    def refresh(spark, landing, store, side_inputs, **_):
        read.extend(df.inputFiles() for df in side_inputs(spark))

    monkeypatch.setattr(q_refresh, "land", land)
    monkeypatch.setattr(q_refresh.refresh, "refresh", refresh)
    q_refresh.forward_store(spark, SF)
    assert len(read) == 12
    assert not [f for files in read for f in files if f.startswith(f"file:{SF}") or f.startswith(f"file://{SF}")]


def test_lines_and_orders_are_not_doubled_before_they_are_summed(spark):
    """A plan reads from the top: the rows for ALL are made above an aggregate, which is above the join."""
    for df in (base.market(spark, SF), base.margin_table(spark, SF)):
        text = plan(df)
        made = text.index("Generate explode")
        assert text.count("Aggregate", 0, made) == 1 and made < text.index("Aggregate", made) < text.index("Join")


def test_nations_add_up_to_all_with_nulls_and_repeats(spark, tmp_path):
    day = date(1997, 5, 2)
    sf = save(
        spark, tmp_path / "sf",
        supplier=([(1, 4), (2, 7), (3, None), (2, 7)], "s_suppkey long, s_nationkey int"),
        lineitem=(
            [(28, 1, day, 0.05), (28, 2, day, 0.01), (28, 3, day, 0.10), (28, 1, day, None), (29, 3, day, None), (28, None, day, 0.02)],
            "l_orderkey long, l_suppkey long, l_shipdate date, l_discount double",
        ),
        customer=([(1, 4), (2, None), (2, None)], "c_custkey long, c_nationkey int"),
        orders=(
            [(1, day, 1.25, "O"), (1, day, 2.5, "P"), (2, day, 4.0, "F"), (1, day, None, "O"), (9, day, 8.0, "O")],
            "o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string",
        ),
    )
    value = lambda h, c: round(150.0 * (1.0 + 0.6 * (h / (100.0 * c) - 0.05)), 9)
    got = {(r.scope, r.series): r.value for r in base.market(spark, sf).collect()}
    assert got == {
        ("N4", "USDJPY"): value(5, 2), ("N7", "USDJPY"): value(2, 2), (None, "USDJPY"): value(10, 1),
        ("ALL", "USDJPY"): value(17, 5), (None, "AUDJPY"): None, ("ALL", "AUDJPY"): None,
    }
    rows = {r.scope: (r.debit_balances_musd, r.free_credit_cash_musd, r.free_credit_margin_musd) for r in base.margin_table(spark, sf).collect()}
    assert rows["ALL"] == (11.75, 1.25, 2.5)
    assert set(rows) <= {"ALL", "N4", None}
