"""Sources, sinks, normalisation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    MARGIN_SQL, margin_table, market, market_sql, priority_panel, r6, rounded,
    table,
)
from checks.q_features import OWN_CAL, inputs
from checks.q_score import A, assessed
from checks.registry import query
from tideline import params as P
from tideline.operators import ingest, score
from tideline.plans import stress
from tideline.sources import landing, margin_csv, tables

PANEL = market_sql()
SYMBOLS = {name: symbol for name, _, symbol in P.CATALOG}
HERE = [s for s in SYMBOLS if s not in ("DXY", "NDX", "US05Y_YF", "IG_OAS")]


def folder(spark, name):
    import uuid

    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def wide(obs, provider, pattern="{}"):
    """One row per scope and date, one column per provider symbol."""
    names = [n for n, prov, _ in P.CATALOG if prov == provider and n in HERE]
    return obs.where(F.col("provider") == provider).groupBy("scope", F.col("obs_date").alias("date")).agg(
        *[
            F.max(F.when(F.col("series") == n, F.col("value"))).alias(pattern.format(SYMBOLS[n]))
            for n in names
        ]
    )


def named(raw):
    return ingest.daily(ingest.name_series(raw)).select(
        "scope", "provider", "series", "obs_date", "value"
    )


def panel_sql(provider, where=""):
    return f"""WITH {PANEL} SELECT scope, provider, series, obs_date, {r6('value')}
      FROM panel WHERE provider = '{provider}' {where}"""


@query("s1_wide_quotes", panel_sql("yahoo"))
def s1(spark, sf):
    """Land the quotes as a wide parquet table, then load them."""
    path = folder(spark, "quotes")
    wide(market(spark, sf), P.QUOTES).write.parquet(path)
    return rounded(named(landing.read_wide(spark, path, P.QUOTES, keep=["scope"])))


@query("s2_wide_official", panel_sql("fred"))
def s2(spark, sf):
    """The same for the official series, landed as CSV."""
    path = folder(spark, "official")
    wide(market(spark, sf), P.OFFICIAL).write.option("header", True).csv(path)
    return rounded(named(landing.read_wide(spark, path, P.OFFICIAL, fmt="csv", keep=["scope"])))


def own_headers(spark, sf, provider, fmt):
    """Files of one folder that hold other symbols, or the same in another order: the first half
    of the symbols, the rest in reverse, and a third file with every third date of all."""
    path = folder(spark, f"own-headers-{provider}")
    all_ = wide(market(spark, sf), provider)
    symbols = [c for c in all_.columns if c not in ("scope", "date")]
    third = F.pmod(F.unix_date("date"), F.lit(3)) == 0
    half = len(symbols) // 2
    parts = [
        (~third, ["scope", "date", *symbols[:half]]), (~third, [*reversed(symbols[half:]), "date", "scope"]),
        (third, [*reversed(symbols[1:]), "scope", symbols[0], "date"]),
    ]
    for i, (days, columns) in enumerate(parts):
        all_.where(days).select(*[F.col(f"`{c}`") for c in columns]).write.mode("append").option("header", True).format(fmt).save(f"{path}/{i}")
    return rounded(named(landing.read_wide(spark, [f"{path}/{i}" for i in range(len(parts))], provider, fmt=fmt, keep=["scope"])))


@query("s1_own_headers_quotes", panel_sql("yahoo"))
def s1_headers(spark, sf):
    return own_headers(spark, sf, P.QUOTES, "csv")


@query("s2_own_headers_official", panel_sql("fred"))
def s2_headers(spark, sf):
    return own_headers(spark, sf, P.OFFICIAL, "parquet")


@query(
    "s3_close_layouts",
    f"""WITH {PANEL}, q AS (SELECT * FROM panel WHERE provider = 'yahoo')
    SELECT layout, scope, series, obs_date, {r6('value')} FROM q, (SELECT unnest(['field', 'symbol']) AS layout)
    UNION ALL SELECT 'flat', scope, series, obs_date, {r6('value')} FROM q WHERE series = 'SPX'""",
)
def s3(spark, sf):
    obs = market(spark, sf)
    symbols = list(P.QUOTE_SYMBOLS.values())

    def load(layout, frame, expected):
        raw = landing.extract_close(frame, expected, keep=["scope"])
        return named(raw).select(
            F.lit(layout).alias("layout"), "scope", "series", "obs_date", "value"
        )

    by_field = wide(obs, P.QUOTES, "Close|{}").withColumn("Open|^VIX", F.lit(1.0))
    by_symbol = wide(obs, P.QUOTES, "{}|Close").withColumn("^VIX|Open", F.lit(1.0))
    flat = obs.where("series = 'SPX'").select(
        "scope", F.col("obs_date").alias("date"), F.lit(1.0).alias("Open"),
        F.col("value").alias("Close"),
    )
    return rounded(
        load("field", by_field, symbols)
        .unionByName(load("symbol", by_symbol, symbols))
        .unionByName(load("flat", flat, ["^GSPC"]))
        # A flat file cannot serve several symbols.
        .unionByName(load("ambiguous", flat, symbols))
    )


@query(
    "s4_history_bound",
    f"""WITH {PANEL} SELECT scope, provider, series, obs_date, {r6('value')} FROM panel
      WHERE obs_date BETWEEN DATE '2000-06-30' - 1125 AND DATE '2000-06-30'""",
)
def s4(spark, sf):
    return rounded(landing.within_history(market(spark, sf), "2000-06-30"))


SNAPSHOT_DAY = "1997-09-30"
SCORES = ["scope", "as_of", "scenario", "composite", "regime", "coverage_pct", "missing"]


def bounded(panel_rows, calendar):
    """The assessments' SQL over a bounded load, on the dates of ``calendar``."""
    whole = market_sql(outages=True)
    load = market_sql(outages=True, name="whole") + f", panel AS MATERIALIZED ({panel_rows})"
    assert whole in A and OWN_CAL in A
    return f"WITH {A.replace(whole, load).replace(OWN_CAL, calendar)} SELECT {', '.join(SCORES)} FROM asmt"


@query(
    "s4_bounded_snapshot",
    bounded(
        f"SELECT * FROM whole WHERE obs_date BETWEEN DATE '{SNAPSHOT_DAY}' - 1125 AND DATE '{SNAPSHOT_DAY}'",
        f"SELECT DISTINCT scope, DATE '{SNAPSHOT_DAY}' - DATE '1970-01-01' AS d FROM panel",
    ),
)
def s4_snapshot(spark, sf):
    """Assessments of one day from a panel stored by month, of which a load's months are read."""
    path = folder(spark, "panel")
    obs, margin, manual = inputs(spark, sf)
    tables.save_months(obs, path)
    panel = tables.load_months(spark, path)
    rows = stress.snapshot(panel, SNAPSHOT_DAY, margin, manual, load_days=P.HISTORY_DAYS)
    return score.assessment_table(rows).select(*SCORES)


@query(
    "s4_bounded_latest",
    bounded(
        """SELECT whole.* FROM whole JOIN (SELECT scope, max(obs_date) AS last FROM whole GROUP BY 1) USING (scope)
        WHERE obs_date >= last - 1125""",
        "SELECT scope, max(n) AS d FROM panel GROUP BY 1",
    ),
)
def s4_latest(spark, sf):
    """Each scope's last assessment from the months of its own load."""
    path = folder(spark, "panel")
    obs, margin, manual = inputs(spark, sf)
    tables.save_months(obs, path)
    rows = stress.latest(tables.load_months(spark, path), margin, manual, load_days=P.HISTORY_DAYS)
    return score.assessment_table(rows).select(*SCORES)


MARGIN_6 = f"""WITH {MARGIN_SQL} SELECT scope, month, {r6('debit_balances_musd')},
    {r6('free_credit_cash_musd')}, {r6('free_credit_margin_musd')}, is_placeholder FROM margin"""


@query(
    "s5_margin_csv_with_comments",
    MARGIN_6,
)
def s5(spark, sf):
    """A hand-kept file: comment lines, inline comments, untidy headers."""
    path = folder(spark, "margin")
    columns = ["scope", *P.MARGIN_COLUMNS]
    rows = margin_csv.margin_csv_rows(margin_table(spark, sf), scoped=True)
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    body = rows.select(F.col("month").alias("pos"), F.concat(line, F.lit("  # checked")).alias("value"))
    header = "Scope, Month ,Debit_Balances_MUSD,free_credit_cash_musd,free_credit_margin_musd,IS_PLACEHOLDER"
    head = spark.createDataFrame([("0", "# a comment line"), ("1", header)], "pos string, value string")
    # One row per month: a hand-kept file, one part with the header on top.
    (
        head.unionByName(body).coalesce(1).sortWithinPartitions("pos").select("value")
        .write.text(path)
    )
    return rounded(margin_csv.read_margin_csv(spark, path))


@query("s6_supplied_csv", MARGIN_6)
def s6(spark, sf):
    """Supplied files: untidy headers in two column orders, and one that is no table at all."""
    path = folder(spark, "supplied")
    rows = margin_csv.margin_csv_rows(margin_table(spark, sf), scoped=True)
    orders = (
        ("even", ["scope", *P.MARGIN_COLUMNS], "month(cast(month as date)) % 2 = 0"),
        ("odd", [*reversed(P.MARGIN_COLUMNS), "scope"], "month(cast(month as date)) % 2 = 1"),
    )
    for name, columns, part in orders:
        line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        head = spark.createDataFrame([("0", ",".join(f'" {c.upper()}"' for c in columns))], "pos string, value string")
        # One row per scope and month: a hand-kept file, one part with the header on top.
        head.unionByName(rows.where(part).select(F.col("month").alias("pos"), line.alias("value"))).coalesce(1).sortWithinPartitions(
            "pos"
        ).select("value").write.text(f"{path}/{name}")
    noise = spark.range(3).select(F.concat(F.lit("PK,#"), F.col("id").cast("string")).alias("value"))
    noise.coalesce(1).write.text(f"{path}/noise")
    read = [margin_csv.read_margin_csv(spark, f"{path}/{name}") for name in ("even", "odd", "noise", "missing")]
    both = margin_csv.read_margin_csv(spark, f"{path}/{{even,odd,noise}}")
    apart = read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])
    # Read one by one or together, the rows are the same.
    return rounded(both.intersectAll(apart))


@query("s7_margin_csv_round_trip", MARGIN_6)
def s7(spark, sf):
    """Write the table, read it back: nothing changes."""
    path = folder(spark, "margin-out")
    margin_csv.write_margin_csv(margin_table(spark, sf), path, scoped=True)
    return rounded(margin_csv.read_margin_csv(spark, path))


@query(
    "s8_result_tables",
    f"WITH {A} SELECT scope, as_of, scenario, composite, regime, coverage_pct FROM asmt",
)
def s8(spark, sf):
    """Write assessments partitioned by month, read them back."""
    path = folder(spark, "assessment")
    tables.write_result(score.assessment_table(assessed(spark, sf)), path)
    return tables.read_result(spark, path).select(
        "scope", "as_of", "scenario", "composite", "regime", "coverage_pct"
    )


@query(
    "s8_month_rewrite",
    f"WITH {A} SELECT scope, as_of, scenario, composite, regime, coverage_pct FROM asmt",
)
def s8_rewrite(spark, sf):
    """Two years hold wrong figures; they are written again, and once more: the others stay."""
    path = folder(spark, "assessment")
    right = score.assessment_table(assessed(spark, sf))
    wrong = F.col("as_of").between("1994-01-01", "1995-12-31")
    tables.write_result(right.withColumn("composite", F.when(wrong, -1.0).otherwise(F.col("composite"))), path, whole=True)
    for _ in range(2):
        tables.write_result(right.where(wrong), path)
    return tables.read_result(spark, path).select(
        "scope", "as_of", "scenario", "composite", "regime", "coverage_pct"
    )


def event_feed(spark, sf):
    return table(spark, sf, "events").select(
        F.lit("ALL").alias("scope"), F.lit("feed").alias("provider"),
        F.col("event_type").alias("series"), F.col("ts").alias("obs_ts"), "value",
    )


@query(
    "n1_daily_latest",
    f"""SELECT 'ALL' AS scope, 'feed' AS provider, event_type AS series, ts::DATE AS obs_date,
      {r6('arg_max(value, (ts, value))', 'value')} FROM events GROUP BY event_type, ts::DATE""",
)
def n1(spark, sf):
    return rounded(ingest.daily(event_feed(spark, sf)))


@query(
    "n2_drop_missing",
    f"""SELECT event_type AS series, ts::DATE AS obs_date, count(*) AS rows_kept,
      {r6('max(value)', 'top')} FROM events WHERE value >= 6 GROUP BY 1, 2""",
)
def n2(spark, sf):
    holes = event_feed(spark, sf).withColumn(
        "value",
        F.expr("case when value < 5 then null when value < 6 then double('NaN') else value end"),
    )
    kept = ingest.drop_missing(holes)
    return rounded(
        kept.groupBy("series", F.to_date("obs_ts").alias("obs_date")).agg(
            F.count("*").alias("rows_kept"), F.max("value").alias("top")
        )
    )


CATALOG_SQL = ", ".join(f"('{prov}', '{name}')" for name, prov, _ in P.CATALOG)


@query(
    "n3_missing_series",
    f"""WITH {market_sql(outages=True)}
    SELECT s.scope, c.provider, c.series FROM (SELECT DISTINCT scope FROM panel) s
      CROSS JOIN (VALUES {CATALOG_SQL}) c(provider, series)
      ANTI JOIN panel p ON p.scope = s.scope AND p.provider = c.provider AND p.series = c.series""",
)
def n3(spark, sf):
    return ingest.missing_series(market(spark, sf, outages=True))


RECOVERED = "series in ('SPX', 'VIX') and obs_date >= date '1997-01-01'"


@query(
    "n4_recovery_merge",
    f"""WITH {PANEL}, rec AS (SELECT scope, provider, series, obs_date, value * 2.0 AS value
      FROM panel WHERE {RECOVERED})
    SELECT scope, provider, series, obs_date, {r6('value')} FROM panel
      ANTI JOIN rec USING (scope, provider, series)
    UNION ALL SELECT scope, provider, series, obs_date, {r6('value')} FROM rec""",
)
def n4(spark, sf):
    batch = market(spark, sf)
    recovered = batch.where(RECOVERED).withColumn("value", F.col("value") * 2.0)
    return rounded(ingest.replace_series(batch, recovered))


@query(
    "n5_series_names",
    f"WITH {PANEL} SELECT scope, provider, series, obs_date, {r6('value')} FROM panel",
)
def n5(spark, sf):
    """Symbols to names; rows with unknown symbols fall away."""
    symbol = F.element_at(F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv]), F.col("series"))
    known = market(spark, sf).withColumn("symbol", symbol).drop("series")
    unknown = priority_panel(spark, sf).withColumnRenamed("series", "symbol")
    out = ingest.name_series(known.unionByName(unknown)).drop("symbol")
    return rounded(out.select("scope", "provider", "series", "obs_date", "value"))


@query(
    "n6_margin_clean",
    f"""WITH {MARGIN_SQL} SELECT scope, month,
      CASE WHEN month(month) = 3 THEN NULL ELSE {'round(debit_balances_musd, 6)'} END AS debit_balances_musd,
      {r6('free_credit_cash_musd')}, NULL::DOUBLE AS free_credit_margin_musd, is_placeholder
    FROM margin WHERE month(month) <> 2""",
)
def n6(spark, sf):
    """Untidy headers, an extra and a missing column, bad numbers, bad months."""
    m = margin_table(spark, sf)
    raw = m.select(
        F.col("scope").alias("Scope"),
        F.expr("if(month(month) = 2, 'soon', if(month(month) = 4, date_format(month, 'MM/dd/yyyy'), cast(month as string)))").alias(" Month "),
        F.expr("if(month(month) = 3, '1,234', cast(debit_balances_musd as string))").alias("DEBIT_BALANCES_MUSD"),
        F.col("free_credit_cash_musd").cast("string").alias("Free_Credit_Cash_MUSD "),
        F.expr("if(is_placeholder, ' Yes', 'no')").alias("Is_Placeholder"),
        F.lit("x").alias("remark"),
    )
    return rounded(margin_csv.clean_margin(raw))


FLAG_SPARK = """case o_orderpriority when '1-URGENT' then ' TRUE ' when '2-HIGH' then 'Yes'
  when '3-MEDIUM' then '1' when '5-LOW' then null else o_orderstatus end"""


@query(
    "n7_truthy",
    """SELECT o_orderkey, coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'), false)
      AS flag FROM orders""",
)
def n7(spark, sf):
    flag = margin_csv.truthy(F.expr(FLAG_SPARK))
    return table(spark, sf, "orders").select("o_orderkey", flag.alias("flag"))


RESCALE_DATES = ("1996-02-15", "1996-09-30", "2001-12-31")


@query(
    "n8_yield_rescale",
    f"""WITH {market_sql(outages=True)}, c AS (
      SELECT *, arg_max(value, n) OVER (PARTITION BY as_of, scope, series) AS latest FROM panel
      JOIN (VALUES {', '.join(f"(DATE '{d}')" for d in RESCALE_DATES)}) a(as_of) ON obs_date <= as_of
      WHERE series IN ('US10Y_YF', 'US30Y_YF'))
    SELECT as_of, scope, provider, series, obs_date,
      {r6('CASE WHEN latest > 20 THEN value / 10.0 ELSE value END', 'value')} FROM c""",
)
def n8(spark, sf):
    """Judged as of a date within the tenfold time, one after it, and the last of all."""
    obs, out = market(spark, sf, outages=True), None
    for d in RESCALE_DATES:
        known = obs.where(F.col("obs_date") <= F.lit(d).cast("date"))
        part = ingest.rescale_yields(known, ["US10Y_YF", "US30Y_YF"]).withColumn("as_of", F.lit(d).cast("date"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query(
    "n9_feed_status",
    f"""WITH {A} SELECT scope, as_of, scenario, CASE
      WHEN NOT quotes_seen AND NOT official_seen THEN 'no_data'
      WHEN NOT quotes_seen THEN 'quotes_empty'
      WHEN missing <> '' THEN 'missing: ' || missing ELSE 'ok' END AS feed_status FROM asmt""",
)
def n9(spark, sf):
    return ingest.feed_status(assessed(spark, sf))


@query(
    "n10_freshness",
    f"""WITH {market_sql(outages=True)}, e AS (
      SELECT scope, max(obs_date) FILTER (WHERE series = 'USDJPY') AS usdjpy_as_of,
        max(obs_date) FILTER (WHERE series = 'US10Y') AS us10y_as_of,
        max(obs_date) FILTER (WHERE series = 'VIX') AS vix_as_of FROM panel GROUP BY 1)
    SELECT *, greatest(usdjpy_as_of, us10y_as_of, vix_as_of) AS newest FROM e""",
)
def n10(spark, sf):
    return ingest.freshness(market(spark, sf, outages=True))


HOLED = "day(obs_date) % 10 = 0"


@query(
    "n_quality_in_one_pass",
    f"""WITH {market_sql(outages=True)}, q AS (SELECT *, NOT ({HOLED}) AS good FROM panel),
    gone AS (SELECT c.series FROM (VALUES {", ".join(f"('{name}', {i})" for i, (name, _, _) in enumerate(P.CATALOG))}) c(series, i)
      WHERE c.series NOT IN (SELECT series FROM q WHERE good) ORDER BY i)
    SELECT count(*) AS rows, count(*) FILTER (WHERE NOT good) AS missing_rows,
      count(*) FILTER (WHERE good AND provider = 'yahoo') AS quote_rows,
      count(*) FILTER (WHERE good AND provider = 'fred') AS official_rows,
      max(obs_date) FILTER (WHERE good AND series IN ('USDJPY', 'US10Y', 'VIX')) AS newest,
      'missing: ' || (SELECT string_agg(series, ', ') FROM gone) AS feed_status FROM q""",
)
def n_quality(spark, sf):
    """Row counts, holes, newest date and feed status, observed while the panel is written."""
    holes = F.when(F.expr(HOLED), F.lit(float("nan"))).otherwise(F.col("value"))
    obs = market(spark, sf, outages=True).withColumn("value", holes)
    seen = tables.save_months(obs, folder(spark, "panel"), metrics=ingest.quality_metrics())
    kinds = "rows long, missing_rows long, quote_rows long, official_rows long, newest date, feed_status string"
    return spark.createDataFrame([ingest.quality_report(seen)], kinds)
