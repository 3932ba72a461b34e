"""Panels derived from the given tables, each as a Spark plan and as SQL.

Prices and discounts are summed as whole cents and hundredths, so both engines see the same
doubles whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the market panel; position in the list is l_orderkey % 28
MARKET = [
    ("USDJPY", "yahoo", 150.0, 0.6), ("AUDJPY", "yahoo", 100.0, 0.8),
    ("NZDJPY", "yahoo", 90.0, 0.8), ("MXNJPY", "yahoo", 8.0, 1.0),
    ("EURJPY", "yahoo", 160.0, 0.6), ("SPX", "yahoo", 5000.0, 0.8),
    ("TLT", "yahoo", 95.0, 0.5), ("VIX", "yahoo", 20.0, 10.0),
    ("VIX3M", "yahoo", 21.0, 6.0), ("MOVE", "yahoo", 100.0, 8.0),
    ("WTI", "yahoo", 75.0, 3.0), ("GOLD", "yahoo", 2400.0, 0.6),
    ("COPPER", "yahoo", 4.2, 1.0), ("HYG", "yahoo", 78.0, 0.5),
    ("LQD", "yahoo", 108.0, 0.3), ("US10Y_YF", "yahoo", 4.1, 3.0),
    ("US30Y_YF", "yahoo", 4.4, 2.5), ("US2Y", "fred", 3.9, 3.0),
    ("US10Y", "fred", 4.1, 3.0), ("US30Y", "fred", 4.4, 2.5),
    ("CURVE_10_2", "fred", 0.4, 30.0), ("FED_FUNDS", "fred", 4.0, 1.0),
    ("HY_OAS", "fred", 4.2, 8.0), ("VIX_FRED", "fred", 20.0, 10.0),
    ("WTI_FRED", "fred", 75.0, 3.0), ("JP10Y_MONTHLY", "fred", 1.6, 4.0),
    ("JP_OVERNIGHT", "fred", 0.5, 4.0), ("JP3M_MONTHLY", "fred", 0.7, 4.0),
]

# Feeds that start late or stop early, so that every fallback is taken on some dates.
OUTAGES = """
  not (series = 'MOVE' and obs_date >= date '1998-01-01')
  and not (series = 'HY_OAS' and obs_date < date '1998-01-01')
  and not (series = 'US10Y' and obs_date < date '1996-06-01')
  and not (series = 'US30Y' and obs_date < date '1996-06-01')
  and not (series = 'CURVE_10_2' and obs_date < date '1996-09-01')
  and not (series in ('VIX', 'WTI') and obs_date < date '1995-09-01')
  and not (series = 'FED_FUNDS' and obs_date < date '1995-06-01')
  and not (series in ('JP10Y_MONTHLY', 'JP3M_MONTHLY') and obs_date >= date '1997-03-01')
  and not (series = 'LQD' and obs_date < date '1995-03-01')
"""
# A yield quoted tenfold for a while.
TENFOLD = "series = 'US10Y_YF' and obs_date < date '1996-03-01'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both_scopes(nation: str) -> Column:
    """ALL and the nation's own scope, a row each."""
    return F.explode(F.array(F.lit("ALL"), F.concat(F.lit("N"), F.col(nation).cast("string"))))


def market(spark: SparkSession, sf_dir: str, outages: bool = False) -> DataFrame:
    """obs for scope ALL and one scope per supplier nation."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    hundredths = F.round(F.col("l_discount") * 100).cast("bigint")
    # Whole numbers, so nations add up to ALL: lines are not doubled, their daily sums are.
    daily = (
        table(spark, sf_dir, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            (F.col("l_orderkey") % 28).cast("int").alias("idx"),
            F.to_date("l_shipdate").alias("obs_date"),
            hundredths.alias("h"),
            "s_nationkey",
        )
        .groupBy("s_nationkey", "idx", "obs_date")
        .agg(F.sum("h").alias("h"), F.count("*").alias("c"))
        .withColumn("scope", both_scopes("s_nationkey"))
        .groupBy("scope", "idx", "obs_date")
        .agg(F.sum("h").alias("h"), F.sum("c").alias("c"))
    )

    def spec(i):
        return F.element_at(F.array(*[F.lit(m[i]) for m in MARKET]), F.col("idx") + 1)

    mean = F.col("h") / (F.lit(100.0) * F.col("c"))
    obs = daily.select(
        "scope", spec(1).alias("provider"), spec(0).alias("series"), "obs_date",
        (F.round(spec(2) * (F.lit(1.0) + spec(3) * (mean - 0.05)), 9) + 0.0).alias("value"),
    )
    if outages:
        obs = obs.where(OUTAGES).withColumn(
            "value", F.expr(f"case when {TENFOLD} then value * 10.0D else value end")
        )
    return obs


def market_sql(outages: bool = False, name: str = "panel") -> str:
    specs = ", ".join(
        f"({i}, '{s}', '{p}', {b}::DOUBLE, {a}::DOUBLE)" for i, (s, p, b, a) in enumerate(MARKET)
    )
    mean = "h::DOUBLE / (100.0::DOUBLE * c::DOUBLE)"
    value = f"round(base * (1.0::DOUBLE + amp * ({mean} - 0.05::DOUBLE)), 9) + 0.0::DOUBLE"
    plain = f"""
      SELECT scope, provider, series, obs_date, {value} AS value
      FROM (
        SELECT scope, idx, obs_date, sum(h) AS h, sum(c) AS c
        FROM (
          SELECT 'N' || s_nationkey::VARCHAR AS scope, l_orderkey % 28 AS idx,
                 l_shipdate::DATE AS obs_date,
                 round(l_discount * 100)::BIGINT AS h, 1 AS c
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
          UNION ALL
          SELECT 'ALL', l_orderkey % 28, l_shipdate::DATE,
                 round(l_discount * 100)::BIGINT, 1
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        ) GROUP BY scope, idx, obs_date
      ) JOIN (VALUES {specs}) m(idx, series, provider, base, amp) USING (idx)"""
    if outages:
        plain = f"""
      SELECT scope, provider, series, obs_date,
             CASE WHEN {TENFOLD} THEN value * 10.0::DOUBLE ELSE value END AS value
      FROM ({plain}) WHERE {OUTAGES}"""
    return f"""{name} AS MATERIALIZED (
      SELECT scope, provider, series, obs_date, value, (obs_date - DATE '1970-01-01') AS n
      FROM ({plain}))"""


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier: mean price by ship date."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey"), F.to_date("l_shipdate").alias("obs_date"))
        .agg((F.sum(cents) / (F.lit(100.0) * F.count("*"))).alias("value"))
        .select(
            F.lit("ALL").alias("scope"), F.lit("desk").alias("provider"),
            F.col("l_suppkey").cast("string").alias("series"), "obs_date", "value",
        )
    )


WIDE_SQL = """panel AS MATERIALIZED (
      SELECT 'ALL' AS scope, 'desk' AS provider, l_suppkey::VARCHAR AS series,
             l_shipdate::DATE AS obs_date,
             sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE
               / (100.0::DOUBLE * count(*)::DOUBLE) AS value,
             (l_shipdate::DATE - DATE '1970-01-01') AS n
      FROM lineitem GROUP BY l_suppkey, l_shipdate::DATE)"""


def priority_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per order priority: mean order price by day."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", F.to_date("o_orderdate").alias("obs_date"))
        .agg((F.sum(cents) / (F.lit(100.0) * F.count("*"))).alias("value"))
        .select(
            F.lit("ALL").alias("scope"), F.lit("desk").alias("provider"),
            F.col("o_orderpriority").alias("series"), "obs_date", "value",
        )
    )


PRIORITY_SQL = """panel AS MATERIALIZED (
      SELECT 'ALL' AS scope, 'desk' AS provider, o_orderpriority AS series,
             o_orderdate::DATE AS obs_date,
             sum(round(o_totalprice * 100)::BIGINT)::DOUBLE
               / (100.0::DOUBLE * count(*)::DOUBLE) AS value,
             (o_orderdate::DATE - DATE '1970-01-01') AS n
      FROM orders GROUP BY o_orderpriority, o_orderdate::DATE)"""


# Nation scopes lack every fifth month; one region is example data for a while.
MARGIN_KEPT = "(scope = 'ALL' or month(month) % 5 <> 0)"
MARGIN_FLAG = "(scope = 'N7' and month < date '1996-01-01')"


def margin_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly balances for scope ALL and one scope per customer nation."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")

    def cents_of(status=None):
        return F.sum(cents if status is None else F.when(F.col("o_orderstatus") == status, cents))

    def balance(column):
        return F.sum(column) / F.lit(100.0)

    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
        .agg(cents_of().alias("debit"), cents_of("O").alias("cash"), cents_of("P").alias("margin"))
        .withColumn("scope", both_scopes("c_nationkey"))
        .groupBy("scope", "month")
        .agg(
            balance("debit").alias("debit_balances_musd"),
            balance("cash").alias("free_credit_cash_musd"),
            balance("margin").alias("free_credit_margin_musd"),
        )
        .where(MARGIN_KEPT)
        .withColumn("is_placeholder", F.expr(MARGIN_FLAG))
    )


def _balance(status=None):
    flt = f" FILTER (WHERE o_orderstatus = '{status}')" if status else ""
    return f"sum(cents){flt}::DOUBLE / 100.0::DOUBLE"


MARGIN_SQL = f"""margin AS MATERIALIZED (
      SELECT scope, month, debit_balances_musd, free_credit_cash_musd,
             free_credit_margin_musd, {MARGIN_FLAG} AS is_placeholder
      FROM (
        SELECT scope, month, {_balance()} AS debit_balances_musd,
               {_balance('O')} AS free_credit_cash_musd,
               {_balance('P')} AS free_credit_margin_musd
        FROM (
          SELECT unnest(['ALL', 'N' || c_nationkey::VARCHAR]) AS scope,
                 date_trunc('month', o_orderdate)::DATE AS month,
                 round(o_totalprice * 100)::BIGINT AS cents, o_orderstatus
          FROM orders JOIN customer ON o_custkey = c_custkey
        ) GROUP BY scope, month
      ) WHERE {MARGIN_KEPT})"""


def manual_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed inputs for some nations; ALL and the others have none."""
    nation = table(spark, sf_dir, "nation")
    scope = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    step = F.col("n_nationkey").cast("double")

    def rows(keep, key, value, source):
        return nation.where(keep).select(
            scope.alias("scope"), F.lit(key).alias("key"), value.alias("value"),
            F.lit(source).cast("string").alias("source"),
        )

    return (
        rows("n_regionkey <= 2", "JP2Y", F.lit(0.5) + step / 10.0, "desk entry")
        .unionByName(rows("n_regionkey >= 1", "JP10Y", F.lit(1.0) + step / 10.0, None))
        .unionByName(rows("n_regionkey = 3", "BOJ_RATE", F.lit(0.25), None))
        .unionByName(rows("n_regionkey = 4", "FED_FUNDS", F.lit(3.5), None))
    )


MANUAL_SQL = """manual AS MATERIALIZED (
      SELECT 'N' || n_nationkey::VARCHAR AS scope, 'JP2Y' AS key,
             0.5::DOUBLE + n_nationkey::DOUBLE / 10.0::DOUBLE AS value,
             'desk entry' AS source
      FROM nation WHERE n_regionkey <= 2
      UNION ALL
      SELECT 'N' || n_nationkey::VARCHAR, 'JP10Y',
             1.0::DOUBLE + n_nationkey::DOUBLE / 10.0::DOUBLE, NULL
      FROM nation WHERE n_regionkey >= 1
      UNION ALL
      SELECT 'N' || n_nationkey::VARCHAR, 'BOJ_RATE', 0.25::DOUBLE, NULL
      FROM nation WHERE n_regionkey = 3
      UNION ALL
      SELECT 'N' || n_nationkey::VARCHAR, 'FED_FUNDS', 3.5::DOUBLE, NULL
      FROM nation WHERE n_regionkey = 4)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and widen integers, so that a value hash compares like with like."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, digits)
        elif kind in ("int", "smallint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def r6(sql: str, name: str | None = None) -> str:
    return f"round({sql}, 6) AS {name or sql}"


def w(frame: str = "", keys: str = "scope, provider, series", order: str = "n") -> str:
    return f"(PARTITION BY {keys} ORDER BY {order} {frame})"


def base_at(days: int, col: str = "value", keys: str = "scope, provider, series") -> str:
    """SQL: last value at or before ``days`` days earlier."""
    frame = f"RANGE BETWEEN UNBOUNDED PRECEDING AND {days} PRECEDING"
    return f"last_value({col} IGNORE NULLS) OVER {w(frame, keys)}"


def pct(value: str, base: str) -> str:
    return f"(({value}) / nullif({base}, 0) - 1.0::DOUBLE) * 100.0::DOUBLE"
