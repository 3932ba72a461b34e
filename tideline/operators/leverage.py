"""Leverage metrics from the monthly margin table.

``margin``: scope, month, three balances, is_placeholder. Result: one row per month that
could change what a reader knows, i.e. every month of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import params as P
from tideline.functions import series as S
from tideline.functions.frames import START

DEBIT = "debit_balances_musd"
CASH = "free_credit_cash_musd"
CREDIT = "free_credit_margin_musd"


def monthly(margin: DataFrame) -> DataFrame:
    """One row per month. Of duplicate months the largest debit counts; a placeholder flag
    on any of them counts."""
    rank = F.struct(
        F.col(DEBIT).isNotNull().alias("has"), F.col(DEBIT), F.col(CASH), F.col(CREDIT)
    )
    return (
        margin.groupBy("scope", "month")
        .agg(F.max(rank).alias("m"), F.max("is_placeholder").alias("is_placeholder"))
        .select(
            "scope", "month", f"m.{DEBIT}", f"m.{CASH}", f"m.{CREDIT}", "is_placeholder"
        )
    )


def base_months_back(months: int) -> Column:
    """Debit of the last month at or before ``months`` earlier; month ends are clipped."""
    return F.expr(
        f"last({DEBIT}, true) over (partition by scope order by month range between "
        f"unbounded preceding and interval {months} month preceding)"
    )


def month_changes(table: DataFrame) -> DataFrame:
    """Change against 12 and 1 months earlier, tolerant of missing months, and against 12
    rows earlier, which is not."""
    w = Window.partitionBy("scope").orderBy("month")
    return (
        table.where(F.col(DEBIT).isNotNull())
        .withColumn("yoy_pct", S.pct_between(F.col(DEBIT), base_months_back(12)))
        .withColumn("mom_pct", S.pct_between(F.col(DEBIT), base_months_back(1)))
        .withColumn("yoy_rows_pct", S.pct_between(F.col(DEBIT), F.lag(DEBIT, 12).over(w)))
    )


def net_credit(debit: Column, cash: Column, credit: Column) -> Column:
    """Free credit minus debit; null when neither credit figure is known."""
    zero = F.lit(0.0)
    return F.when(
        F.coalesce(cash, credit).isNotNull(),
        F.coalesce(cash, zero) + F.coalesce(credit, zero) - debit,
    )


def share_of_cap(debit: Column, index_level: Column) -> Column:
    cap = index_level * P.INDEX_CAP_BN_PER_POINT * 1000.0
    return F.when(cap > 0.0, debit / cap * 100.0)


def leverage_history(margin: DataFrame) -> DataFrame:
    """What the table says as of each month. Months without a debit repeat the last known
    figures but can raise the placeholder flag."""
    w = Window.partitionBy("scope").orderBy("month")
    upto = w.rowsBetween(START, 0)
    debit, month = F.col(DEBIT), F.col("month")
    has_debit = debit.isNotNull()
    figures = [
        "latest_month", "latest_debit_musd", "yoy_pct", "mom_pct", "pct_of_peak",
        "peak_month", "net_credit_musd",
    ]
    measured = (
        monthly(margin)
        .withColumn("_base12", base_months_back(12))
        .withColumn("_base1", base_months_back(1))
        .withColumn("_record", S.record_month(debit, month, w))
        .withColumn("is_placeholder", F.max("is_placeholder").over(upto))
        .withColumn(
            "_now",
            F.when(
                has_debit,
                F.struct(
                    month.alias("latest_month"),
                    debit.alias("latest_debit_musd"),
                    S.pct_between(debit, F.col("_base12")).alias("yoy_pct"),
                    S.pct_between(debit, F.col("_base1")).alias("mom_pct"),
                    (F.try_divide(debit, F.col("_record.peak")) * 100.0).alias("pct_of_peak"),
                    F.date_from_unix_date(-F.col("_record.neg_day")).alias("peak_month"),
                    net_credit(debit, F.col(CASH), F.col(CREDIT)).alias("net_credit_musd"),
                ),
            ),
        )
    )
    carried = measured.withColumn("_now", F.last("_now", ignorenulls=True).over(upto))
    known = F.col("_now").isNotNull()
    return carried.select(
        "scope",
        "month",
        *[F.col(f"_now.{c}").alias(c) for c in figures],
        # Without any debit the table counts as placeholder.
        (F.col("is_placeholder") | ~known).alias("is_placeholder"),
        (known & ~F.col("is_placeholder")).alias("usable"),
    )


def leverage_latest(margin: DataFrame, index_level: DataFrame) -> DataFrame:
    """Snapshot: the last month's figures with the share of market cap.

    ``index_level``: scope, spx.
    """
    last = (
        leverage_history(margin)
        .groupBy("scope")
        .agg(F.max_by(F.struct("*"), "month").alias("s"))
        .select("s.*")
    )
    return (
        last.join(index_level, "scope", "left")
        .withColumn(
            "pct_of_spx_mktcap", share_of_cap(F.col("latest_debit_musd"), F.col("spx"))
        )
        .drop("spx")
    )
