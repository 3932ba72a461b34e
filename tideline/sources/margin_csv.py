"""The monthly margin table as CSV: tolerant reader, cleaner, writer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import params as P

MARGIN_SCHEMA = (
    "scope string, month date, debit_balances_musd double, free_credit_cash_musd double, "
    "free_credit_margin_musd double, is_placeholder boolean"
)
# Month formats accepted in the file
MONTH_FORMATS = [
    "yyyy-M-d", "yyyy-M", "yyyy/M/d", "yyyy/M", "M/d/yyyy", "M/yyyy", "yyyyMMdd", "MMM yyyy",
    "MMMM yyyy", "MMM-yyyy", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy",
    "MMMM d, yyyy",
]
NUMBERS = ["debit_balances_musd", "free_credit_cash_musd", "free_credit_margin_musd"]


def empty_margin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MARGIN_SCHEMA)


def raw_margin_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """Text columns by their own file's header, which may differ between files; None if missing.

    A file is one hand-kept monthly table and is read as one row. Everything after ``#`` outside
    quotes is a comment, empty lines are skipped, the first line left is the header. Names are
    trimmed and in any case; a column that a file lacks is null in its rows.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    bare = lambda x: F.rtrim(F.regexp_replace(x, r'^((?:[^"#]|"[^"]*")*)#.*$', "$1"))
    lines = F.filter(F.transform(F.split("value", "\r?\n"), bare), lambda x: F.trim(x) != "")
    # Commas inside quotes do not part cells; a quote inside quotes is doubled.
    parted = lambda c: F.split(c, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    plain = lambda x: F.replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    rows = (
        files.select(lines.alias("lines")).where(F.size("lines") > 1)
        .select(
            F.transform(parted(F.element_at("lines", 1)), lambda x: F.lower(F.trim(plain(x)))).alias("h"),
            F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"),
        )
        .select("h", F.transform(parted(F.col("line")), plain).alias("r"))
    )

    def named(name: str) -> Column:
        at = F.coalesce(F.array_position("h", name), F.lit(0)).cast("int")
        return F.when(at > 0, F.get("r", at - 1)).alias(name)

    return rows.select(*map(named, ("scope", "month", *NUMBERS, "is_placeholder")))


def read_margin_csv(spark: SparkSession, path: str, scope: str = "ALL") -> DataFrame:
    """Read and clean; a missing or unreadable file gives an empty table."""
    raw = raw_margin_csv(spark, path)
    if raw is None:
        return empty_margin(spark)
    return clean_margin(raw.withColumn("scope", F.coalesce(F.nullif(F.trim("scope"), F.lit("")), F.lit(scope))), scope)


def unread_months(raw: DataFrame) -> DataFrame:
    """How many rows with a month text :func:`clean_margin` drops because no format fits."""
    by_name = {c.strip().lower(): c for c in raw.columns}
    text = F.col(f"`{by_name['month']}`") if "month" in by_name else F.lit(None).cast("string")
    return raw.agg(F.count_if((F.trim(text) != "") & parse_month(text).isNull()).alias("unread_months"))


def truthy(c):
    """true/1/yes/y in any case, trimmed; anything else, null included, is false."""
    word = F.lower(F.trim(c.cast("string")))
    return F.coalesce(word.isin(P.MARGIN_TRUE_WORDS), F.lit(False))


def parse_month(c):
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_date(text, f) for f in MONTH_FORMATS], text.try_cast("date"))


def parse_number(c):
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def clean_margin(raw: DataFrame, scope: str = "ALL") -> DataFrame:
    """Repair headers and types. Bad numbers become null, rows without a month go."""
    by_name = {c.strip().lower(): c for c in raw.columns}
    if "month" not in by_name:
        return empty_margin(raw.sparkSession)

    def column(name):
        if name not in by_name:
            return F.lit(None).cast("string")
        return F.col(f"`{by_name[name]}`")

    scope_col = column("scope") if "scope" in by_name else F.lit(scope)
    return raw.select(
        scope_col.alias("scope"),
        parse_month(column("month")).alias("month"),
        *[parse_number(column(n)).alias(n) for n in NUMBERS],
        truthy(column("is_placeholder")).alias("is_placeholder"),
    ).where(F.col("month").isNotNull())


def margin_csv_rows(margin: DataFrame, scoped: bool = False) -> DataFrame:
    """The rows as they are written: first of the month, upper-case flags. ``scoped`` adds the
    scope as a first column, for a table of several scopes."""
    return margin.select(
        *(["scope"] if scoped else []),
        F.concat(F.date_format("month", "yyyy-MM"), F.lit("-01")).alias("month"),
        *NUMBERS,
        F.upper(F.col("is_placeholder").cast("string")).alias("is_placeholder"),
    )


def write_margin_csv(margin: DataFrame, path: str, scoped: bool = False) -> None:
    """Write under ``path``; the comment prelude goes to a side folder next to it."""
    margin_csv_rows(margin, scoped).write.mode("overwrite").option("header", True).csv(path)
    spark = margin.sparkSession
    prelude = spark.range(1).select(F.explode(F.array(*map(F.lit, P.MARGIN_PRELUDE))))
    prelude.coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_prelude")
