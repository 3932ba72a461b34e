"""Table sinks: the observation panel and the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Where that is unset, as in tests, the warehouse, which executors share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def save_panel(obs: DataFrame, table: str, buckets: int) -> None:
    """Save observations bucketed and sorted by series.

    Series windows over the saved table need neither a shuffle nor a sort.
    """
    (
        obs.repartition(buckets, "scope", "provider", "series")
        .write.mode("overwrite")
        .bucketBy(buckets, "scope", "provider", "series")
        .sortBy("scope", "provider", "series", "obs_date")
        .saveAsTable(table)
    )


def save_months(obs: DataFrame, path: str, whole: bool = True, metrics: list[Column] | None = None) -> dict:
    """Save observations partitioned by month, each month split over several files by scope.

    A load of some days then reads the folders of their months only. ``whole=False`` replaces the
    months that ``obs`` has rows of and leaves the others. ``metrics`` (aggregates, such as
    :func:`operators.ingest.quality_metrics`) are observed in the tasks that write, after the shuffle,
    so that a lost executor's repeated work counts once; their values are returned.
    """
    observation = Observation() if metrics else None
    _by_month(obs, path, "obs_date", "obs_month", whole, observation, metrics)
    return observation.get if metrics else {}


def load_months(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_result(df: DataFrame, path: str, date_col: str = "as_of", whole: bool = False) -> None:
    """Write a result table partitioned by month of its date, one shuffle to cluster files.

    Rows of one month go to several tasks (split by scope), so a month with many scopes does
    not end up in a single writer. Only the months that ``df`` has rows of are replaced, so a rerun
    of one month leaves the others as they are and gives the same however often it runs;
    ``whole`` replaces the table.
    """
    _by_month(df, path, date_col, f"{date_col}_month", whole)


def _by_month(
    df: DataFrame, path: str, date_col: str, month_col: str, whole: bool,
    observation: Observation | None = None, metrics: list[Column] | None = None,
) -> None:
    rows = df.withColumn(month_col, F.trunc(date_col, "month")).repartition(month_col, F.pmod(F.xxhash64("scope"), F.lit(32)))
    if observation is not None:
        rows = rows.observe(observation, *metrics)
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy(month_col)
        .parquet(path)
    )


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
