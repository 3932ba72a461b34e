"""Readers for landed daily series: wide files, field layouts, long files.

Each returns raw rows ``(provider, symbol, obs_ts, value)``; ``operators.ingest`` turns them
into daily observations.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import params as P
from tideline.operators.ingest import load_bound

LEVEL_SEPARATOR = "|"
CLOSE = "Close"
#: Headers read at once.
HEADER_READERS = 16

RAW_SCHEMA = "obs_ts timestamp_ntz, symbol string, value double, provider string"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _files(spark: SparkSession, path: str | list[str]) -> list[str]:
    return sorted(unquote(f) for f in spark.read.text(path).inputFiles())


def header_groups(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Header -> the CSV files that start with it. Of each file its first line comes to the driver,
    which lists the files anyway; a file without a line has no header and no rows."""

    def header(file: str) -> tuple[str, ...]:
        first = spark.read.text(file).head()
        return () if first is None else tuple(c.strip() for c in next(csv.reader([first[0].lstrip("\ufeff")]), []))

    files = _files(spark, path)
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        found = list(pool.map(header, files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, file in zip(found, files):
        if name:
            groups.setdefault(name, []).append(file)
    return groups


def _csv_parts(spark: SparkSession, path: str | list[str]) -> Iterator[tuple[DataFrame, list[tuple[str, str]]]]:
    """(rows, their (column, name in the header)) of the files of each header. Columns are named by
    place, so a header may repeat a name or hold names that differ in case only."""
    for header, files in header_groups(spark, path).items():
        columns = [f"c{i}" for i in range(len(header))]
        rows = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in columns)).csv(files)
        yield rows, list(zip(columns, header))


def _parquet_parts(spark: SparkSession, path: str | list[str]) -> Iterator[tuple[DataFrame, list[tuple[str, str]]]]:
    """Parquet names its columns in every file: one read over the union of all schemas, or where
    files disagree on a type, one read for the files of each schema."""
    paths = [path] if isinstance(path, str) else path
    try:
        parts = [spark.read.option("mergeSchema", True).parquet(*paths)]
    except (PySparkException, Py4JJavaError):
        files = _files(spark, path)
        with ThreadPoolExecutor(HEADER_READERS) as pool:
            schemas = list(pool.map(lambda f: spark.read.parquet(f).schema, files))
        by_schema: dict[str, list[str]] = {}
        for schema, file in zip(schemas, files):
            by_schema.setdefault(schema.json(), []).append(file)
        parts = [spark.read.parquet(*group) for group in by_schema.values()]
    for rows in parts:
        yield rows, [(c, c) for c in rows.columns]


def read_wide(
    spark: SparkSession,
    path: str | list[str],
    provider: str,
    date_col: str = "date",
    fmt: str = "parquet",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per date, one column per symbol, as (kept columns, obs_ts, symbol, value, provider).

    Every file's columns are found by its own header, never by their place among another file's:
    files may hold other symbols, or the same in another order, and the result is the union of
    all. CSV is read without schema inference. A file without the date column has no dated rows and
    gives none; a kept column that it lacks is null; a path without files gives no rows.
    """
    parts = []
    try:
        for rows, columns in (_csv_parts if fmt == "csv" else _parquet_parts)(spark, path):
            names = {name: column for column, name in reversed(columns)}
            if date_col not in names:
                continue
            carried = [(F.col(quoted(names[k])) if k in names else F.lit(None)).cast("string").alias(k) for k in keep or []]
            symbols = [(c, name) for c, name in columns if name != date_col and name not in (keep or []) and name]
            parts.append(_long(rows, F.col(quoted(names[date_col])), carried, symbols, provider))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    if not parts:
        return spark.createDataFrame([], "".join(f"{k} string, " for k in keep or []) + RAW_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def _long(wide: DataFrame, date, carried: list, symbols: list[tuple[str, str]], provider: str) -> DataFrame:
    """A row for each date and (column, symbol); text that is no date or number becomes null."""
    cells = [
        F.struct(F.lit(symbol).alias("symbol"), F.col(quoted(c)).try_cast("double").alias("value")) for c, symbol in symbols
    ] or [F.struct(F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("double").alias("value"))]
    return (
        wide.select(*carried, date.try_cast("timestamp_ntz").alias("obs_ts"), F.explode(F.array(*cells)).alias("cell"))
        .select("*", "cell.symbol", "cell.value").drop("cell").where("symbol is not null")
        .withColumn("provider", F.lit(provider))
    )


def unpivot_wide(
    wide: DataFrame, provider: str, date_col: str = "date", keep: list[str] | None = None
) -> DataFrame:
    carried = [c for c in (keep or [])]
    symbols = [(c, c) for c in wide.columns if c != date_col and c not in carried]
    return _long(wide, F.col(quoted(date_col)), [F.col(quoted(c)) for c in carried], symbols, provider)


def close_columns(columns: list[str], expected: list[str], date_col: str = "date") -> dict:
    """Map file column -> symbol for the three layouts a quote file can have.

    ``Close|SYM`` (field first), ``SYM|Close`` (symbol first), or flat fields. A flat file
    names no symbol, so it is only usable when exactly one symbol was asked for.
    """
    names = [c for c in columns if c != date_col]
    split = {c: tuple(c.split(LEVEL_SEPARATOR, 1)) for c in names if LEVEL_SEPARATOR in c}
    if split:
        field_first = any(first == CLOSE for first, _ in split.values())
        if field_first:
            return {c: second for c, (first, second) in split.items() if first == CLOSE}
        return {c: first for c, (first, second) in split.items() if second == CLOSE}
    if len(expected) != 1 or not names:
        return {}
    return {CLOSE if CLOSE in names else names[0]: expected[0]}


def extract_close(
    wide: DataFrame, expected: list[str], provider: str = P.QUOTES, date_col: str = "date",
    keep: list[str] | None = None,
) -> DataFrame:
    carried = keep or []
    chosen = close_columns([c for c in wide.columns if c not in carried], expected, date_col)
    return _long(wide, F.col(quoted(date_col)), [F.col(quoted(c)) for c in carried], list(chosen.items()), provider)


def within_history(obs: DataFrame, as_of, days: int = P.HISTORY_DAYS) -> DataFrame:
    """Rows a load at ``as_of`` would see. Literal dates, so partitions prune."""
    day = F.lit(as_of).cast("date")
    return load_bound(obs, F.date_sub(day, days), day)
