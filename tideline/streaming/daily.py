"""Landed rows to the current daily panel as a stateful stream.

Each series keeps the number of its newest replace load and, for each day of its load window, what
counts there: the newest load's latest stamp, of equal ones the larger value. Rows change that state
in whatever order, batch or file they come, and however often: only a row that beats what is held
does anything. What comes out are changes: a day's new value, or null where a replace load took the
series' place and lacks the day. Every change carries the series' running ``version``; the panel is
the last version of each day (:func:`current`).

Late rows: a day that lies more than the load window before the newest day the stream has seen is
outside every load; such rows are left out, and a timer drops such days from the state, so a series
holds at most as many days as the window. What was given out for them stays given out.

Rows reach the state in pandas batches, a series at a time; state lies in RocksDB, kept in the
progress folder. ``refresh`` is the form that also scores; this one keeps a panel table alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tideline import params as P
from tideline.functions.frames import SERIES_KEYS
from tideline.operators import ingest
from tideline.streaming.refresh import LANDING_SCHEMA, REPLACE

CHANGES = "scope string, provider string, series string, obs_date date, value double, version bigint"
EPOCH = dt.date(1970, 1, 1)
DAY_MS = 86_400_000
#: Provider that transformWithState needs for its state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestLoads(StatefulProcessor):
    """State of one series: see the module."""

    def __init__(self, window_days: int):
        self.window_ms = window_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "base bigint, version bigint")
        self.days = handle.getMapState("days", "day int", "load_id bigint, stamp bigint, value double")

    def _changed(self, key, changes: dict, version: int) -> pd.DataFrame:
        days = sorted(changes)
        return pd.DataFrame(
            {
                "scope": key[0], "provider": key[1], "series": key[2], "obs_date": [EPOCH + dt.timedelta(d) for d in days],
                "value": pd.array([changes[d] for d in days], dtype="Float64"), "version": version,
            }
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base, version = self.head.get() if self.head.exists() else (None, 0)
        low = timerValues.getCurrentWatermarkInMs() // DAY_MS
        held = {k[0]: tuple(v) for k, v in self.days.iterator()} if self.days.exists() else {}
        changes: dict[int, float | None] = {}
        for part in rows:
            loads = part.loc[part["kind"] == REPLACE, "load_id"]
            if len(loads) and (base is None or int(loads.max()) > base):
                base = int(loads.max())
                for day in [d for d, (load, _, _) in held.items() if load < base]:
                    del held[day]
                    self.days.removeKey((day,))
                    changes[day] = None
            for day, load, stamp, value in zip(part["day"].tolist(), part["load_id"].tolist(), part["stamp"].tolist(), part["value"].tolist()):
                new = (load, stamp, value)
                if day < low or (base is not None and load < base) or (day in held and held[day] >= new):
                    continue
                if day not in held or held[day][2] != value or changes.get(day, 0) is None:
                    changes[day] = value
                held[day] = new
                self.days.updateValue((day,), new)
        if changes:
            version += 1
            yield self._changed(key, changes, version)
        self.head.update((base, version))
        self._next_timer(held)

    def _next_timer(self, held: dict) -> None:
        """One timer, for the oldest day held."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer((min(held) + 1) * DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        low = timerValues.getCurrentWatermarkInMs() // DAY_MS
        held = {k[0]: tuple(v) for k, v in self.days.iterator()}
        for day in [d for d in held if d < low]:
            del held[day]
            self.days.removeKey((day,))
        self._next_timer(held)
        return iter(())

    def close(self) -> None:
        pass


def changes(landed: DataFrame, window_days: int = P.HISTORY_DAYS) -> DataFrame:
    """Changes of the daily panel from a stream of landed rows (``refresh.LANDING_SCHEMA``)."""
    rows = ingest.drop_missing(landed).where("scope is not null and provider is not null and series is not null and obs_ts is not null").select(
        *SERIES_KEYS, F.unix_date(F.to_date("obs_ts")).alias("day"), F.unix_micros(F.col("obs_ts").cast("timestamp")).alias("stamp"),
        "value", F.coalesce("load_id", F.lit(0)).alias("load_id"), F.coalesce("kind", F.lit(REPLACE)).alias("kind"),
        F.col("obs_ts").cast("timestamp").alias("event"),
    )
    return (
        rows.withWatermark("event", f"{window_days} days").groupBy(*SERIES_KEYS)
        .transformWithStateInPandas(NewestLoads(window_days), CHANGES, outputMode="Update", timeMode="EventTime")
    )


def keep_panel(spark: SparkSession, landing: str, table: str, window_days: int = P.HISTORY_DAYS, max_files: int | None = None) -> None:
    """Append the changes of all that has landed since the last run to the folder ``table``. A batch's
    rows lie under its own number, so a retried batch replaces what it wrote."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/changes/batch={number}")

    (
        changes(reader.parquet(landing), window_days).writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", f"{table}/_progress").trigger(availableNow=True).start().awaitTermination()
    )


def current(spark: SparkSession, table: str) -> DataFrame:
    """The panel: scope, provider, series, obs_date, value of each day's last version."""
    rows = spark.read.schema(CHANGES + ", batch bigint").parquet(f"{table}/changes")
    last = rows.groupBy(*SERIES_KEYS, "obs_date").agg(F.max(F.struct("version", "value")).alias("m"))
    return last.where("m.value is not null").select(*SERIES_KEYS, "obs_date", F.col("m.value").alias("value"))
