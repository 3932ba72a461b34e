"""Refresh as a stream: pick up landed loads, keep what they replace or add, re-score their scopes.

Landed rows carry the load they belong to (``load_id``, growing) and its ``kind``. A ``replace``
load takes the place of the whole history of every series it holds; an ``append`` load adds days
or revises them. What counts is the load, never the micro-batch: the rows of one load are united
however many batches bring them.

The store only grows. Landed rows are kept as they came, one per series, day and load, and a
reader resolves them, so rows that a retried batch writes twice, or that come again because the
progress folder was lost, change nothing.

Scoring goes forward from what changed. A row of day d changes as-of dates from d on only, so with
each version of a scope's assessments the store keeps ``prints``: for every series, pair of series
and month the number of days and a mark of their values, likewise for margin months and manual
inputs. A refresh compares the prints of what landed with those that the scope was scored with,
restarts at the first month that differs and leaves earlier dates as they are. Day counts of the
months before tell how far back each series is needed for that (:func:`needed_from`): its last
day before the restart, the load window before that, and the rows that warm up deviations and
correlations. Nothing older is read. A series sent again whole restarts where its values differ.

A version counts once its ``restarts`` (scope, first date scored again) are written, last of all.
Each of its rows holds until a later version of the scope restarts at or before it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline import params as P
from tideline.functions.frames import SERIES_KEYS
from tideline.operators import ingest
from tideline.operators.features import CATALOGED, feature_history
from tideline.operators.score import assess, assessment_table

LANDING_SCHEMA = (
    "scope string, provider string, series string, obs_ts timestamp_ntz, value double, "
    "load_id bigint, kind string"
)
STORE_SCHEMA = LANDING_SCHEMA + ", obs_date date, bucket int, obs_year int"
REPLACE, APPEND = "replace", "append"
#: Folders that scopes are spread over, so that a refresh reads only some. A store keeps the
#: number it began with.
BUCKETS = 64
PRINTS_SCHEMA = "scope string, unit string, month date, mark decimal(38,0), n bigint, version int, bucket int"
RESTARTS_SCHEMA = "scope string, from_date date, version int"
#: Before and after all days.
BEGIN, NEVER = date(1600, 1, 1), date(9999, 1, 1)
#: Series of which features use the days that both have.
PAIRS = [("SPX", "TLT"), ("HYG", "LQD"), ("US10Y", "US2Y"), ("US10Y_YF", "US2Y")]
MARGIN_UNIT, MANUAL_UNIT = "(margin)", "(manual)"
#: Rows that a row's own figures reach back: 60 of a correlation, 21 of a deviation, 25 of a guard,
#: and the first of a load that have no row before them.
WARM_UP = 64

SideInputs = Callable[[SparkSession], tuple[DataFrame | None, DataFrame | None]]


def _stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException:
        return None


def buckets_of(spark: SparkSession, store: str, buckets: int = BUCKETS) -> int:
    """The store's number of buckets, written on first use."""
    held = _stored(spark, f"{store}/settings", "buckets int")
    if held is None:
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{store}/settings")
        return buckets
    return held.first()["buckets"]


def bucket_of(scope: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int")


def landed_days(batch: DataFrame) -> DataFrame:
    """One row per series, day and load: the latest stamp, of equal ones the larger value.
    Combined before its shuffle."""
    keys = [*SERIES_KEYS, "obs_date", "load_id", "kind"]
    rows = ingest.drop_missing(batch).withColumns({
        "obs_date": F.to_date("obs_ts"), "load_id": F.coalesce("load_id", F.lit(0)), "kind": F.coalesce("kind", F.lit(REPLACE)),
    })
    return (
        rows.groupBy(*keys).agg(F.max(F.struct("obs_ts", "value")).alias("m"))
        .select(*SERIES_KEYS, F.col("m.obs_ts").alias("obs_ts"), F.col("m.value").alias("value"), "load_id", "kind", "obs_date")
    )


def _placed(days: DataFrame, buckets: int) -> DataFrame:
    return days.withColumns({"bucket": bucket_of("scope", buckets), "obs_year": F.year("obs_date")})


def resolved(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """The panel that the loads add up to: from each series' newest replace load on, each day from
    its newest load. ``loads`` holds at least the replace rows of all days."""
    base = loads.where(F.col("kind") == REPLACE).groupBy(*SERIES_KEYS).agg(F.max("load_id").alias("base"))
    return (
        rows.join(base, SERIES_KEYS, "left").where(F.col("base").isNull() | (F.col("load_id") >= F.col("base")))
        .groupBy(*SERIES_KEYS, "obs_date")
        .agg(F.max(F.struct("load_id", "obs_ts", "value")).alias("m"))
        .select(*SERIES_KEYS, "obs_date", F.col("m.value").alias("value"))
    )


def current_panel(spark: SparkSession, store: str, buckets: list[int] | None = None, since: date = BEGIN) -> DataFrame:
    """The panel's days from ``since`` on; folders of other buckets and earlier years are not read
    but for the load numbers of replace rows."""
    rows = spark.read.schema(STORE_SCHEMA).parquet(f"{store}/obs")
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    late = rows.where((F.col("obs_year") >= since.year) & (F.col("obs_date") >= F.lit(since)))
    return resolved(late, rows)


def _floors(spark: SparkSession, store: str) -> DataFrame | None:
    """scope, version, floor: from this date on a later version holds; versions of a scope of
    which nothing holds any more are left out."""
    restarts = _stored(spark, f"{store}/restarts", RESTARTS_SCHEMA)
    if restarts is None:
        return None
    later = Window.partitionBy("scope").orderBy(F.desc("version")).rowsBetween(Window.unboundedPreceding, -1)
    floor = F.coalesce(F.min("from_date").over(later), F.lit(NEVER))
    return restarts.select("scope", "version", "from_date", floor.alias("floor")).where("from_date < floor").drop("from_date")


def _live(spark: SparkSession, store: str, table: str, date_col: str, buckets: list[int] | None = None, schema: str | None = None) -> DataFrame | None:
    """Rows of a versioned table that hold. The numbers of the versions that hold anything come to
    the driver (one for each refresh since the store was compacted, at most) and prune folders."""
    floors = _floors(spark, store)
    held = None if floors is None else _stored(spark, f"{store}/{table}", schema)
    if held is None:
        return None
    held = held.where(F.col("version").isin([r.version for r in floors.select("version").distinct().collect()]))
    if buckets is not None:
        held = held.where(F.col("bucket").isin(buckets))
    return held.join(floors, ["scope", "version"]).where(F.col(date_col) < F.col("floor")).drop("floor")


def current_assessments(spark: SparkSession, store: str) -> DataFrame:
    """What holds of all versions: one row for each scope, date and scenario."""
    return _live(spark, store, "assessment", "as_of").drop("version", "bucket")


def _next_version(spark: SparkSession, store: str) -> int:
    """One more than the last version that was finished."""
    held = _stored(spark, f"{store}/restarts", RESTARTS_SCHEMA)
    last = None if held is None else held.agg(F.max("version")).first()[0]
    return 0 if last is None else int(last) + 1


def _mark(*columns) -> Column:
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("decimal(38,0)").alias("mark")


def series_prints(panel: DataFrame) -> DataFrame:
    """scope, unit, month, mark, n of the series that count, and day counts of their pairs."""
    rows = panel.where(CATALOGED)
    month = F.trunc("obs_date", "month").alias("month")
    single = rows.groupBy("scope", F.col("series").alias("unit"), month).agg(_mark("obs_date", "value"), F.count("*").alias("n"))
    has = lambda s: F.max(F.col("series") == s)
    both = rows.where(F.col("series").isin([s for p in PAIRS for s in p])).groupBy("scope", "obs_date").agg(
        F.array(*[F.when(has(a) & has(b), F.lit(f"{a}+{b}")) for a, b in PAIRS]).alias("units")
    )
    pairs = both.select("scope", "obs_date", F.explode(F.array_compact("units")).alias("unit")).groupBy("scope", "unit", month)
    return single.unionByName(pairs.agg(F.lit(0).cast("decimal(38,0)").alias("mark"), F.count("*").alias("n")))


def side_prints(margin: DataFrame | None, manual: DataFrame | None) -> DataFrame | None:
    """Prints of margin months, and of manual inputs, which hold for all dates."""
    parts = [
        df.groupBy("scope", F.lit(unit).alias("unit"), month.alias("month")).agg(_mark(*sorted(df.columns)), F.count("*").alias("n"))
        for df, unit, month in ((margin, MARGIN_UNIT, F.trunc("month", "month")), (manual, MANUAL_UNIT, F.lit(BEGIN))) if df is not None
    ]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def first_changes(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """scope, from_date: the first month whose prints are not those before."""
    keys = ["scope", "unit", "month"]
    new = now.select(*keys, F.struct("mark", "n").alias("new"))
    if before is not None:
        old = before.select(*keys, F.struct("mark", "n").alias("old"))
        new = new.join(old, keys, "full").where(~F.col("new").eqNullSafe(F.col("old")))
    return new.groupBy("scope").agg(F.min("month").alias("from_date"))


def needed_from(prints: DataFrame, restarts: DataFrame) -> DataFrame:
    """scope, series, need: the first day of a series that dates from the scope's restart on use.

    A date looks at a series' last day, at most HISTORY_DAYS back from there, and WARM_UP rows
    further, all by month. The same holds for pairs, which bind both of their series.
    """
    earlier = prints.join(restarts, "scope").where(F.col("month") < F.col("from_date"))
    whole = Window.partitionBy("scope", "unit")
    reach = F.trunc(F.date_sub(F.max("month").over(whole), P.HISTORY_DAYS), "month")
    back = whole.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = earlier.withColumn("reach", reach).withColumn("warm", F.sum(F.when(F.col("month") < F.col("reach"), F.col("n")).otherwise(0)).over(back))
    enough = F.max(F.when(F.col("warm") >= WARM_UP, F.col("month")))
    need = rows.groupBy("scope", "unit").agg(F.least(F.max("reach"), F.coalesce(enough, F.min("month"))).alias("need"))
    return need.select("scope", F.explode(F.split("unit", "[+]")).alias("series"), "need").groupBy("scope", "series").agg(F.min("need").alias("need"))


def rescore(spark: SparkSession, store: str, touched: DataFrame, side_inputs: SideInputs) -> None:
    """Score scopes again from the first month on that is not what they were scored with.

    ``touched``: scope, since (its days before that are as they were). To the driver come one row for
    each bucket and the first date to read, to prune folders.
    """
    count = buckets_of(spark, store)
    touched = touched.select("scope", F.trunc(F.coalesce("since", F.lit(BEGIN)), "month").alias("since"))
    by_bucket = touched.groupBy(bucket_of("scope", count).alias("b")).agg(F.min("since").alias("since")).collect()
    if not by_bucket:
        return
    buckets, since = [r["b"] for r in by_bucket], min(r["since"] for r in by_bucket)
    margin, manual = (None if df is None else df.join(touched, "scope", "left_semi") for df in side_inputs(spark))
    landed = current_panel(spark, store, buckets, since).join(touched, "scope").where("obs_date >= since").drop("since")
    side = side_prints(margin, manual)
    now = series_prints(landed) if side is None else series_prints(landed).unionByName(side)
    prints = _live(spark, store, "prints", "month", buckets, PRINTS_SCHEMA)
    before = None
    if prints is not None:
        compared = F.col("unit").isin(MARGIN_UNIT, MANUAL_UNIT) | (F.col("month") >= F.col("since"))
        before = prints.join(touched, "scope").where(compared)
    now = now.persist(StorageLevel.MEMORY_AND_DISK)
    restarts = first_changes(now, before).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = restarts.agg(F.min("from_date")).first()[0]
        if first is None:
            return
        version = _next_version(spark, store)

        def write(df: DataFrame, table: str) -> None:
            df.withColumn("bucket", bucket_of("scope", count)).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{table}/version={version}")

        need = None if prints is None else needed_from(prints, restarts)
        if need is not None:
            first = min(first, need.agg(F.min("need")).first()[0] or first)
        obs = current_panel(spark, store, buckets, first).join(restarts, "scope")
        if need is not None:
            obs = obs.join(need, ["scope", "series"], "left").where(F.col("obs_date") >= F.coalesce("need", "from_date")).drop("need")
        scored = assessment_table(assess(feature_history(obs.drop("from_date"), margin, manual)))
        write(scored.join(restarts, "scope").where("as_of >= from_date").drop("from_date"), "assessment")
        fresh = now
        if prints is not None:  # months that were not compared keep their prints
            kept = prints.join(touched, "scope").where(~compared).select(*now.columns)
            fresh = now.unionByName(kept)
        write(fresh.join(restarts, "scope").where("month >= from_date").drop("from_date"), "prints")
        restarts.write.mode("overwrite").parquet(f"{store}/restarts/version={version}")
    finally:
        now.unpersist()
        restarts.unpersist()


def apply_batch(batch: DataFrame, batch_id: int, store: str, side_inputs: SideInputs, buckets: int = BUCKETS) -> None:
    """Keep the batch's rows, then score the scopes it touches. The batch is read once."""
    spark = batch.sparkSession
    count = buckets_of(spark, store, buckets)
    days = _placed(landed_days(batch), count).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        days.repartition("bucket", "scope").write.mode("append").partitionBy("bucket", "obs_year").parquet(f"{store}/obs")
        added = F.bool_and(F.col("kind") == APPEND)
        touched = days.where("scope is not null").groupBy("scope").agg(F.when(added, F.min("obs_date")).alias("since"))
        rescore(spark, store, touched, side_inputs)
    finally:
        days.unpersist()


def scored_scopes(spark: SparkSession, store: str) -> DataFrame | None:
    held = _stored(spark, f"{store}/restarts", RESTARTS_SCHEMA)
    return None if held is None else held.select("scope").distinct()


def changed_scopes(spark: SparkSession, store: str, side_inputs: SideInputs) -> DataFrame | None:
    """scope, from_date of those in the store whose margin or manual rows are not those they were
    scored with."""
    scopes, side = scored_scopes(spark, store), side_prints(*side_inputs(spark))
    if scopes is None:
        return None
    prints = _live(spark, store, "prints", "month", schema=PRINTS_SCHEMA).where(F.col("unit").isin(MARGIN_UNIT, MANUAL_UNIT))
    now = prints.where(F.lit(False)).select("scope", "unit", "month", "mark", "n") if side is None else side.join(scopes, "scope", "left_semi")
    return first_changes(now, prints)


def no_side_inputs(spark: SparkSession) -> tuple[None, None]:
    return None, None


def refresh(
    spark: SparkSession,
    landing: str,
    store: str,
    side_inputs: SideInputs = no_side_inputs,
    max_files: int | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Process what has landed since the last run; then score scopes whose margin or manual inputs
    have changed. Returns when all is stored."""
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    (
        reader.parquet(landing)
        .writeStream.foreachBatch(lambda df, i: apply_batch(df, i, store, side_inputs, buckets))
        .option("checkpointLocation", f"{store}/_progress")
        .trigger(availableNow=True)
        .start().awaitTermination()
    )
    changed = changed_scopes(spark, store, side_inputs)
    if changed is not None:
        rescore(spark, store, changed.select("scope", F.lit(NEVER).alias("since")), side_inputs)


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Write a store of the same content to a new folder: each series as one replace load, one
    version of assessments and prints.

    The old store stays as it is; readers move to the new one when it is complete.
    """
    count = buckets_of(spark, store)
    buckets_of(spark, target, count)
    newest = spark.read.schema(STORE_SCHEMA).parquet(f"{store}/obs").groupBy(*SERIES_KEYS).agg(F.max("load_id").alias("load_id"))
    rows = _placed(
        current_panel(spark, store).join(newest, SERIES_KEYS).select(
            *SERIES_KEYS, F.col("obs_date").cast("timestamp_ntz").alias("obs_ts"), "value", "load_id", F.lit(REPLACE).alias("kind"), "obs_date",
        ), count,
    )
    rows.repartition("bucket", "scope").write.mode("overwrite").partitionBy("bucket", "obs_year").parquet(f"{target}/obs")
    for table, date_col, schema in (("assessment", "as_of", None), ("prints", "month", PRINTS_SCHEMA)):
        live = _live(spark, store, table, date_col, schema=schema).drop("version")
        live.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/{table}/version=0")
    whole = scored_scopes(spark, store).withColumn("from_date", F.lit(BEGIN))
    whole.write.mode("overwrite").parquet(f"{target}/restarts/version=0")
