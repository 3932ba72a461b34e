"""Source preference from a table: which candidate answers for a logical series, as of each date.

``candidates``: logical, provider, series, priority, min_obs, rescale_above. On a date, a candidate
is eligible if it has at least ``min_obs`` observations in the load window that ends there (and so
one at least); of the eligible ones the lowest priority answers with its last observation. A value
above ``rescale_above`` (null: never) was quoted tenfold and is divided by ten.

A new logical series, another order or another guard is a row of that table. The operators of the
feature row (``operators.resolve``) choose by the same rules, written out for the catalog, because
there each choice decides among many fields of one wide row.

Rows meet the candidates by an equality on the series; a series that serves several logical ones is
copied for each. Each candidate is carried and counted by windows that only grow, over its own rows
and the dates wanted, so a window partition is bounded by the days of history; choosing among the
candidates of a date is an aggregation that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline import params as P
from tideline.operators.ingest import usable

CANDIDATES = "logical string, provider string, series string, priority int, min_obs int, rescale_above double"
KEYS = ["scope", "logical"]


def resolve(
    obs: DataFrame, candidates: DataFrame, calendar: DataFrame | None = None, days: int = P.HISTORY_DAYS
) -> DataFrame:
    """scope, logical, as_of, series, priority, value, last_date, n_obs of the candidate that answers;
    no row on a date without an eligible one.

    ``calendar`` (scope, as_of) lists the dates wanted; without it, the dates on which any candidate
    of the logical series has an observation. Days are expected to hold one row per series. Of rows
    of one logical series and priority the smallest provider and series answer.
    """
    own = [*KEYS, "provider", "series", "priority", "min_obs", "rescale_above"]
    seen = (
        obs.where(usable(F.col("value"))).join(candidates, ["provider", "series"])
        .select(*own, F.unix_date("obs_date").alias("n"), "value")
    )
    names = seen.select(*own).distinct()
    if calendar is None:
        wanted = names.join(seen.select(*KEYS, "n").distinct(), KEYS)
    else:
        wanted = names.join(calendar.select("scope", F.unix_date("as_of").alias("n")).distinct(), "scope")
    blank = F.lit(None).cast("struct<n: int, value: double>")
    line = seen.select(*own, "n", F.struct("n", "value").alias("o"), F.lit(False).alias("asks")).unionByName(
        wanted.select(*own, "n", blank.alias("o"), F.lit(True).alias("asks"))
    )
    w = Window.partitionBy(*own).orderBy("n")
    upto = F.count("o").over(w.rangeBetween(Window.unboundedPreceding, 0))
    before = F.count("o").over(w.rangeBetween(Window.unboundedPreceding, -days - 1))
    last = F.last("o", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    state = line.withColumns({"n_obs": upto - before, "o": last}).where(F.col("asks") & (F.col("n_obs") >= F.greatest("min_obs", F.lit(1))))
    value = F.when(F.col("o.value") > F.col("rescale_above"), F.col("o.value") / 10.0).otherwise(F.col("o.value"))
    answer = F.struct("priority", "provider", "series", value.alias("value"), F.col("o.n").alias("last_n"), "n_obs")
    chosen = state.groupBy(*KEYS, "n").agg(F.min(answer).alias("a"))
    return chosen.select(
        *KEYS, F.date_from_unix_date("n").alias("as_of"), F.col("a.series").alias("series"), F.col("a.priority").alias("priority"),
        F.col("a.value").alias("value"), F.date_from_unix_date("a.last_n").alias("last_date"), F.col("a.n_obs").alias("n_obs"),
    )
