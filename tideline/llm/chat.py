"""Chat formatting after cumulative-snapshot collapse.

A logged conversation is often a snapshot of one that went on. Each turn's role and text are
hashed with the turn's place, and the running exclusive-or of these hashes (twice 64 bits) names
every prefix of a conversation. A conversation whose whole hash is a proper prefix of another goes
by an anti-join; of equal conversations the smallest id stays. What stays is rendered.

Only hashes are shuffled to find snapshots; texts are shuffled once, for what is rendered.

Defined cases: turns are ordered by turn, then role, then text, nulls first; a repeated row counts
once; a null role or text differs from an empty one and is rendered as empty; rows without a
conversation id belong to none and are dropped; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.scratch import keep


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (place), of (turns in all), h1 and h2 of the first n turns."""
    content = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = turns.where("conv_id is not null").select(
        "conv_id", "turn", *(F.xxhash64(F.lit(seed), *content).alias(c) for seed, c in ((1, "a"), (2, "b")))
    ).distinct()
    # Turns of one number follow role and text, which only these need.
    tied = hashed.groupBy("conv_id", "turn").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    same = lambda c: F.col(f"turns.{c}").eqNullSafe(F.col(f"tied.{c}"))
    spelled = turns.alias("turns").join(tied.alias("tied"), same("conv_id") & same("turn")).select("turns.*").select(
        "conv_id", "turn", "role", "text", *(F.xxhash64(F.lit(seed), *content).alias(c) for seed, c in ((1, "a"), (2, "b")))
    ).distinct()
    within = Window.partitionBy("conv_id", "turn").orderBy(F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    ranks = spelled.select("conv_id", "turn", "a", "b", F.row_number().over(within).alias("place"))
    both = lambda c: F.col(f"h.{c}").eqNullSafe(F.col(f"r.{c}"))
    ranked = hashed.alias("h").join(ranks.alias("r"), both("conv_id") & both("turn") & both("a") & both("b"), "left").select("h.*", F.coalesce("r.place", F.lit(1)).alias("place"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "place")
    placed = ranked.select("conv_id", "turn", "a", "b", F.row_number().over(order).alias("n"))
    running = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv_id", "n", F.max("n").over(Window.partitionBy("conv_id")).alias("of"),
        *(F.bit_xor(F.xxhash64(F.lit(seed), "n", c)).over(running).alias(h) for seed, c, h in ((3, "a", "h1"), (4, "b", "h2"))),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay."""
    seen = keep(prefixes(turns), "chat-prefixes")
    whole = seen.where("n = of").groupBy("h1", "h2", F.col("n").alias("n_turns")).agg(F.min("conv_id").alias("conv_id"))
    snapshots = seen.where("n < of").select("h1", "h2", F.col("n").alias("n_turns")).distinct()
    return whole.join(snapshots, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame, staying: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text. A conversation's turns meet in one row, its text."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = turns.select("conv_id", "turn", "role", "text").join(staying, "conv_id").distinct()
    return rows.groupBy("conv_id", "n_turns").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda t: t["line"]), "").alias("rendered")
    )


def format_chats(turns: DataFrame) -> DataFrame:
    return render(turns, maximal(turns))
