"""Hard negatives by slot-decomposed selection.

Anchors meet all rows in blocks twice. The first pass finds each anchor's positives: its first
``positives`` other rows of its label. A positive with score p takes negatives with scores from
low * p to high * p, so the positives' upper limits cut the scores into disjoint slots: slot j holds
what is at most the j-th highest limit and above the next one. The second pass keeps, for each
anchor, the first ``k`` rows of other labels in each slot, within each task and then over tasks.
Walking the slots from the lowest limit upwards, each merged with what lies below it and cut to
``k``, gives the first rows under every upper limit at once: a window's answer is its slot's
merged list down to its lower limit. No window is searched on its own, however they overlap.

Higher scores come first, ties by smaller number. An anchor's rows go to the same task only as
lists of at most ``positives`` times ``k`` entries from each group of blocks.

Defined cases: as in ``vectors``, and rows with a null number or label take no part. Rows of an
anchor's own number are never its positives or negatives; repeated rows are rows of their own, and
each anchor row is answered on its own. A positive whose window holds nothing (also every one with
a negative score) gives no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import vectors
from tideline.llm.scratch import keep

SLAB = 2048  # rows scored at once


def _slabs(held: list, memo: dict):
    """The group's rows as (numbers, labels, vectors), a few blocks at a time."""
    if not memo:
        size = np.cumsum([len(v) for _, v in held])
        memo["slabs"] = np.split(np.arange(len(held)), np.flatnonzero(np.diff(size // SLAB)) + 1)
    for part in memo["slabs"]:
        numbers = np.concatenate([held[i][0] for i in part])
        yield numbers[:, 0], numbers[:, 1], np.concatenate([held[i][1] for i in part])


def _kept(parts: list[tuple], k: int, *keys: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` entries by score for each anchor (and slot) of (anchor, slot, score, number)."""
    whole = tuple(np.concatenate(c) for c in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(4))
    first = vectors.firsts(whole[0] * keys[0] + whole[1], whole[2], whole[3], k)
    return tuple(c[first] for c in whole)


def _same_label(blocks: DataFrame, anchors: DataFrame, groups: int, k: int) -> DataFrame:
    def answer(held, memo, numbers, x):
        parts = []
        for ids, label, v in _slabs(held, memo):
            for one in np.intersect1d(numbers[:, 2], label).tolist():
                asked, among = np.flatnonzero(numbers[:, 2] == one), np.flatnonzero(label == one)
                score = vectors.product(x[asked], v[among]).astype(np.int64)
                own = numbers[asked, 1][:, None] == ids[among][None, :]
                if len(among) > k + 1:  # one of them may be the anchor itself
                    least = np.partition(np.where(own, vectors.LOW, score), len(among) - k, axis=1)[:, len(among) - k]
                    own |= score < least[:, None]
                q, j = np.nonzero(~own)
                parts.append((asked[q], np.zeros(len(q), np.int64), score[q, j], ids[among][j]))
        q, _, score, number = _kept(parts, k, 1)
        yield pa.RecordBatch.from_pydict({"row": numbers[q, 0], "score": score, "number": number})

    return vectors.meet(blocks, anchors, groups, answer, "row long, score long, number long")


def _other_labels(blocks: DataFrame, anchors: DataFrame, groups: int, slots: int, k: int) -> DataFrame:
    """row, slot (0 has the highest limit), score, number. Numbers of an anchor: row, id, label,
    the least score wanted, and the slots' upper limits, falling."""

    def answer(held, memo, numbers, x):
        parts = []
        least, limit = numbers[:, 3], numbers[:, 4:]
        for ids, label, v in _slabs(held, memo):
            score = vectors.product(x, v)
            wanted = (score >= least[:, None]) & (score <= limit[:, :1])
            wanted &= (numbers[:, 2][:, None] != label[None, :]) & (numbers[:, 1][:, None] != ids[None, :])
            q, j = np.nonzero(wanted)
            s = score[q, j].astype(np.int64)
            slot = (limit[q] >= s[:, None]).sum(1) - 1
            parts.append((q, slot, s, ids[j]))
            if sum(len(p[0]) for p in parts) > 1 << 18:
                parts = [_kept(parts, k, slots)]
        q, slot, score, number = _kept(parts, k, slots)
        yield pa.RecordBatch.from_pydict({"row": numbers[q, 0], "slot": slot.astype(np.int32), "score": score, "number": number})

    return vectors.meet(blocks, anchors, groups, answer, "row long, slot int, score long, number long")


def _share(score, percent: int):
    """floor(percent / 100 * score), exactly and without leaving 64 bits."""
    return _div(score) * percent + _div(F.pmod(score, F.lit(100)) * percent)


def _div(x: Column) -> Column:
    """floor(x / 100) of a whole number."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100).cast("long"))


def mine(
    rows: DataFrame, asked: Column, label: Column, positives: int = 5, k: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors,
    the rows that ``asked`` holds for; ``low`` and ``high`` are percents of the positive's score."""
    numbers = {"id": F.col(id_col), "label": label, "asked": F.coalesce(asked, F.lit(False)).cast("int")}
    usable = keep(vectors.vectors(rows, F.col(vec_col), scale, **numbers), "negatives-rows")
    blocks = keep(vectors.packed(usable, "id", "label"), "negatives-blocks")
    groups = vectors.group_count(blocks)
    anchors = usable.where("asked = 1").select("row", "id", "label", "dim", "vec")
    chunk = lambda df, *names: vectors.packed(df, "row", "id", "label", *names, block_rows=vectors.QUERY_ROWS)

    near = vectors.best(_same_label(blocks, chunk(anchors), groups, positives), positives, "row")
    windows = near.select(
        "row", F.struct(F.col("rank"), "score", F.col("number").alias("id"), (-_share(-F.col("score"), low)).alias("least"), _share(F.col("score"), high).alias("most")).alias("p")
    ).where("p.least <= p.most")
    by_anchor = keep(windows.groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("p")), "negatives-positives")
    limits = F.array_sort(F.array_distinct("p.most"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    by_anchor = by_anchor.withColumn("limits", limits)
    cut = [F.coalesce(F.get("limits", F.lit(i)), F.lit(vectors.LOW)).alias(f"limit{i}") for i in range(positives)]
    with_limits = anchors.join(by_anchor.select("row", F.array_min("p.least").alias("least"), *cut), "row")
    chunks = keep(chunk(with_limits, "least", *(f"limit{i}" for i in range(positives))), "negatives-anchors")
    found = vectors.best(_other_labels(blocks, chunks, groups, positives, k), k, "row", "slot")

    entries = found.groupBy("row").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "number", "slot")).alias("found"))
    both = anchors.select("row", "id").join(by_anchor, "row").join(entries, "row")
    merged = F.aggregate(  # from the lowest limit up: each slot with the merged list below it
        F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1)),
        F.array(F.slice("found", 1, 0)),
        lambda done, slot: F.concat(
            F.array(F.slice(F.array_sort(F.concat(F.filter("found", lambda e: e["slot"] == slot), F.get(done, F.lit(0)))), 1, k)), done
        ),
    )
    answers = both.withColumn("merged", merged).select("id", "limits", "merged", F.explode("p").alias("p"))
    window = F.filter(F.get("merged", (F.array_position("limits", F.col("p.most")) - 1).cast("int")), lambda e: -e["minus"] >= F.col("p.least"))
    return answers.select("id", "p", F.posexplode(window).alias("at", "e")).select(
        F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("e.number").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("e.minus")).alias("negative_score"),
    )
