"""Exact top-k inner products by block-at-a-time pruning.

A component of either sign is a term of its own, so a vector holds non-negative term weights and a
query's score is its weights' sum over terms. Rows are ordered by their nearest pivot (a pivot is
one of at most ``PIVOTS`` rows, those with the smallest hashes of their numbers) and cut into
document-range blocks. A block is its own forward index: the vectors of its rows. The sum of a
query's weights times a block's term maxima bounds every score in it.

Two passes meet all queries with all blocks, a group of blocks to a task. The first scores only the
block with the highest bound of each group; the k-th best of these scores is the floor from which
the second starts. It takes a query's blocks by falling bounds, scores them through their forward
indexes, raises the floor as it goes and leaves the blocks whose bound is below it. A bound equal
to the floor is still scored, since a tie may have a smaller number. The result is exact for any
choice of pivots; they only decide how much is left out.

Defined cases: as in ``vectors``, and rows with a null number take no part. Rows of a query's own
number are never its candidates; repeated rows are rows of their own, and each query row gets its
own list. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import vectors
from tideline.llm.scratch import keep, share, shared

PIVOTS, PIVOT_DIM = 256, 4096


def near_rows_together(rows: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """The rows sorted over all partitions by their nearest pivot, equal ones in any order."""
    spark = rows.sparkSession
    chosen = rows.where(F.col("dim").between(1, PIVOT_DIM)).orderBy(F.xxhash64("id"), "row").select("dim", "vec").limit(pivots).collect()
    by_dim = {d: np.stack([vectors.from_bytes(r.vec, 1, d)[0].astype(np.int32) for r in chosen if r.dim == d]) for d in {r.dim for r in chosen}}
    sent = share(spark, by_dim)

    def nearest(batches):
        known = shared(sent)
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            out = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in known:
                    at = np.flatnonzero(dims == dim)
                    x = np.stack([vectors.from_bytes(v, 1, dim)[0].astype(np.int32) for v in batch.column("vec").take(pa.array(at)).to_pylist()])
                    out[at] = vectors.product(x, known[dim]).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "pivot"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", pivot int"
    placed = rows.mapInArrow(nearest, schema)
    return placed.repartitionByRange("pivot", F.xxhash64("row")).sortWithinPartitions("pivot", F.xxhash64("row")).drop("pivot")


def bounds(x: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The sum of each query's term weights times each block's term maxima."""
    split = np.concatenate((np.maximum(x, 0), np.maximum(-x.astype(np.int64), 0)), 1)
    return vectors.product(split, np.concatenate((top, -low), 1))


def prune(held: list, memo: dict, numbers: np.ndarray, x: np.ndarray, k: int, first_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, score, number) of what may be among the first ``k``, and the rows scored.

    ``numbers`` of a query: row, id, floor.
    """
    if not memo:
        memo["top"] = np.stack([v.max(0) for _, v in held]).astype(np.int64)
        memo["low"] = np.stack([v.min(0) for _, v in held]).astype(np.int64)
    limit = bounds(x, memo["top"], memo["low"])
    order = np.argsort(-limit, axis=1, kind="stable")
    m, floor = len(x), numbers[:, 2].copy()
    leading = np.full((m, k), vectors.LOW)
    out: list[tuple] = []
    done, step, scored = 0, 1, 0
    while done < (1 if first_only else len(held)):
        block = order[:, done : done + step]
        open_ = np.take_along_axis(limit, block, 1) >= floor[:, None]
        if not open_.any():
            break  # bounds fall along a row, so nothing after is open either
        asked, at = np.nonzero(open_)
        to = block[asked, at]
        by = np.argsort(to, kind="stable")
        for b, some in zip(*_runs(to[by], asked[by])):
            some = some[limit[some, b] >= floor[some]]  # the floor may have risen meanwhile
            if not len(some):
                continue
            ids, v = held[b][0][:, 0], held[b][1]
            score = vectors.product(x[some], v).astype(np.int64)
            scored += score.size
            score[numbers[some, 1][:, None] == ids[None, :]] = vectors.LOW - 1
            high = score >= floor[some][:, None]
            fresh = np.flatnonzero(high.any(1))
            if not len(fresh):
                continue
            some, score = some[fresh], score[fresh]
            lead = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k :] if len(ids) > k else score
            leading[some] = np.sort(np.concatenate((leading[some], lead), 1), axis=1)[:, -k:]
            floor[some] = np.maximum(floor[some], leading[some, 0])
            q, j = np.nonzero(score >= floor[some][:, None])
            out.append((some[q], score[q, j], ids[j]))
        done, step = done + step, 2 * step
    q, score, number = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
    stay = score >= np.maximum(floor[q], vectors.LOW)
    q, score, number = q[stay], score[stay], number[stay]
    first = vectors.firsts(q, score, number, k)
    return q[first], score[first], number[first], scored


def _runs(key: np.ndarray, value: np.ndarray):
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[start].tolist(), np.split(value, start[1:])


def _search(blocks: DataFrame, queries: DataFrame, groups: int, k: int, first_only: bool) -> DataFrame:
    def answer(held, memo, numbers, x):
        q, score, number, scored = prune(held, memo, numbers, x, k, first_only)
        yield pa.RecordBatch.from_pydict(
            {"row": numbers[q, 0], "query_id": numbers[q, 1], "score": score, "number": number, "scored": np.where(np.arange(len(q)) == 0, scored, 0)}
        )

    return vectors.meet(blocks, queries, groups, answer, "row long, query_id long, score long, number long, scored long")


def search(rows: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` highest scores of every row that ``asked``
    holds for, against all other rows.

    To the driver come the pivots alone, which are broadcast.
    """
    usable = keep(vectors.vectors(rows, F.col(vec_col), scale, id=F.col(id_col), asked=F.coalesce(asked, F.lit(False)).cast("int")), "topk-rows")
    blocks = keep(vectors.packed(near_rows_together(usable), "id"), "topk-blocks")
    groups = vectors.group_count(blocks)
    queries = usable.where("asked = 1").select("row", "id", "dim", "vec")
    start = vectors.packed(queries.withColumn("floor", F.lit(vectors.LOW)), "row", "id", "floor", block_rows=vectors.QUERY_ROWS)
    seeds = vectors.best(_search(blocks, start, groups, k, True), k, "row")
    floors = seeds.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    going = queries.join(floors, "row", "left").select("row", "id", "dim", "vec", F.coalesce("floor", F.lit(vectors.LOW)).alias("floor"))
    chunks = keep(vectors.packed(going, "row", "id", "floor", block_rows=vectors.QUERY_ROWS), "topk-queries")
    found = vectors.best(_search(blocks, chunks, groups, k, False), k, "row")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("number").alias("vec_id"), "score")
