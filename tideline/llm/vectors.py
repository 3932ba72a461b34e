"""Integer vectors packed into blocks of rows, and the meeting of queries with all blocks.

A component x becomes floor(scale * x), x as double. Inner products of the results are computed
exactly: in 32-bit or 64-bit floats where no sum of products can leave their whole numbers, else in
64-bit integers.

A block is one Spark row: some vectors of one length end to end, with a few whole numbers for each.
Queries are packed the same way. ``meet`` deals blocks over groups and sends every chunk of queries
to every group, so a task holds one group of blocks and queries stream past it: vectors are
shuffled once, queries once for each group, and no pair becomes a Spark row.

Defined cases: null vectors and vectors with a null or non-finite component take no part; vectors
of different lengths never meet; a component saturates where a sum of products of its vectors
might leave 64 bits (beyond a million at 64 components and a scale of 256).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
GROUP_BLOCKS = 2048
QUERY_ROWS = 1024
LOW = -(2**62) - 1  # below every score
BLOCK_SCHEMA = "block long, dim int, n int, longs binary, vecs binary"


def largest(dim: int) -> int:
    """The largest component for which ``dim`` products sum to less than 2 to the power of 62."""
    return min(2**31 - 1, math.isqrt(2**62 // max(dim, 1)))


def quantised(vectors: pa.Array, scale: int, most: Callable[[int], int] = largest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the usable vectors of one length, their whole numbers) for each length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    values = vectors.flatten().cast(pa.float64())
    x = values.to_numpy(zero_copy_only=False)  # null becomes NaN
    first = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    for dim in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        rows = x[first[at][:, None] + np.arange(dim)]
        fine = np.isfinite(rows).all(1)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(rows[fine] * scale), -most(dim), most(dim)).astype(np.int64)
        yield at[fine], whole


def to_bytes(x: np.ndarray) -> bytes:
    """Two bytes for each component where all fit, else four."""
    return x.astype("<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i4").tobytes()


def from_bytes(data, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) <= 2 * n * dim else "<i4").reshape(n, dim)


def vectors(rows: DataFrame, vector: Column, scale: int, most: Callable[[int], int] = largest, **numbers: Column) -> DataFrame:
    """row (unique), dim, the given whole numbers and vec of each usable row without null numbers."""
    names = list(numbers)

    def apply(batches):
        seen = TaskContext.get().partitionId() << 33
        for batch in batches:
            longs = pa.Table.from_batches([batch]).select(names)
            for at, x in quantised(batch.column(0), scale, most):
                own = longs.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen + at), pa.array(np.full(len(at), x.shape[1], np.int32)), *(own[n].combine_chunks() for n in names), pa.array([to_bytes(v) for v in x], pa.binary())],
                    ["row", "dim", *names, "vec"],
                )
            seen += batch.num_rows

    usable = rows.select(vector.alias("vec"), *(c.cast("long").alias(n) for n, c in numbers.items())).na.drop(subset=names)
    return usable.mapInArrow(apply, f"row long, dim int, {''.join(f'{n} long, ' for n in names)}vec binary")


def packed(rows: DataFrame, *names: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of consecutive rows of one length; ``names`` are the whole numbers that they carry."""

    def apply(batches):
        base, made, held = TaskContext.get().partitionId() << 33, 0, {}
        size = 0  # bytes held

        def block(dim, n):
            nonlocal made, size
            longs, x = (np.concatenate(part) for part in zip(*held.pop(dim)))
            n = min(n, len(x))
            if n < len(x):
                held[dim] = [(longs[n:], x[n:])]
            made += 1
            size -= n * (4 * dim + 8)
            return {"block": base + made, "dim": dim, "n": n, "longs": longs[:n].astype("<i8").tobytes(), "vecs": to_bytes(x[:n])}

        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            longs = np.stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(names))], 1)
            out = []
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.stack([from_bytes(v, 1, dim)[0].astype(np.int32) for v in batch.column(1).take(pa.array(at)).to_pylist()])
                held.setdefault(dim, []).append((longs[at], x))
                size += len(at) * (4 * dim + 8)
                most = max(1, min(block_rows, BLOCK_BYTES // (4 * dim + 1)))
                have = sum(len(part) for _, part in held[dim])
                while have >= most:
                    out.append(block(dim, most))
                    have -= most
            if size > 8 * BLOCK_BYTES:  # many lengths
                out += [block(d, block_rows) for d in list(held)]
            yield pa.RecordBatch.from_pylist(out, SCHEMA)
        yield pa.RecordBatch.from_pylist([block(d, block_rows) for d in list(held)], SCHEMA)

    return rows.select("dim", "vec", *names).mapInArrow(apply, BLOCK_SCHEMA)


SCHEMA = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("longs", pa.binary()), ("vecs", pa.binary())])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    top = lambda x: int(np.abs(x.astype(np.int64)).max(initial=0))
    most = a.shape[1] * top(a) * top(b)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def group_count(blocks: DataFrame) -> int:
    """Groups of at most about GROUP_BLOCKS blocks, and enough to keep all cores busy."""
    n = blocks.count()
    return max(1, min(n, max(2 * blocks.sparkSession.sparkContext.defaultParallelism, -(-n // GROUP_BLOCKS))))


def meet(blocks: DataFrame, queries: DataFrame, groups: int, answer: Callable, schema: str) -> DataFrame:
    """What ``answer(held, memo, longs, x)`` yields for each group and chunk of queries.

    ``held`` lists the (longs, vectors) of the group's blocks of the chunk's length; a chunk that
    meets none of its length in a group gives nothing there. ``memo`` lasts as long as ``held``.
    """
    dealt = blocks.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "dim", "n", "longs", "vecs")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "dim", "n", "longs", "vecs")

    def apply(batches):
        at, held, memo = None, {}, {}
        for batch in batches:
            for g, kind, dim, n, longs, vecs in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if g != at:
                    at, held, memo = g, {}, {}
                numbers, x = np.frombuffer(longs, "<i8").reshape(n, -1), from_bytes(vecs, n, dim)
                if kind == 0:
                    held.setdefault(dim, []).append((numbers, x))
                elif dim in held:
                    yield from answer(held[dim], memo.setdefault(dim, {}), numbers, x)

    together = dealt.unionByName(asked).repartition(groups, "g").sortWithinPartitions("g", "kind")
    return together.mapInArrow(apply, schema)


def firsts(q: np.ndarray, score: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each q: higher scores first, ties by smaller number."""
    order = np.lexsort((number, -score, q))
    s = q[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
    return order[rank < k]


def best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` rows of each key by score, then number, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "number")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
