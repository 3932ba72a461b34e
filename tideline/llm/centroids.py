"""Lloyd's clustering of whole-number vectors, sharded by dimension.

Vectors are cut into row blocks, and each row block into column blocks, one for each shard of the
dimensions. A task that holds column blocks of a shard knows that shard's slice of every centroid
and computes exact partial squared distances; a reduction by row block adds the shards' partial
distances and takes the argmin. The assignments go back to the column blocks, where each shard sums
its own columns by cluster and updates its own slice.

Column blocks are written once, bucketed by row block and shard. A round shuffles partial distances
(four or eight bytes for each vector, centroid and shard) and assignments (one or two bytes for each
vector and shard), never vectors. The driver holds centroids only: clusters times dimensions
numbers. Each round starts from written tables and these, so lineage does not grow and a lost
executor costs the tasks that were running.

Defined cases: only vectors of exactly ``dim`` components take part, none null or non-finite, with
a number; components saturate at 2 to the power of 27, so that a squared distance fits 64 bits;
repeated rows are vectors of their own; start centroids of equal hash are taken in an order of their
stored bytes; ties of distance go to the smaller centroid; with fewer vectors than clusters there
are fewer centroids; an inertia beyond 64 bits is given as the largest long; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import vectors
from tideline.llm.scratch import keep, release, share, shared

BLOCK_ROWS, SHARD_DIM = 4096, 32
COMPONENT = 1 << 27
BUCKET_BYTES = 128 << 20


def seeds(rows: DataFrame, k: int, seed: int) -> list[np.ndarray]:
    """The vectors with the ``k`` smallest sha256 of ``seed:number``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(name.alias("hash"), "dim", "vec").orderBy("hash", F.hex("vec")).limit(k).collect()
    return [vectors.from_bytes(r.vec, 1, r.dim)[0].astype(np.int64) for r in first]


def column_blocks(blocks: DataFrame, shard_dim: int) -> DataFrame:
    """block, shard, n and the columns of each shard."""

    def apply(batches):
        for batch in batches:
            for block, dim, n, vecs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = vectors.from_bytes(vecs, n, dim)
                cut = [vectors.to_bytes(x[:, at : at + shard_dim]) for at in range(0, dim, shard_dim)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(cut)), pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(np.full(len(cut), n, np.int32)), pa.array(cut, pa.binary())],
                    ["block", "shard", "n", "vecs"],
                )

    return blocks.select("block", "dim", "n", "vecs").mapInArrow(apply, "block long, shard int, n int, vecs binary")


def bucketed(df: DataFrame, buckets: int, *by: str) -> tuple[DataFrame, str]:
    """A table whose rows lie in files by the hash of ``by``; joins on these do not move it."""
    name = f"tideline_{uuid.uuid4().hex}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name), name


def _columns(x: np.ndarray, shard: int, shard_dim: int) -> np.ndarray:
    return x[:, shard * shard_dim : (shard + 1) * shard_dim]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c``, both of one shard's columns."""
    top = 2 * max(int(np.abs(x.astype(np.int64)).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if x.shape[1] * top * top < 1 << 53 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    if kind is np.float64:
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((a - one) ** 2).sum(1) for one in b], 1)


def partial_distances(shards: DataFrame, sent, shard_dim: int) -> DataFrame:
    """block, n and the n * k partial distances of each column block."""

    def apply(batches):
        c = shared(sent)
        for batch in batches:
            out = []
            for shard, n, vecs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own = _columns(c, shard, shard_dim)
                d = _distances(vectors.from_bytes(vecs, n, own.shape[1]), own)
                out.append(d.astype("<u4" if d.max(initial=0) < 1 << 32 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["block", "n", "part"])

    return shards.select("block", "shard", "n", "vecs").mapInArrow(apply, "block long, n int, part binary")


def assigned(parts: DataFrame, k: int) -> DataFrame:
    """block, n, each row's cluster and its distance: the shards' parts added, then the least."""

    def reduce(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        total = np.zeros((n, k), np.int64)
        for part in table["part"].to_pylist():
            total += np.frombuffer(part, "<u4" if len(part) == 4 * n * k else "<i8").reshape(n, k)
        cluster = total.argmin(1)
        return pa.table(
            {
                "block": table["block"][:1], "n": table["n"][:1], "cluster": pa.array([cluster.astype("<u2").tobytes()], pa.binary()),
                "distance": pa.array([total[np.arange(n), cluster].astype("<i8").tobytes()], pa.binary()),
            }
        )

    return parts.groupBy("block").applyInArrow(reduce, "block long, n int, cluster binary, distance binary")


def updated(shards: DataFrame, clusters: DataFrame, old: np.ndarray, shard_dim: int) -> np.ndarray:
    """New centroids: for each shard, floor(sum / count) of its own columns by cluster."""
    k, dim = old.shape
    shard_count = -(-dim // shard_dim)
    sent_back = clusters.select("block", "cluster", F.explode(F.sequence(F.lit(0), F.lit(shard_count - 1))).alias("shard"))

    def sums(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for shard, n, vecs, cluster in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = np.frombuffer(cluster, "<u2")
                x = vectors.from_bytes(vecs, n, min(shard_dim, dim - shard * shard_dim))
                held = total.setdefault(shard, [np.zeros((k, x.shape[1]), object), np.zeros(k, np.int64)])
                member = np.zeros((k, n))
                member[own, np.arange(n)] = 1
                held[0] += (member @ x.astype(np.float64)).astype(np.int64)  # below 2**27 * 2**12: exact
                held[1] += np.bincount(own, minlength=k)
        rows = [
            {"shard": shard, "cluster": c, "place": p, "sum": int(s[c, p]), "n": int(n[c])}
            for shard, (s, n) in total.items() for c in np.flatnonzero(n).tolist() for p in range(s.shape[1])
        ]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("cluster", pa.int32()), ("place", pa.int32()), ("sum", pa.int64()), ("n", pa.int64())]))

    joined = shards.join(sent_back, ["block", "shard"]).select("shard", "n", "vecs", "cluster")
    by = joined.mapInArrow(sums, "shard int, cluster int, place int, sum long, n long").groupBy("shard", "cluster", "place")
    new = old.copy()
    for r in by.agg(F.sum("sum").alias("s"), F.sum("n").alias("n")).selectExpr("*", "(s - pmod(s, n)) div n as mean").collect():
        new[r.cluster, r.shard * shard_dim + r.place] = r.mean
    return new


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024,
    shard_dim: int = SHARD_DIM, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    spark = rows.sparkSession
    most = lambda _: COMPONENT - 1
    of_length = F.when(F.size(vec_col) == dim, F.col(vec_col))
    usable = keep(vectors.vectors(rows, of_length, scale, most, id=F.col(id_col)), "centroids-rows")
    blocks = keep(vectors.packed(usable, "id", block_rows=BLOCK_ROWS), "centroids-blocks")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    start = seeds(usable, k, seed)
    if not start:
        return spark.createDataFrame([], schema)
    c = np.stack(start)
    size = blocks.agg(F.sum(F.length("vecs"))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    shards, table = bucketed(column_blocks(blocks, shard_dim), buckets, "block", "shard")
    for left in range(rounds, -1, -1):
        sent = share(spark, c)
        found = assigned(partial_distances(shards, sent, shard_dim), len(c))
        if left:
            c = updated(shards, found, c, shard_dim)
        else:
            found = keep(found, "centroids-assigned")
        release([sent])
    spark.sql(f"drop table {table}")
    digest = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in c.tolist()]

    def spread(batches):
        for batch in batches:
            for n, longs, own, distance in zip(*(batch.column(i).to_pylist() for i in range(4))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(longs, "<i8")), pa.array(np.frombuffer(own, "<u2").astype(np.int32)), pa.array(np.frombuffer(distance, "<i8"))],
                    ["vec_id", "cluster", "distance"],
                )

    flat = blocks.select("block", "n", "longs").join(found.select("block", "cluster", "distance"), "block").select("n", "longs", "cluster", "distance")
    flat = keep(flat.mapInArrow(spread, "vec_id long, cluster int, distance long"), "centroids-flat")
    inertia = {r.cluster: int(r.total) for r in flat.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    fit = lambda x: F.lit(min(x, 2**63 - 1)).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    return flat.select(
        "vec_id", "cluster", "distance", of([fit(inertia.get(i, 0)) for i in range(len(c))]).alias("cluster_inertia"),
        fit(sum(inertia.values())).alias("inertia"), of([F.lit(d) for d in digest]).alias("centroid_sha256"),
    )
