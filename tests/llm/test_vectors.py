"""Vector operators against brute force in plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import centroids, negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, row long, id string, dim int, vec string, block long, score string"


def awkward(seed, n=260, dim=6, spread=0.4):
    """Rows of (vec_id, vector, label): ties, copies, a hot label, nulls, other lengths, far values."""
    rng = random.Random(seed)
    one = [round(rng.gauss(0, spread), 3) for _ in range(dim)]
    rows = []
    for i in range(n):
        v = one if i % 3 == 0 else [round(rng.gauss(0, spread), 2) for _ in range(dim)]
        rows.append((i, v, 0 if i % 4 else rng.randrange(4)))
    rows += [
        (50, [0.5] * dim, 1), (50, [0.5] * dim, 1), (7, one, None), (None, one, 1), (300, None, 1), (350, [], 2), (351, [], 1),
        (400, [0.1] * (dim - 1) + [None], 1), (401, [math.nan] * dim, 1), (402, [math.inf] + [0.0] * (dim - 1), 0),
        (450, [0.25, -0.5], 1), (451, [0.25, 0.5], 1), (452, [0.5, -0.5], 2), (500, [1e6] * dim, 3), (501, [-1e6] * dim, 3),
    ]
    rng.shuffle(rows)
    return rows


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, "z") for r in rows], SCHEMA).repartition(parts)


def usable(rows, scale, most=10**9):
    fine = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, [max(-most, min(most, math.floor(scale * x))) for x in v], label) for i, v, label in fine]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def ranked(query, rows):
    return sorted((-dot(query[1], r[1]), r[0]) for r in rows if r[0] != query[0] and len(r[1]) == len(query[1]))


@pytest.mark.parametrize("block_rows,query_rows", [(4, 3), (512, 1024)])
def test_exact_topk(spark, monkeypatch, block_rows, query_rows):
    monkeypatch.setattr(vectors.packed, "__kwdefaults__", {"block_rows": block_rows})
    monkeypatch.setattr(vectors, "QUERY_ROWS", query_rows)
    for seed, k in ((1, 5), (2, 2)):
        rows = awkward(seed)
        got = sorted(tuple(r) for r in topk.search(table(spark, rows), F.col("vec_id") % 50 == 0, k).collect())
        fine = usable(rows, 256)
        want = []
        for q in fine:
            if q[0] % 50 == 0:
                want += [(q[0], i + 1, number, -minus) for i, (minus, number) in enumerate(ranked(q, fine)[:k])]
        assert got == sorted(want)
    nothing = spark.createDataFrame([], SCHEMA)
    assert topk.search(nothing, F.col("vec_id") % 50 == 0).collect() == []


def test_pruning_leaves_blocks_out_and_loses_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-90, 90, (12, 16))
    x = np.repeat(centres, 40, 0) + rng.integers(-4, 5, (480, 16))
    held = [(np.arange(i, i + 20)[:, None], x[i : i + 20].astype(np.int32)) for i in range(0, 480, 20)]
    q = x[::48].astype(np.int32)
    numbers = np.stack([np.arange(10), np.arange(0, 480, 48), np.full(10, vectors.LOW)], 1)
    at, score, number, scored = topk.prune(held, {}, numbers, q, 4, False)
    for j in range(10):
        all_ = sorted((-int(s), i) for i, s in enumerate(q[j].astype(int) @ x.T) if i != 48 * j)[:4]
        assert sorted(zip(-score[at == j], number[at == j])) == all_
    assert scored < 0.5 * 10 * 480
    bound = topk.bounds(q, np.stack([v.max(0) for _, v in held]), np.stack([v.min(0) for _, v in held]))
    assert all((bound[:, b] >= (q.astype(int) @ v.T).max(1)).all() for b, (_, v) in enumerate(held))


@pytest.mark.parametrize("block_rows", [5, 512])
def test_hard_negatives(spark, monkeypatch, block_rows):
    monkeypatch.setattr(vectors.packed, "__kwdefaults__", {"block_rows": block_rows})
    for seed, positives, k, low, high in ((3, 5, 3, 50, 95), (4, 3, 2, 0, 100)):
        rows = awkward(seed)
        got = sorted(tuple(r) for r in negatives.mine(table(spark, rows), F.col("vec_id") % 25 == 0, F.col("label"), positives, k, low, high).collect())
        fine = [r for r in usable(rows, 256) if r[2] is not None]
        want = []
        for a in fine:
            if a[0] % 25:
                continue
            same = ranked(a, [r for r in fine if r[2] == a[2]])[:positives]
            others = ranked(a, [r for r in fine if r[2] != a[2]])
            for minus, number in same:
                window = [(-m, i) for m, i in others if low * -minus <= 100 * -m <= high * -minus][:k]
                want += [(a[0], number, i + 1, n, -minus, s) for i, (s, n) in enumerate(window)]
        assert got == sorted(want) and got
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0, F.col("label")).collect() == []


def lloyd(fine, k, rounds, seed):
    order = sorted(fine, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(r[1]) for r in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, one)), j) for j, one in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v, _ in fine]
        for j in range(len(c)):
            members = [v for (_, v, _), o in zip(fine, own) if o == j]
            if members:
                c[j] = [sum(col) // len(members) for col in zip(*members)]
    at = [near(v) for _, v, _ in fine]
    total = {j: sum(d for d, o in at if o == j) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in c]
    return sorted((i, j, d, total[j], sum(total.values()), digest[j]) for (i, _, _), (d, j) in zip(fine, at))


@pytest.mark.parametrize("k,rounds,shard_dim", [(8, 10, 2), (3, 2, 4), (8, 1, 64)])
def test_centroid_clusters(spark, monkeypatch, k, rounds, shard_dim):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 30)
    rows = awkward(6)
    if k == 3:
        rows = [r for r in rows if r[0] not in (500, 501)]
    got = sorted(tuple(r) for r in centroids.cluster(table(spark, rows), k, rounds, dim=6, shard_dim=shard_dim).collect())
    fine = [r for r in usable(rows, 1024, centroids.COMPONENT - 1) if len(r[1]) == 6]
    assert got == lloyd(fine, k, rounds, 3)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1, 0.2], 0), (2, [0.1, 0.2], 0), (3, [0.3], 1)]
    got = sorted(tuple(r) for r in centroids.cluster(table(spark, rows), dim=2).collect())
    assert got == lloyd([r for r in usable(rows, 1024) if len(r[1]) == 2], 8, 10, 3)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroids.cluster(table(spark, rows)).collect() == []


def test_products_are_exact_beyond_floats():
    big = np.array([[2**30 - 1, 3], [-(2**30) + 1, 5]])
    assert vectors.product(big, big).tolist() == [[int(a) for a in row] for row in big.astype(object) @ big.astype(object).T]
    assert vectors.from_bytes(vectors.to_bytes(big), 2, 2).tolist() == big.tolist()
    assert vectors.from_bytes(vectors.to_bytes(big[:0]), 0, 2).tolist() == []
