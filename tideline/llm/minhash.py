"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, stars.

A document's set is its distinct shingles (64-bit hashes). One hash of each shingle fills 128 bins
with their minima; an empty bin copies a full one that a fixed random probe order of its own finds
first. Four neighbouring bins make a band, so two sets with a Jaccard similarity of 0.75 share one
of the 32 bands but for a chance of five in a million.

Equal sets are one class from the start. Within a bucket only a star of candidate pairs is made,
from one centre to the members that are not yet in its component, each member takes the best
centre of its buckets, and each pair is verified on the full sets. A star alone loses links
between two members that its centre does not link, so over the buckets that still hold several
components stars are made again, around the members that share most; before that, members are set
aside that provably link to no other component (too few of their shingles
occur there). What is left after the last round is compared in full across components, block by
block. So every
pair that shares a band is either verified, or already connected, or provably no link.

Defined cases: a null or empty text has the empty set and is linked with nothing; a text of fewer
words than the width has one shingle, its whole sequence; equal and null ids are separate rows whose
component is named by the smallest id in it (null where it has none), and one row of which is kept; an
empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import components
from tideline.llm.scratch import keep, unused
from tideline.llm.text import LOWER, Chunk, chunks, mix, shingles

WIDTH, SIMILARITY = 5, 75  # words; per cent
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
ROUNDS, BLOCK = 2, 128

#: For each bin, all bins in the order in which it probes them when it is empty.
PROBES = np.stack([np.random.default_rng(1000 + i).permutation(BINS) for i in range(BINS)]).astype(np.int16)
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)).astype(np.uint64)
_BAND = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))


def document_sets(chunk: Chunk, width: int = WIDTH):
    """The sorted distinct shingle hashes of each row."""
    spans, raw = chunk.words(), LOWER[chunk.raw]
    words = Chunk.span_hash(chunk.prefix_hash(raw), spans.start, spans.end)
    h, row = shingles(words, spans, width)
    border = np.searchsorted(row, np.arange(chunk.rows + 1))
    for i in range(chunk.rows):
        yield np.unique(h[border[i] : border[i + 1]])


def bands(sorted_set: np.ndarray) -> np.ndarray:
    """The 32 band keys of a set that is not empty."""
    at = np.searchsorted(sorted_set, _EDGES)
    held = sorted_set[np.minimum(at, len(sorted_set) - 1)]
    full = (at < len(sorted_set)) & ((held >> np.uint64(57)) == np.arange(BINS, dtype=np.uint64))
    if not full.all():
        empty = np.flatnonzero(~full)
        donor = PROBES[empty, full[PROBES[empty]].argmax(1)]
        held = held.copy()
        held[empty] = held[donor]

    key = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        key = mix(key + held[k::ROWS])
    return mix(key ^ _BAND)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    a, b = np.add.reduce(mix(s), dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(0x1234567)))
    return int(np.int64(np.uint64(a).view(np.int64))), int(np.uint64(b).view(np.int64))


def _signatures(batches, width: int):
    for batch in batches:
        for lo, hi, chunk in chunks(batch.column(2)):
            n, k1, k2, keys, size = [], [], [], [], []
            for s in document_sets(chunk, width):
                n.append(len(s))
                a, b = set_key(s) if len(s) else (0, 0)
                k1.append(a)
                k2.append(b)
                size.append(BANDS if len(s) else 0)
                if len(s):
                    keys.append(bands(s))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            listed = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(lo, hi - lo) for c in batch.columns[:2]), *(pa.array(x, pa.int64()) for x in (n, k1, k2)), listed], ["row", "id", "n", "k1", "k2", "bands"]
            )


def _sets(batches, width: int):
    """(node, n, items) of the rows whose set is the one asked for."""
    for batch in batches:
        k1, k2 = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi, chunk in chunks(batch.column(1)):
            kept, items = [], []
            for i, s in enumerate(document_sets(chunk, width), lo):
                if len(s) and set_key(s) == (k1[i], k2[i]):
                    kept.append(i)
                    items.append(s.view(np.int64))
            size = np.array([len(s) for s in items], np.int64)
            listed = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(np.concatenate(items) if items else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(size), listed], ["node", "n", "items"])


def _verified(batches, similarity: int):
    for batch in batches:
        sides = []
        for c in (2, 3):
            col = batch.column(c)
            sides.append((col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()))
        (xa, oa), (xb, ob) = sides
        good = []
        for i in range(batch.num_rows):
            a, b = xa[oa[i] : oa[i + 1]], xb[ob[i] : ob[i + 1]]
            if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
                continue
            both = np.concatenate((a, b))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= similarity * (len(a) + len(b) - common):
                good.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], ["u", "v"])


def verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("items").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("items").alias("b"))
    long_enough = (100 * F.least("nu", "nv") >= similarity * F.greatest("nu", "nv"))
    joined = pairs.join(left, "u").join(right, "v").where(long_enough)
    return joined.select("u", "v", "a", "b").mapInArrow(lambda x: _verified(x, similarity), "u long, v long")


def _unresolved(members: DataFrame) -> DataFrame:
    """Buckets with several components: band, least set size, and the centre with its component and
    score. The centre has the highest score, of equal ones the smallest node."""
    return (
        members.groupBy("band").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"),
            F.min_by(F.struct("node", "comp", "score"), F.struct(-F.col("score"), "node")).alias("centre"),
        ).where("low != high").select(
            "band", "least", F.col("centre.node").alias("u"), F.col("centre.comp").alias("cu"), F.col("centre.score").alias("centre_score")
        )
    )


def _stars(members: DataFrame) -> DataFrame:
    """(u, v, cu, cv): for each member of an unresolved bucket the best centre of its buckets that is
    in another component, so no more pairs than nodes."""
    rows = members.join(_unresolved(members).drop("least"), "band").where("comp != cu")
    best = F.min_by(F.struct("u", "cu"), F.struct(-F.col("centre_score"), "u"))
    return rows.groupBy(F.col("node").alias("v"), F.col("comp").alias("cv")).agg(best.alias("c")).select("c.u", "v", "c.cu", "cv")


def _set_aside(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The members of unresolved buckets that may still link to another component, scored.

    Of a node's shingles, only those that occur in another component can be shared with it. With
    ``c`` of them, and no partner smaller than ``least``, the similarity is at most
    c / (n + least - c). The count is the score as well: what shares most makes the best centre.
    """
    inside = keep(members.drop("score").join(_unresolved(members).select("band", "least"), "band"), "minhash-members")
    nodes = inside.groupBy("node", "comp", "n").agg(F.min("least").alias("least"))
    rows = nodes.join(sets.select("node", "items"), "node").select("node", "comp", "n", "least", F.explode("items").alias("item"))
    spread = rows.groupBy("item").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("item")
    counted = rows.join(spread, "item", "left_semi").groupBy("node", "n", "least").agg(F.count("*").alias("score"))
    able = counted.where(100 * F.col("score") >= similarity * (F.col("n") + F.col("least") - F.col("score"))).select("node", "score")
    return inside.drop("least").join(able, "node").select("band", "node", "n", "comp", "score")


def _remaining_pairs(members: DataFrame) -> DataFrame:
    """All pairs across components within buckets, each from the first bucket that both are in.
    A node's list of buckets has BANDS entries at most."""
    lists = members.groupBy("node").agg(F.collect_set("band").alias("all"))
    rows = members.join(lists, "node")
    one = rows.select("band", F.col("node").alias("u"), F.col("comp").alias("cu"), F.col("all").alias("au"))
    two = rows.select("band", F.col("node").alias("v"), F.col("comp").alias("cv"), F.col("all").alias("av"))
    first = F.array_min(F.array_intersect("au", "av")) == one["band"]
    return one.join(two, (one["band"] == two["band"]) & (F.col("cu") < F.col("cv")) & first).select("u", "v", "cu", "cv")


def _block_links(batches, similarity: int):
    """(u, v) of similar sets across components, from rows sorted by bucket and pair of blocks.

    A group has about two blocks of rows; overlaps of all its sets come from products of 0/1
    matrices over a bounded number of items at a time.
    """
    held, key = [], None

    def solve(rows):
        node, comp, side = (np.array([x[i] for x in rows]) for i in range(3))
        if len(node) < 2 or (comp == comp[0]).all():
            return None
        items = [x[3] for x in rows]
        size = np.array([len(x) for x in items])
        code = np.unique(np.concatenate(items), return_inverse=True)[1]
        row = np.repeat(np.arange(len(items)), size)
        common = np.zeros((len(items), len(items)), np.float32)
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        for lo in range(0, int(code[-1]) + 1, 8192):
            a, b = np.searchsorted(code, (lo, lo + 8192))
            x = np.zeros((len(items), 8192), np.float32)
            x[row[a:b], code[a:b] - lo] = 1
            common += x @ x.T
        near = 100 * common >= similarity * (size[:, None] + size[None, :] - common)
        near &= comp[:, None] < comp[None, :]
        if (side != side[0]).any():
            near &= side[:, None] != side[None, :]
        u, v = np.nonzero(near)
        return pa.RecordBatch.from_pydict({"u": node[u], "v": node[v], "cu": comp[u], "cv": comp[v]}) if len(u) else None

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        node, comp, side = (batch.column(3 + i).to_pylist() for i in range(3))
        listed = batch.column(6)
        values, border = listed.values.to_numpy(), listed.offsets.to_numpy()
        for i, k in enumerate(keys):
            if k != key:
                if held and (out := solve(held)) is not None:
                    yield out
                held, key = [], k
            held.append((node[i], comp[i], side[i], values[border[i] : border[i + 1]].copy()))
    if held and (out := solve(held)) is not None:
        yield out


def _remaining_links(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(u, v, cu, cv): the links across components within buckets, all of them.

    A bucket's largest component and its other members are dealt into blocks of about BLOCK rows;
    every block of the others meets every block. So no pair is a row, no task holds more than two
    blocks, and within the largest component nothing is compared.
    """
    parts = members.groupBy("band", "comp").agg(F.count("*").alias("c"))
    shape = parts.groupBy("band").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("top"), F.sum("c").alias("all"), F.count("*").alias("parts")
    ).where("parts > 1").select("band", "main", F.ceil(F.col("top") / BLOCK).alias("inner"), F.ceil((F.col("all") - F.col("top")) / BLOCK).alias("outer"))
    place = F.when(F.col("comp") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("inner"))).otherwise(F.col("inner") + F.pmod(F.xxhash64("node"), F.col("outer")))
    dealt = members.join(shape, "band").withColumn("block", place)
    first = F.when(F.col("block") < F.col("inner"), F.col("inner")).otherwise(F.lit(0))
    met = dealt.select("band", "node", "comp", "block", F.explode(F.sequence(first, F.col("inner") + F.col("outer") - 1)).alias("other"))
    rows = met.join(sets.select("node", "items"), "node").select(
        "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "comp", F.col("block").alias("side"), "items"
    )
    grouped = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node")
    return grouped.mapInArrow(lambda b: _block_links(b, similarity), "u long, v long, cu long, cv long").distinct()


def _few_pairs(members: DataFrame) -> bool:
    """Whether all pairs within unresolved buckets are no more than their members: then they are
    verified at once, which gives what further rounds would."""
    count = members.groupBy("band").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    row = count.agg(F.sum(F.expr("c * (c - 1) div 2")), F.sum("c")).first()
    return row[0] is None or row[0] <= 2 * row[1]


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the components that ``links`` (of old components) join."""
    joined = components(links)
    return members.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select(
        "band", "node", "n", F.coalesce("root", "comp").alias("comp"), "score"
    )


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a number for each row, as ids may be null or repeated; its column."""
    row = unused(docs.columns, "_row")
    return keep(docs.withColumn(row, F.monotonically_increasing_id()), "minhash-documents"), row


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: int = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable), kept (the first row of that id in its
    component)."""
    numbered, row = _numbered(docs.select(id_col, text_col))
    return _decisions(numbered, row, id_col, text_col, width, similarity, rounds).drop("row")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: int = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """The kept rows of ``docs``, one of each component."""
    numbered, row = _numbered(docs)
    rows = _decisions(numbered, row, id_col, text_col, width, similarity, rounds).where("kept").select(F.col("row").alias(row))
    return numbered.join(rows, row, "left_semi").select(*docs.columns)


def _decisions(numbered: DataFrame, row: str, id_col: str, text_col: str, width: int, similarity: int, rounds: int) -> DataFrame:
    kind = dict(numbered.dtypes)[id_col]
    rows = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = keep(
        rows.mapInArrow(lambda b: _signatures(b, width), f"row long, id {kind}, n long, k1 long, k2 long, bands array<long>"), "minhash-signatures",
    )
    classes = signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("node"))
    owner = signed.drop("bands").join(classes, ["k1", "k2", "n"], "left").select("row", "id", "n", "k1", "k2", F.coalesce("node", "row").alias("node"))
    owner = keep(owner, "minhash-classes")

    reps = signed.join(owner.where("row = node").select("row"), "row", "left_semi").select(F.col("row").alias("node"), "n", F.explode("bands").alias("band"))
    shared = reps.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    members = keep(reps.join(shared, "band", "left_semi").select("band", "node", "n", F.col("node").alias("comp"), F.lit(0).cast("long").alias("score")), "minhash-members")

    wanted = owner.where("row = node").join(members.select("node"), "node", "left_semi").select("node", "k1", "k2")
    sets = keep(
        wanted.join(rows.select(F.col("row").alias("node"), "text"), "node").select("node", "text", "k1", "k2").mapInArrow(lambda b: _sets(b, width), "node long, n long, items array<long>"),
        "minhash-sets",
    )

    edges: list[DataFrame] = []
    for turn in range(rounds + 1):
        last = _few_pairs(members)
        if turn == rounds and not last:
            edges.append(keep(_remaining_links(members, sets, similarity).select("u", "v"), "minhash-links"))
            break
        pairs = keep((_remaining_pairs(members) if last else _stars(members)).select("u", "v", "cu", "cv").distinct(), "minhash-pairs")
        if pairs.isEmpty():
            break
        found = keep(verify(pairs.select("u", "v"), sets, similarity), "minhash-links")
        edges.append(found)
        if last:
            break
        members = keep(_relabel(members, found.join(pairs, ["u", "v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "minhash-members")
        members = keep(_set_aside(members, sets, similarity), "minhash-members")

    if edges:
        linked = edges[0]
        for more in edges[1:]:
            linked = linked.unionByName(more)
        roots = components(linked)
        owner = owner.join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:
        owner = owner.withColumn("comp", F.col("node"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    names = owner.groupBy("comp").agg(first.alias("first"))
    return owner.join(names, "comp").select(
        "row", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept")
    )
