"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. A window of ``window_sequences`` sequences takes
from every queue its share of the window; the fraction of a token that a share leaves over is the
queue's deficit and carries to the next window, so after any number of windows a queue is within
one token of its target. When a queue runs dry, the others' shares are scaled up from the next
window on. The whole schedule follows from the queues' totals: between two exhaustions the tokens
taken after k windows are a closed form of k. So the driver computes a few phases from one number
for each source, and every task places its own documents, whatever partition they lie in.

Queue order is the order of storage: the encoded table holds, for each row, its partition and the
tokens before it in that partition, and sums of partitions give the rest. No task sees a whole
queue, and ids are neither shuffled nor sorted.

Every token gets exactly one place. All sequences are full but for the end of the last window,
which is cut at powers of two, so nothing is padded.

Defined cases: a null or empty text is the end token alone; a null source is a queue of its own;
rows with the same id are packed separately; an empty table gives no pieces; other input columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.llm.scratch import keep
from tideline.llm.text import chunks

SEQUENCE, WINDOW_SEQUENCES, END_ID = 2048, 32, 1
BROADCAST_BLOCKS = 100_000


def encoded(docs: DataFrame, vocabulary, id_col: str, text_col: str, source_col: str, end_id: int) -> DataFrame:
    """id, queue, n, ids (little-endian, unsigned, 16 bits where all ids fit), part, before."""
    kind = dict(docs.dtypes)[id_col]
    form = np.dtype(stored_form(vocabulary.value, end_id))

    def apply(batches):
        part, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo, hi, chunk in chunks(batch.column(2), tokens.CHUNK):
                ids, border = tokens.encode(chunk, vocabulary.value)
                out = np.full(len(ids) + chunk.rows, end_id, form)
                at = np.arange(len(ids)) + np.repeat(np.arange(chunk.rows), np.diff(border))
                out[at] = ids
                border = border + np.arange(chunk.rows + 1)
                n, queue, start = np.diff(border), batch.column(1).slice(lo, hi - lo).to_pylist(), []
                for q, k in zip(queue, n.tolist()):
                    start.append(before.get(q, 0))
                    before[q] = start[-1] + k
                width = form.itemsize * border
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), chunk.rows, [None, pa.py_buffer(width.astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(queue, pa.string()), pa.array(n), binary.cast(pa.binary()), pa.array(np.full(chunk.rows, part)), pa.array(start, pa.int64())],
                    ["id", "queue", "n", "ids", "part", "before"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("queue"), F.col(text_col).alias("text"))
    return rows.mapInArrow(apply, f"id {kind}, queue string, n long, ids binary, part long, before long")


def stored_form(vocabulary: str, end_id: int) -> str:
    return "<u2" if max(tokens.largest_id(vocabulary), end_id) < 1 << 16 else "<u4"


@dataclass
class Phase:
    """Windows ``first`` to ``first + count`` that share targets; ``taken``: tokens before, by queue."""

    first: int
    count: int
    taken: np.ndarray
    share: np.ndarray
    quota: np.ndarray | None = None  # of a single window, where a queue runs dry

    def after(self, k: int, window: int) -> np.ndarray:
        """Tokens of each queue in the first ``k`` windows of this phase."""
        if self.quota is not None:
            return self.quota * k
        return _apportion(k * window, self.share)


def _apportion(total: int, share: np.ndarray) -> np.ndarray:
    """Whole tokens that sum to ``total``, each within one of its share."""
    exact = total * share
    out = np.floor(exact).astype(np.int64)
    short = int(total - out.sum())
    if short > 0:
        out[np.argsort(-(exact - out), kind="stable")[:short]] += 1
    elif short < 0:  # rounding of the shares' sum
        out[np.argsort(exact - out, kind="stable")[: -short]] -= 1
    return out


@dataclass
class Schedule:
    queues: list[str]
    total: np.ndarray
    window: int
    phases: list[Phase] = field(default_factory=list)

    @classmethod
    def plan(cls, totals: Mapping[str, int], weights: Mapping[str, float] | None, window: int) -> "Schedule":
        """``weights``: target proportions by source; without them, each source's share of all tokens."""
        queues = sorted(totals)
        total = np.array([totals[q] for q in queues], np.int64)
        out = cls(queues, total, window)
        left, taken, first = total.copy(), np.zeros(len(queues), np.int64), 0
        want = total.astype(float) if weights is None else np.array([max(1e-9, float(weights.get(q, 0.0))) for q in queues])
        while left.sum() > 0:
            share = np.where(left > 0, want, 0.0)
            share /= share.sum()
            # At least two tokens a window, so that a queue's count never falls when rounded.
            share = np.where(left > 0, np.maximum(share, 2.0 / window), 0.0)
            share /= share.sum()
            live = left > 0
            count = int(np.floor(((left[live] - 2) / (window * share[live])).min()))
            if count >= 1:
                phase = Phase(first, count, taken.copy(), share)
            else:
                count, size = 1, int(min(window, left.sum()))
                quota = np.minimum(left, _apportion(size, share))
                while (short := size - int(quota.sum())) > 0:
                    room = left - quota
                    part = np.where(room > 0, share, 0.0)
                    quota += np.minimum(room, _apportion(short, part / part.sum()))
                phase = Phase(first, 1, taken.copy(), share, quota)
            got = phase.after(count, window)
            out.phases.append(phase)
            taken, left, first = taken + got, left - got, first + count
        return out

    def taken(self, w: int) -> np.ndarray:
        """Tokens of each queue before window ``w``."""
        firsts = [p.first for p in self.phases]
        p = self.phases[max(0, int(np.searchsorted(firsts, w, "right")) - 1)]
        return p.taken + p.after(min(w - p.first, p.count), self.window)

    def window_of(self, j: int, x: int) -> int:
        """The window that holds token ``x`` of queue ``j``."""
        starts = [int(p.taken[j]) for p in self.phases]
        i = max(0, int(np.searchsorted(starts, x, "right")) - 1)
        p = self.phases[i]
        lo, hi = p.first, p.first + p.count
        if p.quota is None:
            guess = p.first + int((x - p.taken[j]) / (self.window * p.share[j]))
            lo, hi = max(lo, guess - 2), min(hi, guess + 3)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.taken(mid)[j] <= x else (lo, mid)
        return lo


def sequence_borders(total: int, sequence: int) -> np.ndarray:
    """Starts of the sequences after the last full one: the rest, cut at powers of two."""
    at, out = total - total % sequence, []
    while at < total:
        out.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return np.array([*out, total], np.int64)


def _place(batches, schedule: Schedule, sequence: int, with_ids: bool, form: str):
    index = {q: j for j, q in enumerate(schedule.queues)}
    whole = int(schedule.total.sum())
    tail = sequence_borders(whole, sequence)
    full = whole // sequence
    cum: dict[int, np.ndarray] = {}

    def taken(w: int) -> np.ndarray:
        if w not in cum:
            if len(cum) > 10_000:
                cum.clear()
            cum[w] = schedule.taken(w)
        return cum[w]

    for batch in batches:
        rows, at, crc, start, length, tokens_, seq, offset, piece_ids = batch.num_rows, [], [], [], [], [], [], [], []
        queue, n, begin = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()
        for i in range(rows):
            j, x, end = index[queue[i]], begin[i], begin[i] + n[i]
            ids = np.frombuffer(batch.column(3)[i].as_buffer(), form).astype("<u4")
            w = schedule.window_of(j, x)
            while x < end:
                now, after = taken(w), taken(w + 1)
                stop = min(end, int(after[j]))
                place = w * schedule.window + int((after - now)[:j].sum()) + x - int(now[j])
                while x < stop:
                    k = place // sequence
                    if k < full:
                        first, last = k * sequence, (k + 1) * sequence
                    else:
                        t = int(np.searchsorted(tail, place, "right")) - 1
                        k, first, last = full + t, int(tail[t]), int(tail[t + 1])
                    size = min(stop - x, last - place)
                    s = x - begin[i]
                    cut = ids[s : s + size]
                    at.append(i)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(cut))
                    tokens_.append(n[i])
                    seq.append(k)
                    offset.append(place - first)
                    if with_ids:
                        piece_ids.append(cut.astype(np.int64))
                    x, place = x + size, place + size
                w += 1
        columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens_, seq, offset))]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array(piece_ids, pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def pack(
    docs: DataFrame, vocabulary_path: str, weights: Mapping[str, float] | None = None, sequence: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES, end_id: int = END_ID, with_ids: bool = True,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``weights``: target token proportions by source. One total for each source and phases bounded
    by three for each source reach the driver; the vocabulary file's content is broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary_path) as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = keep(encoded(docs, vocabulary, id_col, text_col, source_col, end_id), "packing")
    blocks = rows.groupBy("queue", "part").agg(F.sum("n").alias("block"))
    totals = {r["queue"]: int(r["total"]) for r in blocks.groupBy("queue").agg(F.sum("block").alias("total")).collect()}
    named = None if weights is None else {q: weights.get(q[1:] if q else None, 0.0) for q in totals}
    schedule = Schedule.plan(totals, named, sequence * window_sequences)
    earlier = F.sum("block").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("queue", "part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    # One row for each partition and source; beyond that bound the join shuffles.
    if blocks.count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    placed = rows.join(starts, ["queue", "part"]).select("id", "queue", "n", "ids", (F.col("earlier") + F.col("before")).alias("begin"))
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    form = stored_form(vocabulary.value, end_id)
    return placed.mapInArrow(lambda b: _place(b, schedule, sequence, with_ids, form), schema).withColumnRenamed("id", id_col)
