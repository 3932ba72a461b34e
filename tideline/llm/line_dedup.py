"""Exact set-similarity join of lines: later lines that resemble an earlier one are removed.

A line's set is its distinct lower-case words. Lines are ordered by id and line number; a line of
at least ``min_words`` words goes if an earlier line of the corpus, in any document, has a Jaccard
similarity of ``similarity`` per cent or more with it, whether or not that one stays.

Equal sets are one class: all but its first line go. Between classes: words are ordered by rarity
(occurrences in the corpus, in ``BUCKETS`` hashed counters), a line gives the rarest words of its
prefix, and lines that share one of them are compared by length, by position and by a
parity bitmap of 128 or 256 bits, all of which are exact bounds. What passes is verified on the full sets.

Lines that share a prefix word are met in the lines' order, each with the first ``NEAR``,
and each gives the first ``GIVEN`` pairs that pass the filters; this bounds what a very frequent
word or a large family of like lines can make. Lines for which this has not shown all pairs
with earlier ones, and which those it has shown do not remove, are then joined with all lines of
their words. So no match is lost.

Words are dealt by their hash to buckets of about ``BUCKET`` prefix rows each, as many as the corpus needs.
A row of the shuffle holds many prefix rows of one bucket, as bytes. Where a bucket has more than ``HELD``
rows because of frequent words, all but the first ``NEAR`` of each such word are met and let go.

Buckets are met in ``ROUNDS`` turns, each over its own share of the words, and a turn's shuffle files go
once its pairs are written. So the disk holds one share at a time.

Defined cases: null and empty texts have one line without words, which stays; lines of fewer words
than ``min_words`` always stay; null ids come first, equal or null ids order by their line numbers, and
each text loses its own lines (of equal ids, equal texts the same ones); empty tables give empty results; other columns are left as they are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.scratch import drop, keep, kept, share, shared, shuffles_removed, unused
from tideline.llm.text import Chunk, chunks, mix

SIMILARITY, MIN_WORDS = 75, 5
BUCKETS = 1 << 21
COUNTED = 1 << 18  # bytes of texts whose words are counted at once
BLOCK = 1 << 13  # counters of a row, while they are summed
NEAR, GIVEN = 4_096, 12
#: Sets of more than LONG words have 256 bits, the others 128 (and two empty columns). The halves
#: of the longer bitmap, xored, are the shorter one, so any two sets can be compared.
LONG, BITS = 100, ("b0", "b1", "b2", "b3")
BROADCAST_ROWS = 100_000
ROUNDS = 2
BUCKET, HELD = 1 << 15, 1 << 18
LARGE = 1_024  # words of more rows are met row by row, others by windows of length
PAIRS = 1_000_000  # pairs that are compared at once
GATHERED = 1 << 18  # prefix rows that are dealt to buckets at once
#: Numbers of a line before its prefix words: its size and its bitmap. Numbers of a prefix row: word
#: and place, key, line number and size in one, bitmap.
HEAD, ROW = 5, 7
#: A word of a prefix and its place in one number: 48 bits of the word's hash, then the place. Later
#: places than these bits hold count as the last they hold, which only weakens the position bound.
PLACE = (1 << 16) - 1
_U = np.uint64


def _words(chunk: Chunk):
    spans = chunk.words()
    return spans, Chunk.span_hash(chunk.prefix_hash(chunk.raw, lower=True), spans.start, spans.end)


def _bucket_counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, chunk in chunks(batch.column(0), COUNTED):
            _, h = _words(chunk)
            b = np.sort((h >> _U(40)).astype(np.int64) & (BUCKETS - 1))
            first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else b
            total[b[first]] += np.diff(np.append(first, len(b)))
    some = np.flatnonzero(total)
    block, first = np.unique(some // BLOCK, return_index=True)
    border = np.append(first, len(some)).astype(np.int32)
    listed = lambda x: pa.ListArray.from_arrays(border, pa.array(x.astype(np.int32)))
    yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), listed(some % BLOCK), listed(np.minimum(total[some], 2**31 - 1))], ["block", "bucket", "n"])


def _block_rarity(counts: pa.Table) -> pa.Table:
    flat = lambda name: counts[name].combine_chunks().flatten().to_numpy()
    n = np.bincount(flat("bucket"), flat("n"), BLOCK)
    rare = np.minimum(255, np.ceil(8 * np.log2(np.maximum(n, 1)))).astype(np.uint8)
    return pa.table({"block": counts["block"][:1], "rare": pa.array([rare.tobytes()])})


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """A byte for each hashed counter: 0 for one occurrence, then 16 steps for each doubling.
    These bytes are all that comes to the driver, whatever the corpus."""
    with shuffles_removed(docs.sparkSession):
        counts = docs.select(text_col).mapInArrow(_bucket_counts, "block int, bucket array<int>, n array<int>")
        blocks = counts.groupBy("block").applyInArrow(_block_rarity, "block int, rare binary").toArrow()
    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint8)
    for block, rare in zip(blocks["block"].to_pylist(), blocks["rare"].to_pylist()):
        out[block] = np.frombuffer(rare, np.uint8)
    return out.reshape(-1)


def _by_line(line: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The order by line, then by name (56 bits)."""
    if len(line) and line[-1] < 1 << 17:  # one sort of the line and the upper bits of the name
        both = (line.astype(_U) << _U(47)) | (name >> _U(9))
        order = np.argsort(both)
        both, sorted_ = both[order], name[order]
        if not ((both[1:] == both[:-1]) & (sorted_[1:] != sorted_[:-1])).any():
            return order
    return np.lexsort((name, line))


class LineSets:
    """Distinct words of the lines of a chunk that have enough words, in order of rarity."""

    def __init__(self, chunk: Chunk, rare: np.ndarray, min_words: int):
        spans, h = _words(chunk)
        lines = chunk.lines()
        a, b = np.searchsorted(spans.start, lines.start), np.searchsorted(spans.start, lines.end)
        use = np.flatnonzero(b - a >= min_words)
        self.row, self.number = lines.row[use], use - lines.first[lines.row[use]]
        size = (b - a)[use]
        line = np.repeat(np.arange(len(use)), size)
        at = np.repeat(a[use] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        word = h[at]
        weight = rare[(word >> _U(40)).astype(np.int64) & (BUCKETS - 1)].astype(_U)
        # rarity, then 48 bits of the word's hash: one number that orders and names a word
        name = (weight << _U(48)) | (word & _U((1 << 48) - 1))
        order = _by_line(line, name)
        line, name = line[order], name[order]
        new = np.append(True, (line[1:] != line[:-1]) | (name[1:] != name[:-1])) if len(line) else np.zeros(0, bool)
        self.line, self.name = line[new], name[new]
        self.first = np.searchsorted(self.line, np.arange(len(use) + 1))
        self.n = np.diff(self.first)
        self.position = np.arange(len(self.line)) - np.repeat(self.first[:-1], self.n)
        if len(use):
            mixed = mix(self.name)
            self.key = np.add.reduceat(mixed, self.first[:-1]) if len(self.name) else np.zeros(0, _U)
            bit = mixed & np.where(np.repeat(self.n, self.n) > LONG, _U(255), _U(127))
            one = _U(1) << (bit & _U(63))
            part, long_, self.bits = bit >> _U(6), self.n > LONG, []
            of_long = np.repeat(long_, self.n)
            for k in range(4):  # only words of longer lines have the upper half
                out = np.zeros(len(use), _U)
                lines_, words = (slice(None), slice(None)) if k < 2 else (long_, of_long)
                if k < 2 or long_.any():
                    first = np.cumsum(self.n[lines_]) - self.n[lines_]
                    out[lines_] = np.bitwise_xor.reduceat(np.where(part[words] == _U(k), one[words], _U(0)), first)
                self.bits.append(out)
        else:
            self.key = np.zeros(0, _U)
            self.bits = [self.key] * 4


def _lines(batches, rare, min_words: int, similarity: int):
    rare = shared(rare)
    for batch in batches:
        for lo, hi, chunk in chunks(batch.column(1)):
            s = LineSets(chunk, rare, min_words)
            prefix = s.n - (similarity * s.n + 99) // 100 + 1
            # A word that occurs once leads nowhere; its place in the order still counts.
            use = (s.position < np.repeat(prefix, s.n)) & ((s.name >> _U(48)) > 0)
            # One line of a class in a chunk gives its prefix, the first by (id, line): so a class's
            # first row in a stream is that of its first line.
            rank = pc.rank(batch.column(0).slice(lo, hi - lo), null_placement="at_start", tiebreaker="dense").to_numpy()
            order = np.lexsort((s.number, rank[s.row], s.key))
            lead = np.zeros(len(s.key), bool)
            lead[order] = np.append(True, s.key[order][1:] != s.key[order][:-1])[: len(order)]
            use &= np.repeat(lead, s.n)
            entry, count = (s.name[use] << _U(16)) | np.minimum(s.position[use], PLACE).astype(_U), np.bincount(s.line[use], minlength=len(s.key))
            some = np.flatnonzero(count)
            size = np.where(count, HEAD + count, 0)
            off = np.concatenate(([0], np.cumsum(size)))
            words = np.empty(off[-1], _U)
            for k, x in enumerate((s.n.astype(_U), *s.bits)):
                words[off[some] + k] = x[some]
            words[np.repeat(off[some] + HEAD - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(len(entry))] = entry
            # First a row for each document, as line -1.
            docs = np.arange(hi - lo)
            row, none = pa.array(lo + np.concatenate((docs, s.row))), np.zeros(len(docs), np.int64)
            joined = lambda a, b, kind: pa.array(np.concatenate((a, b)).astype(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row), batch.column(2).take(row), joined(none - 1, s.number, np.int32), joined(none, s.key.view(np.int64), np.int64),
                    joined(none, count, np.int32), _bytes(words, np.concatenate((none, off))),
                ],
                ["id", "doc", "line", "key", "prefix", "words"],
            )


def _bytes(numbers: np.ndarray, border: np.ndarray) -> pa.Array:
    """Numbers of 64 bits as one binary value from each border to the next."""
    off = (8 * border).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(numbers))])


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of such binary values, and their borders."""
    values = values.cast(pa.large_binary())
    _, off, data = values.buffers()
    off = np.frombuffer(off, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(_U), (off - off[0]) // 8


def _pieces(batches):
    """Lines (id, key, line, words) in slices of about GATHERED numbers, one line at least."""
    for batch in batches:
        _, off = _numbers(batch.column(3))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + GATHERED, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _prefix_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines (id, key, line, words): a matrix of what each line's prefix rows have in common, and of
    each prefix row its line and its word with its place."""
    flat, off = _numbers(batch.column(3))
    head, count = off[:-1], np.maximum(np.diff(off) - HEAD, 0)
    common = np.zeros((batch.num_rows, ROW - 1), _U)
    some = np.flatnonzero(count)
    common[:, 0] = batch.column(1).to_numpy().view(_U)
    common[some, 1] = (batch.column(2).to_numpy()[some].astype(_U) << _U(32)) | flat[head[some]]
    for k in range(1, HEAD):
        common[some, 1 + k] = flat[head[some] + k]
    at = np.repeat(head + HEAD - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return common, np.repeat(np.arange(batch.num_rows), count), flat[at]


def _dealt(batches, turn: int, rounds: int, buckets: int):
    """Prefix rows of this turn's words: their ids and numbers, a row for each bucket of some lines."""

    def deal(parts):
        ids, common, line, entry = parts
        ids, common, entry = pa.concat_arrays(ids), np.concatenate(common), np.concatenate(entry)
        line = np.concatenate(line)
        bucket = ((entry >> _U(16)) // _U(rounds) % _U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, line = bucket[order], line[order]
        border = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        rows = np.empty((len(order), ROW), _U)
        rows[:, 0], rows[:, 1:] = entry[order], common[line]
        listed = pa.ListArray.from_arrays(border.astype(np.int32), ids.take(pa.array(line)))
        return pa.RecordBatch.from_arrays([pa.array(bucket[border[:-1]].astype(np.int32)), listed, _bytes(rows, ROW * border)], ["bucket", "ids", "rows"])

    parts, lines, held = ([], [], [], []), 0, 0
    for batch in _pieces(batches):
        common, line, entry = _prefix_rows(batch)
        own = np.flatnonzero((entry >> _U(16)) % _U(rounds) == turn)
        for to, x in zip(parts, (batch.column(0), common, line[own] + lines, entry[own])):
            to.append(x)
        lines, held = lines + len(common), held + len(own)
        if held >= GATHERED:
            yield deal(parts)
            parts, lines, held = ([], [], [], []), 0, 0
    if held:
        yield deal(parts)


def _words_of(batches, wanted=None):
    """(word, key, n, place, bitmap) of every prefix row whose word the bitmap of words may hold."""
    wanted = None if wanted is None else shared(wanted)
    for batch in _pieces(batches):
        common, line, entry = _prefix_rows(batch)
        if wanted is not None:
            hit = wanted[((entry >> _U(16)) & _U(len(wanted) - 1)).astype(np.int64)]
            line, entry = line[hit], entry[hit]
        rows = common[line].view(np.int64)
        n, place = (rows[:, 1] & 0xFFFFFFFF).astype(np.int32), (entry & _U(PLACE)).astype(np.int32)
        columns = [(entry >> _U(16)).view(np.int64), rows[:, 0], n, place, *(rows[:, k] for k in range(2, ROW - 1))]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["word", "key", "n", "place", *BITS])


def _passing(i, j, key, n, left, bits, similarity: int) -> np.ndarray:
    """Which pairs of rows (i, j) pass the position, length and bitmap filters: exact upper bounds
    of the overlap against the least overlap of similar sets.

    ``left``: words of the set from this one on. The position bound takes this word for the rarest
    that both share. Where it is not, the pair may fail here, and meets again under the rarest.
    Bits that differ are no more than the words that only one set has. Bounds are taken one after
    another, each of what the last one left.
    """
    ni, nj = n[i], n[j]
    at = np.flatnonzero((100 + similarity) * np.minimum(left[i], left[j]) >= similarity * (ni + nj))
    i, j, ni, nj = i[at], j[at], ni[at], nj[at]
    some = np.flatnonzero((100 * np.minimum(ni, nj) >= similarity * np.maximum(ni, nj)) & (key[i] != key[j]))
    at, i, j, both = at[some], i[some], j[some], (ni + nj)[some]
    x = [b[i] ^ b[j] for b in bits]
    short = np.minimum(n[i], n[j]) <= LONG
    count = lambda v: np.bitwise_count(v).astype(np.int32)
    differ = np.where(short, count(x[0] ^ x[2]) + count(x[1] ^ x[3]), sum(map(count, x)))
    return at[(100 + similarity) * (both - differ) >= 2 * similarity * both]


def _windows(rows, first, n, left, similarity: int):
    """Pairs (i, j) of rows of one word whose lengths may be similar, j the shorter or as long, some twice,
    in blocks of whole words. ``first``: where a row's word begins. The position bound leaves
    as j only rows whose own length allows the least overlap."""
    j = rows[(100 + similarity) * left[rows].astype(np.int64) >= 2 * similarity * n[rows].astype(np.int64)]
    by = (first[j] << 32) | n[j]
    order = np.argsort(by)
    j, by = j[order], by[order]
    word, least = first[rows] << 32, -(-similarity * n[rows].astype(np.int64) // 100)
    lo = np.searchsorted(by, word | least)
    count = np.searchsorted(by, word | n[rows], "right") - lo
    border = np.concatenate(([0], np.cumsum(count)))
    new = np.append(np.flatnonzero(np.append(True, first[rows][1:] != first[rows][:-1])), len(rows)) if len(rows) else np.zeros(1, np.int64)
    a = 0
    while a < len(new) - 1:
        b = max(a + 1, int(np.searchsorted(border[new], border[new[a]] + PAIRS, "right")) - 1)
        x, y = new[a], new[b]
        at = np.repeat(np.arange(x, y), count[x:y])
        yield rows[at], j[lo[at] + np.arange(border[x], border[y]) - border[at]]
        a = b


class _Bucket:
    """Prefix rows of a bucket that are yet to be met."""

    def __init__(self, similarity: int):
        self.similarity, self.parts, self.limit = similarity, [], HELD

    def add(self, ids: pa.Array, rows: np.ndarray) -> None:
        self.parts.append((ids, rows, np.zeros(len(rows), bool)))

    def full(self) -> bool:
        return sum(len(rows) for _, rows, _ in self.parts) >= self.limit

    def _sorted(self):
        """Rows by word, those met before first, then in the lines' order. A class of equal lines has a
        row from each chunk that holds one; its first row counts."""
        ids, rows, met = pa.concat_arrays([x for x, _, _ in self.parts]), *(np.concatenate(x) for x in list(zip(*self.parts))[1:])
        word, key = rows[:, 0] >> _U(16), np.ascontiguousarray(rows[:, 1]).view(np.int64)
        rank = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(_U)
        place = np.where(met, _U(0), (rank << _U(32)) | (rows[:, 2] >> _U(32)))
        order = np.lexsort((place, word))
        w, p, k = word[order], place[order], key[order]
        if ((w[1:] == w[:-1]) & (p[1:] == p[:-1]) & (k[1:] != k[:-1])).any():
            order = np.lexsort((key, place, word))
            w, k = word[order], key[order]
        name = mix(w + _U(_ODD) * k.view(_U))
        twin = np.argsort(name, kind="stable")
        again = (name[twin][1:] == name[twin][:-1]) & (w[twin][1:] == w[twin][:-1]) & (k[twin][1:] == k[twin][:-1])
        use = np.ones(len(w), bool)
        use[twin[1:][again]] = False
        order = order[use]
        return w[use], ids, rows, met, order

    def meet(self, last: bool) -> pa.RecordBatch:
        """Candidate pairs (a, b) of class keys; (a, null) where not all pairs of class a with earlier ones
        are shown. Each row meets the first NEAR rows of its word before it. Of the pairs that pass
        the filters it gives the first GIVEN.

        Unless these are the ``last`` rows of the bucket, only words of more than NEAR rows are met, and
        NEAR rows of each are held for those to come, which meet these alone. Then rows may come
        later that precede these, and both classes of a pair that is not given are marked.
        """
        word, ids, rows, met, order = self._sorted()
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        group = np.diff(np.append(start, len(word)))
        size, first = np.repeat(group, group), np.repeat(start, group)
        rank = np.arange(len(word)) - first
        large = min(LARGE, NEAR)
        some = np.flatnonzero(size > (large if last else NEAR))
        begun = met[order][first]  # rows of this word have been let go
        some = np.union1d(some, np.flatnonzero(begun)) if last else some
        own = rows[order]
        cols = [np.ascontiguousarray(own[:, k]) for k in range(1, ROW)]
        key, n = cols[0].view(np.int64), (cols[1] & _U(0xFFFFFFFF)).astype(np.int32)
        left, bits = n - (own[:, 0] & _U(PLACE)).astype(np.int32), cols[2:]
        partners = np.where(met[order], 0, np.minimum(rank, NEAR))[some]
        border = np.concatenate(([0], np.cumsum(partners)))
        unshown = (rank > NEAR if last else rank >= NEAR) | begun  # rows let go do not meet each other
        partial = [key[some[~met[order[some]] & unshown[some]]]]
        found, lo = [], 0

        def give(i, j):
            at = np.arange(len(i)) - np.searchsorted(i, i)
            given = at < GIVEN
            partial.extend((key[i[at == GIVEN]], key[j[~given & (begun[j] | (not last))]]))
            found.append((key[i[given]], key[j[given]]))

        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(border, border[lo] + PAIRS, "right")) - 1)
            at = np.repeat(np.arange(lo, hi), partners[lo:hi])
            i = some[at]
            j = first[i] + np.arange(border[lo], border[hi]) - border[at]
            good = _passing(i, j, key, n, left, bits, self.similarity)
            give(i[good], j[good])
            lo = hi
        if last:
            rest = (size <= large) & (size > 1) & ~begun
            for i, j in _windows(np.flatnonzero(rest), first, n, left, self.similarity):
                good = _passing(i, j, key, n, left, bits, self.similarity)
                i, j = i[good], j[good]
                later = np.unique((np.maximum(i, j) << 32) | np.minimum(i, j))
                give(later >> 32, later & 0xFFFFFFFF)
        if not last:
            stay = order[(size <= NEAR) | (rank < NEAR)]
            hot = (size > NEAR)[(size <= NEAR) | (rank < NEAR)]
            self.parts = [(ids.take(pa.array(stay)), rows[stay], hot | met[stay])]
            self.limit = max(HELD, 2 * len(stay))
        x, y = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 2
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
        x, y, rest = x[new], y[new], np.unique(np.concatenate(partial))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((x, rest))), pa.array(np.concatenate((y, rest)), mask=np.arange(len(x) + len(rest)) >= len(x))], ["a", "b"])


_ODD = 0x9FB21C651E98DF25


def _met_pairs(batches, similarity: int):
    """Pairs of the rows of each bucket; rows come sorted by bucket."""
    held, bucket = None, None
    for batch in batches:
        of, ids = batch.column(0).to_numpy(), batch.column(1)
        flat, off = _numbers(batch.column(2))
        values, border, off = ids.values, ids.offsets.to_numpy(), off // ROW
        rows = flat.reshape(-1, ROW)
        for i in range(len(of)):
            if bucket != of[i]:
                if held:
                    yield held.meet(True)
                held, bucket = _Bucket(similarity), of[i]
            held.add(values.slice(border[i], border[i + 1] - border[i]), rows[off[i] : off[i + 1]])
            if held.full():
                yield held.meet(False)
    if held:
        yield held.meet(True)


def _cut(chunk: Chunk, start: np.ndarray, end: np.ndarray) -> Chunk:
    """A chunk whose rows are these stretches of bytes."""
    size = end - start
    off = np.concatenate(([0], np.cumsum(size)))
    return Chunk(chunk.raw[np.repeat(start - off[:-1], size) + np.arange(off[-1])], off)


#: Factor of a line's number in its place in the bitmap of wanted lines.
STRIDE = 40_503


def _wanted_sets(batches, rare, wanted, min_words: int):
    rare, wanted = shared(rare), shared(wanted)
    for batch in batches:
        for lo, hi, chunk in chunks(batch.column(0)):
            lines, doc = chunk.lines(), batch.column(1).slice(lo, hi - lo).to_numpy()
            number = np.arange(len(lines)) - lines.first[lines.row]
            hit = wanted[(doc[lines.row] ^ number * STRIDE) & (len(wanted) - 1)]
            s = LineSets(_cut(chunk, lines.start[hit], lines.end[hit]), rare, min_words)
            _, first = np.unique(s.key, return_index=True)
            lead = np.zeros(len(s.key), bool)
            lead[first] = True
            border = np.concatenate(([0], np.cumsum(s.n[lead]))).astype(np.int32)
            items = pa.array(np.ascontiguousarray(s.name[np.repeat(lead, s.n)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(s.key[lead].view(np.int64)), pa.ListArray.from_arrays(border, items)], ["key", "items"])


def _similar(batches, similarity: int):
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        xa, oa, xb, ob = a.values.to_numpy(), a.offsets.to_numpy(), b.values.to_numpy(), b.offsets.to_numpy()
        good = []
        for i in range(batch.num_rows):
            both = np.concatenate((xa[oa[i] : oa[i + 1]], xb[ob[i] : ob[i + 1]]))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= similarity * (len(both) - common):
                good.append(i)
        at = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


WANTED_BITS = 1 << 22


def _bitmap(rows: DataFrame, number) -> np.ndarray:
    """A bitmap of fixed size that holds this number of every row, by its lowest bits."""
    with shuffles_removed(rows.sparkSession):
        bits = rows.select(number.bitwiseAND(F.lit(WANTED_BITS - 1)).cast("int").alias("bit")).distinct().toArrow()
    out = np.zeros(WANTED_BITS, bool)
    out[bits["bit"].to_numpy()] = True
    return out


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, rare, text_col: str, min_words: int, similarity: int) -> DataFrame:
    """Pairs whose full sets are similar. The sets are read again from the texts, past a bitmap of
    fixed size that holds the first lines of all wanted classes; where these are few, from the texts
    of those lines."""
    spark, doc = docs.sparkSession, unused([text_col], "_doc")
    keys = keep(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "line-keys", tidy=True)
    few = keys.count() <= BROADCAST_ROWS
    firsts = keep(classes.join(F.broadcast(keys) if few else keys, "key", "left_semi").select(F.col("first.doc").alias(doc), "first.line"), "line-firsts", tidy=True)
    sent = share(spark, _bitmap(firsts, F.col(doc).bitwiseXOR(F.col("line").cast("long") * STRIDE)))
    texts = docs.select(text_col, F.xxhash64(text_col).alias(doc))
    if few:
        texts = texts.join(F.broadcast(firsts.select(doc).distinct()), doc, "left_semi").select(text_col, doc)
    sets = (
        texts.mapInArrow(lambda x: _wanted_sets(x, rare, sent, min_words), "key long, items array<long>")
        .join(keys, "key", "left_semi").dropDuplicates(["key"])
    )
    sets = keep(sets, "line-sets", tidy=True)
    return (
        pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(lambda x: _similar(x, similarity), "a long, b long")
    )


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has few rows of a few numbers; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, _doc, line) of every line that goes: _doc hashes its text, as ids may be null or repeated;
    line numbers count from 0. Then (id, _doc) of every row of ``docs``."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rare = share(spark, rarity(docs, text_col))
    rows = keep(
        docs.select(id_col, text_col, F.xxhash64(text_col).alias("doc")).mapInArrow(
            lambda b: _lines(b, rare, min_words, similarity),
            f"id {kind}, doc long, line int, key long, prefix int, words binary",
        ), "lines", tidy=True,
    )
    lines, documents = rows.where("line >= 0"), rows.where("line < 0").select(F.col("id").alias(id_col), F.col("doc").alias("_doc"))
    classes = keep(lines.groupBy("key").agg(F.min(F.struct("id", "line", "doc")).alias("first"), F.count("*").alias("size")), "line-classes", tidy=True)

    prefix = lines.where("prefix > 0").select("id", "key", "line", "words")
    buckets = -(-(lines.agg(F.sum("prefix")).first()[0] or 1) // (BUCKET * ROUNDS))
    met, rounds = [], ROUNDS
    for turn in range(rounds):
        dealt = prefix.mapInArrow(lambda b, turn=turn: _dealt(b, turn, rounds, buckets), f"bucket int, ids array<{kind}>, rows binary")
        sorted_ = dealt.repartition("bucket").sortWithinPartitions("bucket")
        met.append(keep(sorted_.mapInArrow(lambda b: _met_pairs(b, similarity), "a long, b long"), "line-met", tidy=True))
    pairs = keep(reduce(DataFrame.union, met).distinct(), "line-pairs", tidy=True)
    drop(spark, kept[-1 - ROUNDS : -1])

    def later(found: DataFrame) -> DataFrame:
        """Of each similar pair, the class whose first line comes later; a has the smaller key."""
        firsts = classes.select("key", "first")
        return (
            found.join(firsts.withColumnsRenamed({"key": "a", "first": "fa"}), "a").join(firsts.withColumnsRenamed({"key": "b", "first": "fb"}), "b")
            .select(F.when(F.struct("fa.id", "fa.line", "a") < F.struct("fb.id", "fb.line", "b"), F.col("b")).otherwise(F.col("a")).alias("key")).distinct()
        )

    gone = keep(later(_verify(docs, classes, pairs.where("b is not null"), rare, text_col, min_words, similarity)), "line-gone", tidy=True)
    open_ = keep(pairs.where("b is null").select(F.col("a").alias("key")).join(gone, "key", "left_anti"), "line-open", tidy=True)
    if not open_.isEmpty():
        row = f"word long, key long, n int, place int, {', '.join(f'{b} long' for b in BITS)}"
        of = lambda rows, x: rows.dropDuplicates(["word", "key"]).select("word", F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "place", *BITS)))
        mine = _small(keep(of(prefix.join(_small(open_), "key", "left_semi").select("id", "key", "line", "words").mapInArrow(_words_of, row), "a"), "line-open-words", tidy=True))
        sent = share(spark, _bitmap(mine.select("word"), F.col("word")))
        others = of(prefix.mapInArrow(lambda b: _words_of(b, sent), row).join(mine.select("word"), "word", "left_semi"), "b")
        both = F.col("n_a") + F.col("n_b")
        x = [F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b")) for b in BITS]
        folded = F.bit_count(x[0].bitwiseXOR(x[2])) + F.bit_count(x[1].bitwiseXOR(x[3]))
        differ = F.when(F.least("n_a", "n_b") <= LONG, folded).otherwise(sum(map(F.bit_count, x[1:]), F.bit_count(x[0])))
        enough = lambda overlap: (100 + similarity) * overlap >= similarity * both
        rest = others.join(mine, "word").where(
            (F.col("a") != F.col("b")) & (100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
            & enough(F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))) & (2 * similarity * both <= (100 + similarity) * (both - differ))
        ).select("a", "b").distinct()
        more = later(_verify(docs, classes, keep(rest, "line-pairs", tidy=True), rare, text_col, min_words, similarity))
        gone = keep(gone.union(more).distinct(), "line-gone", tidy=True)
    bad = classes.join(gone.withColumn("gone", F.lit(True)), "key", "left").where("size > 1 or gone")
    gone_lines = (
        lines.select("id", "doc", "line", "key").join(bad, "key")
        .where(F.col("gone").isNotNull() | (F.struct("id", "line", "doc") != F.col("first")))
        .select(F.col("id").alias(id_col), F.col("doc").alias("_doc"), "line")
    )
    return gone_lines, documents


def _joined(docs: DataFrame, gone: DataFrame, id_col: str, doc_col: str) -> tuple[DataFrame, str]:
    """``docs`` with the list of their lines that go, null where none does, and that column's name.
    ``doc_col`` hashes a document's text."""
    id_, doc, removed = (unused(docs.columns, name) for name in ("_id", "_doc", "_removed"))
    lists = gone.groupBy(F.col(id_col).alias(id_), F.col("_doc").alias(doc)).agg(F.array_sort(F.collect_set("line")).alias(removed))
    return docs.join(lists, docs[id_col].eqNullSafe(lists[id_]) & (docs[doc_col] == lists[doc]), "left"), removed


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id, n_removed and removed (sorted line numbers)."""
    gone, documents = removals(docs, id_col, text_col, similarity, min_words)
    hash_ = unused([id_col], "_hash")  # texts themselves are not shuffled
    rows, removed = _joined(documents.toDF(id_col, hash_), gone, id_col, hash_)
    return rows.select(id_col, F.coalesce(F.size(removed), F.lit(0)).alias("n_removed"), F.coalesce(removed, F.array().cast("array<int>")).alias("removed"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the removed lines cut from the texts; the other columns are as they were."""
    gone, _ = removals(docs, id_col, text_col, similarity, min_words)
    lines = F.split(F.col(text_col), "\n", -1)
    hash_ = unused(docs.columns, "_hash")
    rows, removed = _joined(docs.withColumn(hash_, F.xxhash64(text_col)), gone, id_col, hash_)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(removed, i)), "\n")
    return rows.withColumn(text_col, F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
