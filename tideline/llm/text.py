"""Whole texts of an Arrow batch as bytes: words, lines and their hashes, by numpy.

Every function works on a chunk: the UTF-8 bytes of some rows laid end to end with the row
borders. White space and ASCII letters are single bytes in UTF-8, so words cut from bytes are
the words of the text. Nothing is per character or per word in Python.

A null text counts as empty. Hashes are 64 bits: a keyed polynomial of the bytes, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


SPACE = _mask((0x20, 0x20), (0x09, 0x0D))
WORD = ~SPACE
UPPER = _mask((65, 90))
LETTER = _mask((65, 90), (97, 122), (128, 255))
CONTINUATION = _mask((0x80, 0xBF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_KEY = np.random.default_rng(20_240_611).integers(0, 2**64, 256, dtype=_U)
_LOWER_KEY = _BYTE_KEY[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(0, _U), "down": np.ones(0, _U)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, _U(base & (2**64 - 1)))
            steps[0] = _U(1)
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of the input."""
    h = np.asarray(h, _U)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, "Chunk"]]:
    """Row ranges of about ``limit`` bytes, one row at least, as (first row, end row, chunk)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Chunk(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


class Spans:
    """Runs of bytes within rows: start, end (exclusive), row, and first run of each row."""

    def __init__(self, start: np.ndarray, end: np.ndarray, off: np.ndarray):
        self.start, self.end = start, end
        self.first = np.searchsorted(start, off)  # one entry more than rows
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(off) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)


class Chunk:
    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off, self.rows = raw, off, len(off) - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each row's bytes."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.off[1:]] - total[self.off[:-1]]

    def runs(self, member: np.ndarray) -> Spans:
        """Maximal runs of bytes where ``member`` holds, never across rows."""
        if not len(member):
            none = np.zeros(0, np.int64)
            return Spans(none, none, self.off)
        border = np.zeros(len(member) + 1, bool)
        border[self.off] = True
        start, end = member.copy(), member.copy()
        start[1:] &= ~member[:-1] | border[1:-1]
        end[:-1] &= ~member[1:] | border[1:-1]
        return Spans(np.flatnonzero(start), np.flatnonzero(end) + 1, self.off)

    def words(self) -> Spans:
        return self.runs(WORD[self.raw])

    def lines(self) -> Spans:
        """Lines between line feeds; a row has one more line than line feeds."""
        feed = np.flatnonzero(self.raw == 10)
        start = np.concatenate((self.off[:-1], feed + 1))
        row = np.concatenate((np.arange(self.rows), np.searchsorted(self.off, feed, "right") - 1))
        order = np.lexsort((start, row))
        start, row = start[order], row[order]
        end = self.off[row + 1].copy()  # with its row, or before the next line's feed
        if len(start) > 1:
            same = row[1:] == row[:-1]
            end[:-1][same] = start[1:][same] - 1
        out = Spans.__new__(Spans)
        out.start, out.end, out.row = start, end, row
        out.first = np.searchsorted(row, np.arange(self.rows + 1))
        out.count = np.diff(out.first)
        return out

    def prefix_hash(self, values: np.ndarray, lower: bool = False) -> np.ndarray:
        """``lower``: as if A-Z were lower-case."""
        up, _ = _power_tables(len(values) + 1)
        out = np.zeros(len(values) + 1, _U)
        np.take(_LOWER_KEY if lower else _BYTE_KEY, values, out=out[1:], mode="clip")
        out[1:] *= up[: len(values)]
        return np.cumsum(out, out=out)

    @staticmethod
    def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _power_tables(len(prefix))
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U))


_SHINGLE_KEY = mix(np.arange(1, 65, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)


def shingles(word_hash: np.ndarray, spans: Spans, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` words; a shorter row gives its whole sequence once."""
    n = len(word_hash)
    out, row = np.zeros(0, _U), np.zeros(0, np.int64)
    if n >= width:
        total = np.zeros(n - width + 1, _U)
        for i in range(width):
            total += word_hash[i : n - width + 1 + i] * _SHINGLE_KEY[i]
        whole = spans.row[: n - width + 1] == spans.row[width - 1 :]
        out, row = mix(total[whole]), spans.row[: n - width + 1][whole]
    short = np.flatnonzero((spans.count > 0) & (spans.count < width))
    if len(short):
        extra = np.zeros(len(short), _U)
        for i in range(width - 1):
            has = spans.count[short] > i
            extra[has] += word_hash[spans.first[short[has]] + i] * _SHINGLE_KEY[i]
        extra = mix(extra ^ (spans.count[short].astype(_U) << _U(56)))
        out, row = np.concatenate((out, extra)), np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, row


def row_key(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A hash that is equal only within one row."""
    return mix(h + mix(row.astype(_U) + _U(0x5851F42D4C957F2D)))


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key occurs more than once; whether it occurred before."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    later[order[1:][same]] = True
    return many, later
