"""Quality rules as a short-circuit cascade.

Each rule reads whole texts and rejects some. On a bounded sample every rule is timed alone and
its share of rejections counted; the cascade then runs the rules by rejections per second, and a
text that one rule rejects costs no further rule. The verdict is "no rule rejects", so the order
changes the cost and never the result.

Defined cases: a null or empty text has no words and counts zero; nothing is ever dropped, one
row comes out for each row in; repeated ids are separate rows; other input columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.text import (
    CONTINUATION, LETTER, UPPER, Chunk, _mask, chunks, mix, repeated, row_key,
)

SAMPLE_ROWS = 2_000
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
EXCLAIM = _mask((33, 33))


class Measures:
    """What rules ask of a chunk; each measure is computed when first asked for."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk

    @cached_property
    def words(self):
        return self.chunk.words()

    @cached_property
    def prefix(self):
        return self.chunk.prefix_hash(self.chunk.raw)

    @property
    def n_words(self):
        return self.words.count

    @cached_property
    def word_chars(self):
        raw = self.chunk.raw
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[self.words.start] += 1
        inside[self.words.end] -= 1
        return self.chunk.per_row((np.cumsum(inside)[:-1] > 0) & ~CONTINUATION[raw])

    @cached_property
    def n_symbols(self):
        return self.chunk.per_row(SYMBOL[self.chunk.raw])

    @cached_property
    def lines_with_word(self):
        lines = self.chunk.lines()
        has = np.searchsorted(self.words.start, lines.end) > np.searchsorted(self.words.start, lines.start)
        return lines.start[has], lines.end[has], lines.row[has]

    @cached_property
    def n_dup_lines(self):
        start, end, row = self.lines_with_word
        _, later = repeated(row_key(self.chunk.span_hash(self.prefix, start, end), row))
        return np.bincount(row[later], minlength=self.chunk.rows)

    @cached_property
    def n_lines(self):
        return np.bincount(self.lines_with_word[2], minlength=self.chunk.rows)

    @cached_property
    def n_repeat_words(self):
        words, n = self.words, len(self.words)
        cover = np.zeros(n, bool)
        if n >= 3:
            h = self.chunk.span_hash(self.prefix, words.start, words.end)
            whole = np.flatnonzero(words.row[:-2] == words.row[2:])
            key = mix(h[whole] + mix(h[whole + 1] + mix(h[whole + 2])))
            many, _ = repeated(row_key(key, words.row[whole]))
            at = whole[many]
            for i in range(3):
                cover[at + i] = True
        return np.bincount(words.row[cover], minlength=self.chunk.rows)

    @cached_property
    def capitals(self):
        return self.chunk.per_row(UPPER[self.chunk.raw])

    @cached_property
    def letters(self):
        return self.chunk.per_row(LETTER[self.chunk.raw] & ~CONTINUATION[self.chunk.raw])

    @cached_property
    def exclaims(self):
        return self.chunk.per_row(EXCLAIM[self.chunk.raw])


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], np.ndarray]


#: The contract's two base rules come first; the others are the method's verdict.
BASE = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
METHOD = (
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("capitals", lambda m: 10 * m.capitals > 4 * m.letters),
    Rule("exclaims", lambda m: 5 * m.exclaims > m.n_words),
    Rule("same_lines", lambda m: 10 * m.n_dup_lines > 4 * m.n_lines),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
)
RULES = BASE + METHOD


def _timed(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule]) -> Iterator[pa.RecordBatch]:
    seconds, rejected, rows = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
    for batch in batches:
        for _, _, chunk in chunks(batch.column(0)):
            rows += chunk.rows
            for i, rule in enumerate(rules):
                began = time.thread_time()
                rejected[i] += int(rule.rejects(Measures(chunk)).sum())
                seconds[i] += time.thread_time() - began
    yield pa.RecordBatch.from_pydict({"rule": np.arange(len(rules)), "seconds": seconds, "rejected": rejected, "n": np.full(len(rules), rows)})


def cascade_order(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> list[int]:
    """Rule numbers by rejections per second on at most about ``sample_rows`` rows, chosen by a hash.

    The order decides what is skipped, never what is kept.
    """
    n = docs.count()
    part = max(1, n // max(1, sample_rows))
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(part)) == 0).select(text_col)
    stats = (
        sample.mapInArrow(lambda b: _timed(b, rules), "rule long, seconds double, rejected long, n long")
        .groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()
    )
    worth = {r["rule"]: (r["rejected"] + 0.5) / (r["seconds"] + 1e-6) for r in stats}
    return sorted(range(len(rules)), key=lambda i: -worth.get(i, 0.0))


def _subset(chunk: Chunk, rows: np.ndarray) -> Chunk:
    if len(rows) == chunk.rows:
        return chunk
    size = np.diff(chunk.off)[rows]
    off = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(chunk.off[rows] - off[:-1], size) + np.arange(off[-1])
    return Chunk(chunk.raw[at], off)


def run_cascade(chunk: Chunk, rules: Sequence[Rule], order: Sequence[int], measures: Measures | None = None) -> np.ndarray:
    """The number of the first rule in ``order`` that rejects each row, or -1.

    The chunk is cut down to the survivors once they are less than half of it. ``measures``
    holds what is already known of the whole chunk; rules that ask for nothing else are free.
    """
    verdict = np.full(chunk.rows, -1)
    alive, measures = np.arange(chunk.rows), measures or Measures(chunk)
    held = alive  # rows that ``measures`` covers
    for i in order:
        if not len(alive):
            break
        if 2 * len(alive) < len(held):
            measures, held = Measures(_subset(chunk, alive)), alive
        bad = np.asarray(rules[i].rejects(measures))[np.searchsorted(held, alive)]
        verdict[alive[bad]] = i
        alive = alive[~bad]
    return verdict


def screen(
    docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[int] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``kept``, and ``rejected_by`` (the rule that ended the cascade)."""
    order = list(cascade_order(docs, rules, id_col, text_col) if order is None else order)
    names = [r.name for r in rules]

    def apply(batches):
        for batch in batches:
            for lo, hi, chunk in chunks(batch.column(1)):
                verdict = run_cascade(chunk, rules, order)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(verdict < 0), pa.array([names[v] if v >= 0 else None for v in verdict], pa.string())],
                    [id_col, "kept", "rejected_by"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(apply, f"`{id_col}` {kind}, kept boolean, rejected_by string")


BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured_screen(
    docs: DataFrame, rules: Sequence[Rule] = METHOD, order: Sequence[int] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Base counts of every document, ``base_failed``, and ``kept``: not base_failed and passed by
    the cascade of ``rules``, which runs only over documents that the base rules leave."""
    order = list(cascade_order(docs, rules, id_col, text_col) if order is None else order)

    def apply(batches):
        for batch in batches:
            for lo, hi, chunk in chunks(batch.column(1)):
                whole = Measures(chunk)
                base = [np.asarray(getattr(whole, name), np.int64) for name in BASE_COLUMNS]
                failed = np.logical_or.reduce([r.rejects(whole) for r in BASE])
                verdict = np.full(chunk.rows, -1)
                left = np.flatnonzero(~failed)
                if len(left):
                    same = len(left) == chunk.rows
                    verdict[left] = run_cascade(_subset(chunk, left), rules, order, whole if same else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *map(pa.array, base), pa.array(failed), pa.array(~failed & (verdict < 0))],
                    [id_col, *BASE_COLUMNS, "base_failed", "kept"],
                )

    kind = dict(docs.dtypes)[id_col]
    counts = ", ".join(f"{c} long" for c in BASE_COLUMNS)
    return docs.select(id_col, text_col).mapInArrow(apply, f"`{id_col}` {kind}, {counts}, base_failed boolean, kept boolean")
