"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the
counts of vote patterns (at most 3 to the power of the labellers, whatever the corpus) estimates
each labeller's accuracy and the posterior of every pattern. Posteriors are the labels of a hashed
linear scorer over words and word shapes: weights are the smoothed log odds of a feature's share of
good and of bad texts, summed over all documents, and a logistic curve fitted to the binned sums
turns a text's mean weight into a probability.

Defined cases: a null or empty text has no feature and no vote but that of the word count; rows
with equal ids are scored separately; an empty table gives an empty result; other columns are
ignored; no true label is ever read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.quality_rules import Measures
from tideline.llm.scratch import keep, release, share, shared
from tideline.llm.text import LETTER, UPPER, Chunk, _mask, chunks, mix, repeated, row_key

BUCKETS, BINS = 1 << 18, 200
SMOOTH = 0.2  # in texts that consist of the feature alone
PRIOR_SHARE, PRIOR_VOTES = 0.2, np.array([[0.35, 0.25, 0.4], [0.002, 0.2, 0.798]])  # bad, nothing, good
_U = np.uint64
_DIGIT = _mask((48, 57))


def _votes(value: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 2, 1))


def _share(m: Measures) -> np.ndarray:
    return np.maximum(m.n_words, 1)


def _fresh_words(m: Measures) -> np.ndarray:
    """Distinct words over words."""
    h = m.chunk.span_hash(m.prefix, m.words.start, m.words.end)
    _, later = repeated(row_key(h, m.words.row))
    return 1 - np.bincount(m.words.row[later], minlength=m.chunk.rows) / _share(m)


def _echoes(m: Measures) -> np.ndarray:
    """Share of the words that repeat the word before."""
    h, row = m.chunk.span_hash(m.prefix, m.words.start, m.words.end), m.words.row
    same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    return np.bincount(row[same], minlength=m.chunk.rows) / _share(m)


def _word_share(m: Measures, holds) -> np.ndarray:
    """Share of the words for which ``holds(bytes of letters, bytes)``."""
    letters = np.concatenate(([0], np.cumsum(LETTER[m.chunk.raw])))
    at = holds(letters[m.words.end] - letters[m.words.start], m.words.end - m.words.start)
    return np.bincount(m.words.row[at], minlength=m.chunk.rows) / _share(m)


#: name -> measure, bad where it holds, good where it holds
LABELLERS = {
    "length": (lambda m: m.n_words, lambda v: v < 5, lambda v: v >= 50),
    "symbols": (lambda m: m.n_symbols / _share(m), lambda v: v > 0.1, lambda v: v < 0.02),
    "capitals": (lambda m: m.capitals / np.maximum(m.letters, 1), lambda v: v > 0.3, lambda v: v < 0.15),
    "repeats": (lambda m: m.n_repeat_words / _share(m), lambda v: v > 0.3, lambda v: v < 0.05),
    "lines": (lambda m: m.n_dup_lines / np.maximum(m.n_lines, 1), lambda v: v > 0.3, lambda v: v < 0.05),
    "word_length": (lambda m: m.word_chars / _share(m), lambda v: (v < 2.5) | (v > 11), lambda v: (v > 3.5) & (v < 8)),
    "exclaims": (lambda m: m.exclaims / _share(m), lambda v: v > 0.1, lambda v: v < 0.02),
    "letters": (lambda m: m.letters / np.maximum(m.word_chars, 1), lambda v: v < 0.85, lambda v: v > 0.93),
    "bare_words": (lambda m: _word_share(m, lambda letters, size: letters == 0), lambda v: v > 0.1, lambda v: v < 0.03),
    "marked_words": (lambda m: _word_share(m, lambda letters, size: letters < size), lambda v: v > 0.5, lambda v: v < 0.35),
    "echoes": (_echoes, lambda v: v > 0.2, lambda v: v < 0.05),
    "fresh_words": (_fresh_words, lambda v: v < 0.25, lambda v: v > 0.4),
}


def patterns(chunk: Chunk) -> np.ndarray:
    """The votes of all labellers as one number, three values each."""
    m, out = Measures(chunk), np.zeros(chunk.rows, np.int64)
    for measure, bad, good in LABELLERS.values():
        v = np.asarray(measure(m), float)
        vote = np.where(m.n_words == 0, 1, _votes(v, bad(v), good(v)))
        if measure is LABELLERS["length"][0]:
            vote = _votes(v, bad(v), good(v))
        out = out * 3 + vote
    return out


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, vote probabilities [class, labeller, vote], prior).

    A vote of nothing is an outcome like the others. Accuracies have a prior, with the weight of
    PRIOR_SHARE of all texts: a labeller seldom calls a good text bad, and sees some kinds of bad
    text only. It tells the classes apart where the votes alone would not.
    """
    k = len(LABELLERS)
    votes = np.stack([pattern // 3 ** (k - 1 - i) % 3 for i in range(k)], 1) if len(pattern) else np.zeros((0, k), np.int64)
    post = np.clip(0.5 + (votes.astype(float) - 1).mean(1), 0.05, 0.95) if len(pattern) else np.zeros(0)
    post[(votes == 0).any(1)] = 0.05
    table, prior = np.full((2, k, 3), 1 / 3), 0.5
    for _ in range(rounds):
        prior = (float((post * count).sum()) + 1) / (float(count.sum()) + 2)
        for c, weight in ((1, post * count), (0, (1 - post) * count)):
            for i in range(k):
                table[c, i] = np.bincount(votes[:, i], weight, 3) + 1.0 + PRIOR_SHARE * count.sum() * PRIOR_VOTES[c]
            table[c] /= table[c].sum(1, keepdims=True)
        log = [np.log(table[c][np.arange(k), votes]).sum(1) for c in (0, 1)]
        odds = np.log(prior / (1 - prior)) + log[1] - log[0]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, table, prior


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of three features of each word: the word as it stands, its shape, and whether
    it repeats the word before."""
    spans, raw = chunk.words(), chunk.raw
    h = chunk.span_hash(chunk.prefix_hash(raw), spans.start, spans.end)
    size = spans.end - spans.start
    inside = lambda table: (lambda c: c[spans.end] - c[spans.start])(np.concatenate(([0], np.cumsum(table[raw]))))
    upper, letter, digit = inside(UPPER), inside(LETTER), inside(_DIGIT)
    shape = np.minimum(size, 15) + 16 * ((upper > 1).astype(np.int64) + 2 * (upper == letter) + 4 * (digit > 0) + 8 * np.minimum(size - letter, 3))
    last = raw[spans.end - 1].astype(np.int64) if len(spans) else np.zeros(0, np.int64)
    s = mix((shape * 256 + last).astype(_U) + _U(0x51A9E000000))
    echo = np.zeros(len(h), _U)
    echo[1:] = (h[1:] == h[:-1]) & (spans.row[1:] == spans.row[:-1])
    key = np.concatenate((h, s, mix(echo + _U(0xEC40000000))))
    return (mix(key) & _U(BUCKETS - 1)).astype(np.int64), np.tile(spans.row, 3)


def weighed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pattern, n (features of the text), buckets (distinct, rising) and how often each occurs.
    All that is ever read from a text; later passes go over this table."""
    kind = dict(docs.dtypes)[id_col]

    def apply(batches):
        for batch in batches:
            for lo, hi, chunk in chunks(batch.column(1)):
                bucket, row = features(chunk)
                key, times = np.unique(row * BUCKETS + bucket, return_counts=True)
                border = np.searchsorted(key, np.arange(chunk.rows + 1) * BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(patterns(chunk)), pa.array(np.bincount(row, minlength=chunk.rows)),
                        _cut((key & (BUCKETS - 1)).astype("<u4"), border), _cut(times.astype("<u2" if times.max(initial=0) < 1 << 16 else "<u4"), border),
                    ],
                    ["id", "pattern", "n", "buckets", "times"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(apply, f"id {kind}, pattern long, n long, buckets binary, times binary")


def _cut(values: np.ndarray, border: np.ndarray) -> pa.Array:
    ends = pa.py_buffer((border * values.itemsize).astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(border) - 1, [None, ends, pa.py_buffer(values)]).cast(pa.binary())


def _counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pattern and n of each row; bucket, times and row of each of their features."""
    pattern, n = (batch.column(c).to_numpy() for c in ("pattern", "n"))
    buckets = [np.frombuffer(b, "<u4") for b in batch.column("buckets").to_pylist()]
    times = [np.frombuffer(t, "<u2" if len(t) * 2 == 4 * len(b) else "<u4") for t, b in zip(batch.column("times").to_pylist(), buckets)]
    row = np.repeat(np.arange(len(n)), [len(b) for b in buckets])
    empty = np.zeros(0, np.int64)
    return pattern, n, np.concatenate([empty, *buckets]).astype(np.int64), np.concatenate([empty, *times]).astype(np.int64), row


def _feature_counts(batches, sent):
    post = shared(sent)
    good, bad, sums = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(2)
    for batch in batches:
        pattern, n, bucket, times, row = _counted(batch)
        p = post[pattern]
        part = times / np.maximum(n, 1)[row]
        good += np.bincount(bucket, p[row] * part, BUCKETS)
        bad += np.bincount(bucket, (1 - p)[row] * part, BUCKETS)
        sums += (p.sum(), (1 - p).sum())
    some = np.flatnonzero(good + bad)
    yield pa.RecordBatch.from_pydict({"bucket": np.append(some, -1), "good": np.append(good[some], sums[0]), "bad": np.append(bad[some], sums[1])})


def _mean_weight(n: np.ndarray, bucket: np.ndarray, times: np.ndarray, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.bincount(row, weight[bucket] * times, len(n)) / np.maximum(n, 1)


def _binned(batches, sent):
    post, weight = shared(sent)
    out = np.zeros((BINS, 2))
    for batch in batches:
        pattern, *counted = _counted(batch)
        at = np.clip(((_mean_weight(*counted, weight) + 5) * (BINS / 10)).astype(int), 0, BINS - 1)
        out[:, 0] += np.bincount(at, post[pattern], BINS)
        out[:, 1] += np.bincount(at, minlength=BINS)
    some = np.flatnonzero(out[:, 1])
    yield pa.RecordBatch.from_pydict({"bin": some, "good": out[some, 0], "n": out[some, 1]})


def logistic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method on binned data, lightly held towards (1, 0)."""
    w = np.array([1.0, 0.0])
    scale = max(1.0, n.sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        g = np.array([((p * n - good) * x).sum(), (p * n - good).sum()]) / scale + 1e-3 * (w - (1, 0))
        v = n * p * (1 - p) / scale
        h = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(w[0]), float(w[1])


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, posterior (of the labellers), score (of the linear scorer, 0 to 1) and kept (score >= 0.5).

    Texts are read once, into a table of vote patterns and counted features. To the driver come
    one row for each vote pattern, hashed feature and bin, numbers that no corpus exceeds.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = keep(weighed(docs, id_col, text_col), "weak-labels")
    counts = rows.groupBy("pattern").agg(F.count("*").alias("n")).toArrow()
    pattern, n = counts["pattern"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(pattern)
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    posterior[pattern[order]] = expectation_maximisation(pattern[order], n[order])[0]
    sent = share(spark, posterior)
    sums = (
        rows.drop("id").mapInArrow(lambda b: _feature_counts(b, sent), "bucket long, good double, bad double")
        .groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    )
    release([sent])
    bucket, good, bad = (sums[c].to_numpy() for c in ("bucket", "good", "bad"))
    whole = bucket < 0
    g, b = (float(x[whole].sum()) + 1.0 for x in (good, bad))
    weight = np.zeros(BUCKETS)
    weight[bucket[~whole]] = np.clip(np.log((good[~whole] + SMOOTH) / g) - np.log((bad[~whole] + SMOOTH) / b), -5, 5)
    both = share(spark, (posterior, weight))
    bins = (
        rows.drop("id").mapInArrow(lambda x: _binned(x, both), "bin long, good double, n double")
        .groupBy("bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toArrow()
    )
    centre = (bins["bin"].to_numpy() + 0.5) * (10 / BINS) - 5
    slope, shift = logistic(centre, bins["good"].to_numpy(), bins["n"].to_numpy()) if len(bins) else (1.0, 0.0)

    def score(batches):
        post, weights = shared(both)
        for batch in batches:
            pattern, *counted = _counted(batch)
            s = 1 / (1 + np.exp(-np.clip(slope * _mean_weight(*counted, weights) + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(post[pattern]), pa.array(s), pa.array(s >= 0.5)], ["id", "posterior", "score", "kept"])

    return rows.mapInArrow(score, f"id {kind}, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)
