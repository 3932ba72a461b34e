"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned lexicon (words, and stems of four to six bytes,
read through common digit-for-letter spellings), how near lexicon words stand to second-person
words, rates of capitals, punctuation, exclamation marks, obfuscated words and stretched letters.

Fitting takes at most ``max_toxic`` and ``max_clean`` labelled rows, chosen by a hash of the id:
half of them give the lexicon, a quarter the trees, a quarter the calibration. In the trees and the
calibration a row weighs as many labels of its class as it stands for, so scores follow the rate
among all labels. Scoring covers every document and needs no shuffle.

Defined cases: a null or empty text scores like any text without words; a null label is no label;
of several labels for one id the larger counts; with no label of one class the score is that of
the prior (0 without any label).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.text import CONTINUATION, LETTER, UPPER, Chunk, _mask, chunks, mix

MAX_TOXIC, MAX_CLEAN, MAX_LEXICON = 8_000, 16_000, 20_000
STEMS = (4, 5, 6)
SECOND_PERSON = (
    "you your yours yourself u ur tu te ti tus tuyo usted ustedes vosotros du dich dir dein deine "
    "deinen ihr euch sie toi ton tes vous votre vos"
).split()

_DIGIT = _mask((48, 57))
#: Letters, digits and marks that stand for letters count as parts of a word.
_PART = LETTER | _DIGIT | np.isin(np.arange(256), np.frombuffer(b"@$", np.uint8))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _a, _b in zip(b"013457@$", b"oieastas"):
    _FOLD[_a] = _b
_PUNCT = _mask((33, 47), (58, 64), (91, 96), (123, 126))


def _word_keys(chunk: Chunk):
    """Words of letters as spans, the prefix hash of their folded bytes, and the word hashes."""
    spans = chunk.runs(_PART[chunk.raw])
    folded = _FOLD[chunk.raw]
    prefix = chunk.prefix_hash(folded)
    return spans, prefix, chunk.span_hash(prefix, spans.start, spans.end)


def _stem_keys(spans, prefix, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of the first ``size`` bytes of longer words."""
    at = np.flatnonzero(spans.end - spans.start > size)
    start = spans.start[at]
    return mix(Chunk.span_hash(prefix, start, start + size) + np.uint64(size)), at


def _second_person_keys() -> np.ndarray:
    raw = np.frombuffer(" ".join(SECOND_PERSON).encode(), np.uint8)
    chunk = Chunk(raw, np.array([0, len(raw)]))
    return np.sort(_word_keys(chunk)[2])


class Lookup:
    """Weights by hash; a bitmap answers for most words that are not in the table."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(keys >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        if not len(self.keys):
            return out
        maybe = np.flatnonzero(self.bitmap[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        same = self.keys[at] == h[maybe]
        out[maybe[same]] = self.weights[at[same]]
        return out


STRONG = 3.0
FEATURES = (
    "log_words", "strong_density", "weak_density", "weight_density", "strong_hits", "top_weight",
    "stem_density", "stem_hits", "you_density", "near_you", "capitals", "punctuation", "exclaims",
    "obfuscated", "stretched", "word_length",
)


def features(chunk: Chunk, lexicon: Lookup, you: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each row of the chunk."""
    n, raw = chunk.rows, chunk.raw
    spans, prefix, h = _word_keys(chunk)
    row = spans.row
    words = np.maximum(spans.count, 1)
    total = lambda w, at=row: np.bincount(at, weights=w, minlength=n)
    weight = lexicon(h)
    stem_weight = np.zeros(len(h))
    for size in STEMS:
        keys, at = _stem_keys(spans, prefix, size)
        np.maximum.at(stem_weight, at, lexicon(keys))
    either = np.maximum(weight, stem_weight)
    strong = weight >= STRONG
    top = np.zeros(n)
    np.maximum.at(top, row, either)
    is_you = np.isin(h, you)
    hit = np.flatnonzero(either >= STRONG)
    near = np.zeros(n)
    if len(hit) and is_you.any():
        place = np.flatnonzero(is_you)
        after = np.searchsorted(place, hit)
        for side in (after - 1, after):
            ok = (side >= 0) & (side < len(place))
            other = place[np.clip(side, 0, len(place) - 1)]
            ok &= (row[other] == row[hit]) & (np.abs(other - hit) <= 6)
            near += np.bincount(row[hit[ok]], minlength=n)
    digits = np.concatenate(([0], np.cumsum(_PART[raw] & ~LETTER[raw])))
    odd = digits[spans.end] - digits[spans.start]
    mixed = (odd > 0) & (odd < spans.end - spans.start)
    triple = np.zeros(len(raw), bool)
    if len(raw) > 2:
        folded = _FOLD[raw]
        triple[2:] = (folded[2:] == folded[1:-1]) & (folded[1:-1] == folded[:-2]) & LETTER[raw[2:]]
    letters = np.maximum(chunk.per_row(LETTER[raw] & ~CONTINUATION[raw]), 1)
    chars = np.maximum(np.diff(chunk.off), 1)
    return np.column_stack((
        np.log1p(spans.count), total(strong) / words, total((weight > 0) & ~strong) / words,
        total(weight) / words, total(strong), top, total(stem_weight >= STRONG) / words,
        total(stem_weight >= STRONG), total(is_you) / words, near, chunk.per_row(UPPER[raw]) / letters,
        chunk.per_row(_PUNCT[raw]) / chars, chunk.per_row(raw == 33) / words, total(mixed) / words,
        chunk.per_row(triple) / words, letters / words,
    ))


# ---- trees -----------------------------------------------------------------------------------


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(len(self.leaf)))
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.leaf[node - (len(self.leaf) - 1)]


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, rate: float) -> Tree:
    """A tree of fixed depth by second-order gain over histograms."""
    inner = (1 << depth) - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(grad), np.int64)
    for level in range(depth):
        for k in range((1 << level) - 1, (2 << level) - 1):
            at = np.flatnonzero(node == k)
            best = 1e-6
            for f, e in enumerate(edges):
                if not len(e) or len(at) < 2:
                    continue
                g = np.bincount(binned[at, f], grad[at], len(e) + 1).cumsum()
                h = np.bincount(binned[at, f], hess[at], len(e) + 1).cumsum()
                gl, hl, gr, hr = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g[-1] ** 2 / (h[-1] + 1)
                gain[(hl < 1e-3) | (hr < 1e-3)] = 0
                i = int(gain.argmax())
                if gain[i] > best:
                    best, feature[k], cut[k] = gain[i], f, e[i]
                    right = binned[at, f] > i
            go = np.zeros(len(at), np.int64)
            if np.isfinite(cut[k]):
                go = right.astype(np.int64)
            node[at] = 2 * k + 1 + go
    leaf = node - inner
    g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
    return Tree(feature, cut, -rate * g / (h + 1))


def _log_odds(y: np.ndarray, weight: np.ndarray) -> float:
    return float(np.log(((y * weight).sum() + 0.5) / (((1 - y) * weight).sum() + 0.5)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48) -> tuple[float, list[Tree]]:
    """Prior log odds and trees for the logistic loss; without ``weight`` all rows weigh 1."""
    weight = np.ones(len(y)) if weight is None else weight
    prior = _log_odds(y, weight)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) if len(c) else c for c in x.T]
    # A cut at zero parts "none" from "some" even where almost all rows have none.
    edges = [np.unique(np.append(e, 0.0)) for e in edges]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    score, trees = np.full(len(y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(binned, edges, weight * (p - y), weight * p * (1 - p), depth, rate)
        trees.append(tree)
        score += tree(x)
    return prior, trees


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, probabilities) of the blocks, for linear interpolation."""
    weight = np.ones(len(y)) if weight is None else weight
    # Equal scores are one row: else their labels, in order, would make blocks of their own.
    at, row = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # sum of labels, weight, sum of scores
    for s, v, w in zip(at, np.bincount(row, y * weight), np.bincount(row, weight)):
        blocks.append([v, w, s * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    rate = (y * weight).sum() / weight.sum()
    # Small blocks are drawn towards the mean, which must not turn the order round.
    return b[:, 2] / b[:, 1], np.maximum.accumulate((b[:, 0] + 0.5 * rate) / (b[:, 1] + 0.5))


@dataclass
class Model:
    lexicon: Lookup
    you: np.ndarray
    prior: float
    trees: list[Tree] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, chunk: Chunk) -> np.ndarray:
        x = features(chunk, self.lexicon, self.you)
        return self.prior + sum((t(x) for t in self.trees), np.zeros(len(x)))

    def score(self, chunk: Chunk) -> np.ndarray:
        raw = self.raw(chunk)
        plain = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        if self.knots is None:
            return plain
        # A small share of the raw score keeps the order within a flat block.
        return 0.98 * np.interp(raw, *self.knots) + 0.02 * plain


# ---- fitting and scoring on Spark ---------------------------------------------------------------


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def training_sample(labels: DataFrame, usable: Column, id_col: str = "doc_id", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[DataFrame, dict[int, int]]:
    """At most ``max_toxic + max_clean`` labelled ids with ``label`` and ``part`` (0 to 3), and the
    number of labels of each class that they are drawn from."""
    rows = (
        labels.where(usable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .withColumn("draw", F.xxhash64("id", F.lit(7)))
    )
    have = {r["label"]: r["n"] for r in rows.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}

    def pick(label: int, n: int) -> DataFrame:
        # Thinned by the hash first, so that partitions do not each send a whole sample to one task.
        part = F.pmod("draw", F.lit(max(1, have.get(label, 0) // max(1, n)))) == 0
        return rows.where((F.col("label") == label) & part).orderBy("draw", "id").limit(n)

    picked = [pick(1, max_toxic), pick(0, max_clean)]
    return picked[0].unionByName(picked[1]).select("id", "label", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(4)).alias("part")), have


def _count_keys(batches):
    """(key, toxic documents, clean documents) of words and stems."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, chunk in chunks(batch.column(2)):
            spans, prefix, h = _word_keys(chunk)
            keys, rows = [h], [spans.row]
            for size in STEMS:
                k, at = _stem_keys(spans, prefix, size)
                keys.append(k)
                rows.append(spans.row[at])
            k, r = np.concatenate(keys), np.concatenate(rows)
            order = np.lexsort((r, k))
            k, r = k[order], r[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
            k, toxic = k[new], label[lo:hi][r[new]] == 1
            u, inverse = np.unique(k, return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "key": u.view(np.int64), "a": np.bincount(inverse, toxic, len(u)).astype(np.int64),
                "b": np.bincount(inverse, ~toxic, len(u)).astype(np.int64),
            })


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on the bounded sample of ``labels`` rows where ``usable`` holds.

    The sample's ids are broadcast: their number is bounded by the two parameters. To the driver
    come at most MAX_LEXICON lexicon entries and one dense row for each sampled document.
    """
    sample, have = training_sample(labels, usable, id_col, label_col, max_toxic, max_clean)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    n = {r["label"]: (r["n"], r["all"]) for r in sample.groupBy("label").agg(F.count_if(F.col("part") < 2).alias("n"), F.count("*").alias("all")).collect()}
    toxic, clean = n.get(1, (0,))[0] + 1.0, n.get(0, (0,))[0] + 1.0
    # How many labels of its class a sampled row stands for, in units of their mean.
    mean = sum(have.get(k, 0) for k in n) / max(1, sum(v[1] for v in n.values()))
    stands_for = np.array([have[k] / n[k][1] / mean if k in n else 1.0 for k in (0, 1)])
    odds = F.log((F.col("a") + 0.5) / toxic) - F.log((F.col("b") + 0.5) / clean)
    counted = (
        texts.where("part < 2").select("id", "label", "text").mapInArrow(_count_keys, "key long, a long, b long")
        .groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 2")
        .select("key", odds.alias("odds"), (odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))).alias("z"))
        .where("odds > 1.5 and z > 1.6").orderBy(F.desc("z"), "key").limit(MAX_LEXICON).toPandas()
    )
    keys = counted["key"].to_numpy(np.int64).view(np.uint64)
    model = Model(Lookup(keys, counted["z"].to_numpy(float)), _second_person_keys(), 0.0)

    def dense(batches):
        for batch in batches:
            for lo, hi, chunk in chunks(batch.column(2)):
                x = features(chunk, model.lexicon, model.you)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))],
                    ["label", "part", "x"],
                )

    rows = texts.where("part >= 2").select("label", "part", "text").mapInArrow(dense, "label int, part long, x array<double>").toPandas()
    if not len(rows):
        model.prior = -40.0 if clean * stands_for[0] >= toxic * stands_for[1] else 40.0
        return model
    x, y, part = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(float), rows["part"].to_numpy()
    order = np.lexsort((*x.T, y, part))  # the same trees whatever order the rows came in
    x, y, part = x[order], y[order], part[order]
    grow, weight = part == 2, stands_for[y.astype(int)]
    model.prior, model.trees = boost(x[grow], y[grow], weight[grow]) if grow.any() else (_log_odds(y, weight), [])
    if (~grow).sum() >= 2 and 0 < y[~grow].sum() < (~grow).sum():
        raw = model.prior + sum((t(x[~grow]) for t in model.trees), np.zeros(int((~grow).sum())))
        model.knots = isotonic(raw, y[~grow], weight[~grow])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``, which replaces one of that name."""
    names = [c for c in docs.columns if c != out]
    at = names.index(text_col)

    def apply(batches):
        for batch in batches:
            for lo, hi, chunk in chunks(batch.column(at)):
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(model.score(chunk))], [*names, out]
                )

    schema = docs.select(*names).withColumn(out, F.lit(0.0)).schema
    return docs.select(*names).mapInArrow(apply, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """id, held_out (never learned from), score and predicted of every document."""
    held_out = F.coalesce(fold(id_col, folds) == 0, F.lit(True))
    model = fit(docs, labels, ~held_out, id_col, text_col)
    return score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select(
        F.col("id").alias(id_col), F.coalesce(fold("id", folds) == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
