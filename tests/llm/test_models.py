import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, empty, frame, lower, words
from tideline.llm import hmm, toxicity, weak_labels


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2


def test_base_scores_and_counts(spark):
    rows = corpus()
    tokens = {i: words(lower(t)) + [None] for i, t, _ in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for known in (20, 200_000):  # few known words send most through the join
        got = hmm.score_documents(frame(spark, rows), held_out(), emitted=16, max_known=known).collect()
        assert len(got) == len(rows)
        for r in got:
            ws = tokens[r.doc_id]
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
            assert math.isclose(r.base_score, base, rel_tol=1e-9)
            assert math.isfinite(r.score) and r.score < 0


def test_nothing_to_learn_from(spark):
    assert hmm.score_documents(empty(spark), held_out()).collect() == []
    got = hmm.score_documents(frame(spark, [(1, "a b", "s")]), F.lit(True)).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and math.isfinite(got.score)


def random_model(states, symbols, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Hmm(norm(rng.random(states)), norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, symbols))).T)


def test_forward_sums_over_all_paths_and_all_texts():
    from itertools import product

    m = random_model(3, 4)
    seqs = [np.array(s, "<u2") for s in product(range(4), repeat=4)]
    got = hmm.log10_likelihood(seqs, m)
    for s, g in zip(seqs[:20], got):
        p = sum(
            m.start[path[0]] * m.emit[s[0], path[0]] * np.prod([m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]] for t in range(1, 4)])
            for path in product(range(3), repeat=4)
        )
        assert math.isclose(10**g, p, rel_tol=1e-9)
    assert math.isclose((10**got).sum(), 1, rel_tol=1e-9)


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(2)
    seqs = [np.array(rng.integers(0, 3, n) + 3 * (i % 2), "<u2") for i, n in enumerate(rng.integers(1, 40, 60))]
    m, last = random_model(2, 6), -np.inf
    for _ in range(8):
        now = hmm.log10_likelihood(seqs, m).sum()
        assert now > last - 0.5
        counts = hmm.Counts.zero(2, 6)
        hmm.expected_counts(seqs, m, counts)
        assert math.isclose(counts.emit.sum(), sum(map(len, seqs)), rel_tol=1e-4)
        m, last = counts.model(), now
    assert last > hmm.log10_likelihood(seqs, random_model(2, 6)).sum()


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    x = rng.random(500)
    y = (rng.random(500) < x).astype(float)
    at, p = toxicity.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all()


def toxic_corpus(n=700):
    rows, labels = [], []
    for i, (_, t, s) in enumerate(corpus(k)[j] for k in range(60) for j in range(40)):
        if i >= n:
            break
        bad = i % 4 == 0
        rows.append((i, f"{t or ''} you are {'rotten zork' if bad else 'a fine fellow'} {i}" if i % 50 else t, s))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    table = spark.createDataFrame(labels + [(5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(frame(spark, rows), table).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    truth = {i: y for i, _, y in labels}
    test = got[got.held_out & (got.doc_id % 50 != 0)]
    assert (test.predicted == test.doc_id.map(truth)).mean() > 0.97
    # A held-out label never counts.
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    again = toxicity.classify(frame(spark, rows), spark.createDataFrame(flipped, table.schema)).toPandas()
    both = got.merge(again, on="doc_id")
    assert np.allclose(both.score_x, both.score_y)


def test_equal_scores_have_one_probability():
    at, p = toxicity.isotonic(np.repeat([0.0, 1.0], 100), np.repeat([0.0, 1.0, 0.0, 1.0], (95, 5, 80, 20)))
    assert at.tolist() == [0, 1] and np.allclose(p, (0.05, 0.2), atol=0.01)


def test_toxic_rate_is_that_of_all_labels(spark):
    """Every fifth document has a word with which one of five is toxic; the caps draw all toxic but
    a sixth of the clean labels."""
    rng = np.random.default_rng(4)
    rows = [(i, f"word{rng.integers(50)} {'zork' if i % 5 == 0 else 'fine'} word{rng.integers(50)} {i}", "s") for i in range(4000)]
    labels = [(i, 1, int(i % 5 == 0 and rng.random() < 0.2)) for i in range(4000)]
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for caps in ((8000, 16000), (200, 640)):
        model = toxicity.fit(docs, table, F.lit(True), max_toxic=caps[0], max_clean=caps[1])
        got = toxicity.score(docs, model).toPandas()
        assert 0.1 < got.score[got.doc_id % 5 == 0].mean() < 0.35
        assert (got.score >= 0.5).mean() < 0.01


def test_weights_count_as_repeated_rows():
    rng = np.random.default_rng(6)
    x, times = rng.random((300, 3)), rng.integers(1, 5, 300)
    y = (rng.random(300) < x[:, 0]).astype(float)
    again = np.repeat(np.arange(300), times)
    once, repeated = toxicity.isotonic(x[:, 0], y, times.astype(float)), toxicity.isotonic(x[again, 0], y[again])
    assert np.allclose(once, repeated)
    assert np.isclose(toxicity.boost(x, y, times.astype(float))[0], toxicity.boost(x[again], y[again])[0])


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(frame(spark, corpus()), none).collect()
    assert len(got) == len(corpus()) and all(r.predicted == 0 for r in got)
    assert toxicity.classify(empty(spark), none).collect() == []


def test_weak_labels_part_junk_from_prose(spark):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(r for k in range(8) for r in corpus(k) if len(words(r[1])) > 60 and "again" not in r[1])]
    n = len(rows)
    junk = [(n + i, " ".join(w + "***" for w in words(t)) if i % 2 else t.upper().replace(" ", "!! "), s) for i, (_, t, s) in enumerate(rows[: n // 4])]
    got = {r.doc_id: r for r in weak_labels.classify(frame(spark, rows + junk + [(-1, None, None)])).collect()}
    assert len(got) == n + len(junk) + 1
    assert sum(got[i].kept for i, _, _ in junk) <= 0.1 * len(junk)
    lower_case = [i for i, t, _ in rows if t == t.lower()]
    assert sum(got[i].kept for i in lower_case) >= 0.9 * len(lower_case)
    assert weak_labels.classify(empty(spark)).collect() == []


def test_weak_labels_against_brute_force(spark):
    """Votes, posteriors and weights from plain counts over all texts."""
    from collections import defaultdict

    from tideline.llm import weak_labels as W
    from tideline.llm.text import chunks as cut

    rows = corpus(11)
    got = {r.doc_id: r for r in W.classify(frame(spark, rows)).collect()}
    assert set(got) == {i for i, _, _ in rows}
    pattern, feats = {}, {}
    for i, t, _ in rows:
        for _, _, chunk in cut(pa.array([t or ""], pa.string())):
            pattern[i] = int(W.patterns(chunk)[0])
            feats[i] = W.features(chunk)[0].tolist()
    values, counts = np.unique(list(pattern.values()), return_counts=True)
    post = dict(zip(values.tolist(), W.expectation_maximisation(values, counts)[0].tolist()))
    good, bad, g, b = defaultdict(float), defaultdict(float), 1.0, 1.0
    for i, p in pattern.items():
        g, b = g + post[p], b + 1 - post[p]
        for f in feats[i]:
            good[f] += post[p] / len(feats[i])
            bad[f] += (1 - post[p]) / len(feats[i])
    weight = {f: min(5, max(-5, np.log((good[f] + W.SMOOTH) / g) - np.log((bad[f] + W.SMOOTH) / b))) for f in good}
    mean = {i: sum(weight[f] for f in fs) / max(1, len(fs)) for i, fs in feats.items()}
    assert all(abs(got[i].posterior - post[pattern[i]]) < 1e-9 for i in mean)
    # The score is one logistic curve of the mean weight, the same for every text.
    order = sorted(mean, key=mean.get)
    odds = [np.log(got[i].score / (1 - got[i].score)) for i in order]
    slope = (odds[-1] - odds[0]) / (mean[order[-1]] - mean[order[0]])
    assert all(abs(o - odds[0] - slope * (mean[i] - mean[order[0]])) < 1e-6 for i, o in zip(order, odds))
    assert all(got[i].kept == (got[i].score >= 0.5) for i in mean)


def test_votes_of_plain_cases():
    from tideline.llm import weak_labels as W
    from tideline.llm.text import chunks as cut

    def votes(text):
        for _, _, chunk in cut(pa.array([text])):
            p = int(W.patterns(chunk)[0])
        k = len(W.LABELLERS)
        return dict(zip(W.LABELLERS, [p // 3 ** (k - 1 - i) % 3 for i in range(k)]))

    plain = votes(" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)))
    assert plain["length"] == 2 and plain["echoes"] == 2 and plain["fresh_words"] == 2 and plain["symbols"] == 2
    assert votes("a b c")["length"] == 0
    assert votes("SHOUT " * 30)["capitals"] == 0 and votes("again " * 60)["echoes"] == 0 and votes("again " * 60)["fresh_words"] == 0
    assert set(votes("").values()) == {1, 0} and votes("")["length"] == 0
