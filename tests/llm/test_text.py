import pyarrow as pa
import numpy as np
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import shingle_set, words
from tideline.llm.text import LOWER, Chunk, chunks, repeated, shingles

TEXTS = st.lists(st.one_of(st.none(), st.text("ab É\n\t \x1f日", max_size=30)), max_size=8)


def as_text(chunk, spans, i):
    return bytes(chunk.raw[spans.start[i] : spans.end[i]]).decode()


@given(TEXTS, st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_words_and_lines_are_those_of_the_text(texts, limit):
    got_words, got_lines, rows = [], [], 0
    for lo, hi, chunk in chunks(pa.array(texts, pa.string()), limit):
        w, ln = chunk.words(), chunk.lines()
        for r in range(chunk.rows):
            got_words.append([as_text(chunk, w, i) for i in range(w.first[r], w.first[r + 1])])
            got_lines.append([as_text(chunk, ln, i) for i in range(ln.first[r], ln.first[r + 1])])
        rows += hi - lo
    assert rows == len(texts)
    assert got_words == [words(t) for t in texts]
    assert got_lines == [(t or "").split("\n") for t in texts]


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_shingles_tell_sets_apart(texts):
    for _, _, chunk in chunks(pa.array(texts, pa.string()), 1000):
        spans, raw = chunk.words(), LOWER[chunk.raw]
        h = Chunk.span_hash(chunk.prefix_hash(raw), spans.start, spans.end)
        s, row = shingles(h, spans, 5)
        got = [frozenset(s[row == r].tolist()) for r in range(chunk.rows)]
        want = [shingle_set(t) for t in texts]
        for i, a in enumerate(want):
            assert len(got[i]) == len(a)
            for j, b in enumerate(want):
                assert len(got[i] & got[j]) == len(a & b)


def test_repeated():
    many, later = repeated(np.array([5, 3, 5, 9, 5], np.uint64))
    assert many.tolist() == [True, False, True, False, True]
    assert later.tolist() == [False, False, True, False, True]
