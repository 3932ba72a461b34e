import random

import pytest

from tests.llm.helpers import corpus, empty, frame, lower, shingle_set, words
from tideline.llm import line_dedup, minhash
from tideline.llm.components import components


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rounds, block", [(0, 128), (2, 4)])
def test_components_equal_brute_force(spark, monkeypatch, rounds, block):
    """With no pairs verified at once, so that rounds and blocks have to find every link."""
    monkeypatch.setattr(minhash, "_few_pairs", lambda members: False)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    got = minhash.near_duplicates(frame(spark, rows), rounds=rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_family_whose_centre_links_few(spark):
    """Copies that each depart from one base: the smallest id is far from most of the others."""
    rng_words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(rng_words)
        for k in range(5 if i < 4 else i % 3):
            w[(i * 13 + k * 23) % 120] = f"x{i}_{k}"
        rows.append((i, " ".join(w), "s"))
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_equal_ids_are_rows_of_their_own(spark):
    rows = [(7, "a b c d e f g", "s"), (7, "q r s t u v w", "s"), (3, "a b c d e f g", "s")]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(3, 3), (7, 3), (7, 7)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in range(101, 140)}}


def brute_lines(rows):
    seen, gone = [], {}
    for i, t, _ in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = words(lower(line))
            if len(w) < 5:
                continue
            s = set(w)
            if any(100 * len(s & o) >= 75 * len(s | o) for o in seen):
                gone.setdefault(i, []).append(k)
            seen.append(s)
    return gone


@pytest.mark.parametrize("near, given", [(4096, 8), (2, 1)])
def test_lines_equal_brute_force(spark, monkeypatch, near, given):
    monkeypatch.setattr(line_dedup, "NEAR", near)
    monkeypatch.setattr(line_dedup, "GIVEN", given)
    rows = corpus()
    want = brute_lines(rows)
    got = {r.doc_id: r.removed for r in line_dedup.decisions(frame(spark, rows)).collect()}
    assert got == {i: want.get(i, []) for i, _, _ in rows}
    texts = {r.doc_id: r.text for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        left = t if i not in want else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
        assert texts[i] == left


def test_lines_like_a_removed_one_inside_a_document(spark, monkeypatch):
    """Line 0 removes line 1, which alone removes the others; ids are stored in falling order."""
    monkeypatch.setattr(line_dedup, "GIVEN", 1)
    rows = []
    for g in range(20):
        base = [f"g{g}w{i}" for i in range(16)]
        others = [" ".join(base[: 2 * k] + [f"g{g}x{k}", f"g{g}y{k}"] + base[2 * k + 2 :]) for k in range(8)]
        rows.append((2 * g + 1, "\n".join([others[0], " ".join(base), *others[1:]]), "s"))
        if g % 2:  # stored later, ordered earlier
            rows.append((2 * g, "\n".join(["two words", others[3], " ".join(reversed(base))]), "s"))
    want = brute_lines(rows)
    docs = frame(spark, rows, 1).sortWithinPartitions("doc_id", ascending=False)
    got = {r.doc_id: r.removed for r in line_dedup.decisions(docs).collect()}
    assert got == {i: want.get(i, []) for i, _, _ in rows} and want[1] == list(range(1, 9))


def test_lines_of_nothing(spark):
    assert line_dedup.decisions(empty(spark)).collect() == []
    assert line_dedup.deduplicated(empty(spark)).columns == empty(spark).columns


@pytest.mark.parametrize("rounds, place", [(1, 1), (3, line_dedup.PLACE)])
def test_lines_in_rounds_and_past_the_last_place(spark, monkeypatch, rounds, place):
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(line_dedup, "PLACE", place)
    monkeypatch.setattr(line_dedup, "NEAR", 2)
    rows = corpus()
    want = brute_lines(rows)
    got = {r.doc_id: r.removed for r in line_dedup.decisions(frame(spark, rows)).collect()}
    assert got == {i: want.get(i, []) for i, _, _ in rows}


def test_lines_leave_no_shuffle_of_their_prefixes_and_shuffle_no_text(spark, monkeypatch):
    def on_disk():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    new, joined, keep, join = {}, [], line_dedup.keep, line_dedup._joined

    def kept(df, name, **how):
        before = on_disk()
        out = keep(df, name, **how)
        new[name] = new.get(name, set()) | (on_disk() - before)
        return out

    monkeypatch.setattr(line_dedup, "keep", kept)
    monkeypatch.setattr(line_dedup, "_joined", lambda docs, *rest: joined.append(docs.columns) or join(docs, *rest))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    assert any(r.n_removed for r in line_dedup.decisions(frame(spark, corpus())).collect())
    assert {"line-met", "line-pairs"} <= set(new) and not any(new.values())
    assert all("text" not in columns for columns in joined) and spark.conf.get(setting) == before


@pytest.mark.parametrize("held, bucket", [(1 << 19, 1 << 17), (40, 1 << 17), (40, 50)])
def test_lines_met_by_bytes_of_buckets(spark, monkeypatch, held, bucket):
    """Prefix rows are not made as rows of Spark; a bucket that is full lets rows of frequent words go."""
    monkeypatch.setattr(line_dedup, "HELD", held, raising=False)
    monkeypatch.setattr(line_dedup, "BUCKET", bucket, raising=False)
    monkeypatch.setattr(line_dedup, "GATHERED", 64, raising=False)
    monkeypatch.setattr(line_dedup, "NEAR", 3)
    monkeypatch.setattr(line_dedup, "GIVEN", 2)
    plans, keep = {}, line_dedup.keep
    monkeypatch.setattr(line_dedup, "keep", lambda df, name, **how: plans.setdefault(name, []).append(df._jdf.queryExecution().toString()) or keep(df, name, **how))
    rows = [r for r in corpus(5) if len(r[1] or "") < 4000]
    rng, common = random.Random(8), [f"c{i}" for i in range(9)]
    for i in range(60):  # families of lines of the same few words, later ids stored first
        rows.append((1000 - i, "\n".join(" ".join(rng.sample(common, rng.randint(5, 9))) for _ in range(4)), "s"))
    want = brute_lines(rows)
    got = {r.doc_id: r.removed for r in line_dedup.decisions(frame(spark, rows)).collect()}
    assert got == {i: want.get(i, []) for i, _, _ in rows}
    assert plans["line-met"] and not any("Generate" in plan for plan in plans["line-met"])


def test_bucket_marks_all_that_it_lets_go(monkeypatch):
    """Whatever the order rows come in, of any two classes of a word the pair is given or the later one marked."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "HELD", 30)
    monkeypatch.setattr(line_dedup, "NEAR", 4)
    monkeypatch.setattr(line_dedup, "GIVEN", 2)
    rng = random.Random(1)
    for _ in range(50):
        classes = {key: rng.randint(0, 50) for key in range(1, 41)}  # key: id of its first line
        lines = [(i, key) for key, i in classes.items()] + [(classes[k] + rng.randint(0, 9), k) for k in rng.choices(list(classes), k=30)]
        rng.shuffle(lines)
        ids, keys = (pa.array([x[k] for x in lines], pa.int64()) for k in (0, 1))
        rows = np.zeros((len(lines), line_dedup.ROW), np.uint64)
        rows[:, 0], rows[:, 1], rows[:, 2] = 7 << 16, keys.to_numpy(), 10
        border = list(range(0, len(lines), 7)) + [len(lines)]
        listed = pa.ListArray.from_arrays(pa.array(border, pa.int32()), ids)
        batch = pa.RecordBatch.from_arrays([pa.array([3] * (len(border) - 1), pa.int32()), listed, line_dedup._bytes(rows, line_dedup.ROW * np.array(border))], ["bucket", "ids", "rows"])
        out = [x for b in line_dedup._met_pairs([batch], 75) for x in b.to_pylist()]
        pairs, marked = {(x["a"], x["b"]) for x in out}, {x["a"] for x in out if x["b"] is None}
        for a in classes:
            for b in range(a + 1, 41):
                assert (a, b) in pairs or max((classes[a], 0, a), (classes[b], 0, b))[2] in marked
