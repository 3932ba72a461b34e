import corpus_pipeline
from tests.llm.helpers import corpus, frame
from tideline.llm import decontamination, line_dedup, minhash


def test_stages_keep_columns_and_run_on_awkward_rows(spark, tmp_path):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(r for r in corpus(1))]
    folder = str(tmp_path)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame(spark, rows).select(*columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, len(rows), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing that any of these documents holds at all but words and words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert out.columns == columns
            assert out.count() <= docs.count() and out.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
        else:
            assert set(r.doc_id for r in out.select("doc_id").distinct().collect()) == set(r.doc_id for r in docs.select("doc_id").collect())
        docs = out
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_null_and_repeated_ids(spark):
    say = lambda a, n=30: " ".join(f"{a}{i}" for i in range(n))
    near = say("a").replace("a29", "other")
    rows = [
        (None, say("a"), "s"), (5, say("a"), "s"), (6, near, "s"), (None, say("b"), "s"), (7, say("c"), "s"), (7, near, "s"),
        (None, None, "s"), (8, say("d"), "s"), (8, say("d"), "s"),
    ]
    docs = frame(spark, rows, 1)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 5, False), (5, 5, True), (6, 5, False), (7, 5, False), (7, 7, True), (8, 8, False), (8, 8, True)]
    out = [(r.doc_id, r.text) for r in minhash.deduplicated(docs).collect()]
    assert sorted(out, key=str) == sorted([(5, say("a")), (None, say("b")), (7, say("c")), (None, None), (8, say("d"))], key=str)

    two = lambda a, b: say(a, 9) + "\n" + say(b, 9)
    rows = [(None, two("a", "b"), "s"), (None, two("c", "a"), "s"), (1, two("d", "b"), "s"), (1, two("e", "f"), "s"), (2, None, "s")]
    texts = [(r.doc_id, r.text) for r in line_dedup.deduplicated(frame(spark, rows, 1)).collect()]
    assert sorted(texts, key=str) == sorted([(None, two("a", "b")), (None, say("c", 9)), (1, say("d", 9)), (1, two("e", "f")), (2, None)], key=str)
    assert sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.decisions(frame(spark, rows, 1)).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]

    bench = spark.createDataFrame([(1, say("x", 20))], "item_id long, text string")
    rows = [(None, say("x", 20), "s"), (None, say("y"), "s"), (3, say("x", 25), "s"), (3, say("z"), "s"), (None, None, "s")]
    kept = [(r.doc_id, r.text) for r in decontamination.clean(frame(spark, rows, 1), bench).collect()]
    assert sorted(kept, key=str) == sorted([(None, say("y")), (3, say("z")), (None, None)], key=str)
    verdicts = sorted((r.doc_id or 0, r.contaminated) for r in decontamination.verdicts(frame(spark, rows, 1), bench).collect())
    assert verdicts == [(0, False), (0, False), (0, True), (3, False), (3, True)]


def test_columns_that_operators_use_inside(spark, tmp_path):
    """Callers' columns of the operators' own names come back as they were."""
    taken = ["_removed", "_id", "_doc", "_row", "_key", "_toxicity", "_ROW", "id", "hits"]
    say = lambda a, n=30: " ".join(f"{a}{i}" for i in range(n))
    texts = [say("a"), say("a").replace("a29", "b"), say("c") + "\n" + say("d"), say("e") + "\n" + say("d"), say("x", 20), None]
    data = [(i, t, *[f"{c}{i}" for c in taken if c != "_ROW"]) for i, t in enumerate(texts)]
    columns = [c for c in taken if c != "_ROW"]
    docs = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in columns))
    bench = spark.createDataFrame([(1, say("x", 20))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept[name] = {r.doc_id for r in out.collect() if all(r[c] == f"{c}{r.doc_id}" for c in columns)}
    assert kept["toxicity"] == kept["line_dedup"] == {0, 1, 2, 3, 4, 5}
    assert kept["near_dedup"] == {0, 2, 3, 4, 5} and kept["decontamination"] == {0, 1, 2, 3, 5}
    assert {r.doc_id: r.n_removed for r in line_dedup.decisions(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0}
    assert {r.doc_id for r in decontamination.verdicts(docs, bench).collect() if r.contaminated} == {4}
