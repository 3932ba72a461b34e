"""Benchmark decontamination by spaced-seed hashing.

A mask is laid over every run of SPAN words of a text; only the words under its ones are hashed,
so a substituted word under a zero leaves the hash as it is. Hashes of the benchmark's runs meet
those of the documents in a join, after a Bloom filter of fixed size that tasks hold. Around each
hit the document and the item are laid over each other. Of all stretches in which at least three of
four words agree, the one with the most agreeing words is taken; a document is contaminated by an
item of which it holds ``min_match`` agreeing words (of a shorter item, three quarters of its
words). A stretch that no mask fits has no hit and is not found.

Words are lower-case (A-Z) runs of other than white space. Items of 8 to SPAN - 1 words are met as
whole sequences; shorter items say nothing about a document and are left out.

Defined cases: null or empty texts have no words and match nothing; rows with equal or null
ids have verdicts of their own; repeated items are one item with several ids; empty tables give clean documents;
other columns are left as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.scratch import keep, share, shared, unused
from tideline.llm.text import LOWER, Chunk, chunks, mix

MASKS = ("111011001011", "110100111101", "101111010011", "110011101101")
SPAN, LEAST_WORDS, MIN_MATCH = 12, 8, 13
FILTER_BITS = 1 << 24
_U = np.uint64
_KEY = mix(np.arange(1, 33, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def word_hashes(chunk: Chunk):
    spans, raw = chunk.words(), LOWER[chunk.raw]
    return spans, Chunk.span_hash(chunk.prefix_hash(raw), spans.start, spans.end)


def seeds(h: np.ndarray, row: np.ndarray, masks):
    """(start, hash) of each mask at each place where it fits into a row."""
    for number, mask in enumerate(masks):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, mix(np.array([number + 64 * len(mask)], _U))[0])
        for i, bit in enumerate(mask):
            if bit == "1":
                total += h[i : i + n] * _KEY[i]
        fits = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
        yield fits, mix(total[fits])


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = _U(FILTER_BITS - 1)
    return (h & last).astype(np.int64), ((h >> _U(32)) & last).astype(np.int64)


def _items(batches):
    for batch in batches:
        for lo, hi, chunk in chunks(batch.column(1)):
            spans, h = word_hashes(chunk)
            border = pa.array(spans.first.astype(np.int32))
            words = pa.ListArray.from_arrays(border, pa.array((h >> _U(32)).astype(np.uint32).view(np.int32)))
            full = pa.ListArray.from_arrays(border, pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), words, full], ["item", "words", "hashes"])


def _item_seeds(batches, masks):
    for batch in batches:
        col = batch.column(1)
        h, border = col.values.to_numpy().view(_U), col.offsets.to_numpy()
        size = np.diff(border)
        row = np.repeat(np.arange(len(size)), size)
        h = h[border[0] : border[-1]]
        for start, hashed in seeds(h, row, masks):
            # A mask of a short item's length is for items of that length only.
            place = start - (border[:-1] - border[0])[row[start]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[start])), pa.array(hashed.view(np.int64)), pa.array(place.astype(np.int32))], ["item", "hash", "at"]
            )


def _hits(batches, sent, masks, reach: int):
    """Stretches of documents around seeds that the filter lets pass."""
    filter_ = shared(sent)
    for batch in batches:
        for lo, hi, chunk in chunks(batch.column(1)):
            spans, h = word_hashes(chunk)
            at, found = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
            for start, hashed in seeds(h, spans.row, masks):
                a, b = _bits(hashed)
                maybe = np.flatnonzero(filter_[a])
                maybe = maybe[filter_[b[maybe]]]
                at.append(start[maybe])
                found.append(hashed[maybe])
            at, found = np.concatenate(at), np.concatenate(found)
            order = np.argsort(at, kind="stable")
            at, found = at[order], found[order]
            if len(at):
                # One stretch for hits whose surroundings meet within a document.
                new = np.append(True, (at[1:] - at[:-1] > 2 * reach) | (spans.row[at[1:]] != spans.row[at[:-1]]))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                row = spans.row[at[first]]
                begin = np.maximum(at[first] - reach, spans.first[row])
                end = np.minimum(at[last] + reach + 1, spans.first[row + 1])
                size = end - begin
                take = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                hit_border = pa.array(np.append(first, len(at)).astype(np.int32))
                owner = np.cumsum(new) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(lo + row)), pa.array((begin - spans.first[row]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array((h[take] >> _U(32)).astype(np.uint32).view(np.int32))),
                        pa.ListArray.from_arrays(hit_border, pa.array(found.view(np.int64))),
                        pa.ListArray.from_arrays(hit_border, pa.array((at - begin[owner]).astype(np.int32))),
                    ],
                    ["id", "begin", "words", "hashes", "places"],
                )


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, agreeing words) of the stretch with the most agreeing words of all in which at
    least three of four agree; it begins and ends with one."""
    agreed = np.append(0, np.cumsum(same))
    total = 4 * agreed - 3 * np.arange(len(agreed))  # +1 for an agreeing word, -3 for another
    # For each end the earliest start whose total is no larger.
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int((agreed - agreed[start]).argmax())
    begin = int(start[end])
    matched = int(agreed[end] - agreed[begin])
    return begin + int(same[begin:end].argmax()) if matched else end, end, matched


def _overlaps(batches, min_match: int):
    for batch in batches:
        out = {"id": [], "item": [], "start": [], "end": [], "matched": []}
        ids, begin, item, shift = (batch.column(i).to_pylist() for i in range(4))
        for i in range(batch.num_rows):
            doc = batch.column(4)[i].values.to_numpy()
            test = batch.column(5)[i].values.to_numpy()
            lo, hi = max(0, -shift[i]), min(len(test), len(doc) - shift[i])
            if hi <= lo:
                continue
            start, end, matched = best_stretch(doc[lo + shift[i] : hi + shift[i]] == test[lo:hi])
            if matched >= min(min_match, -(-3 * len(test) // 4)):
                at = begin[i] + lo + shift[i]
                for name, v in zip(out, (ids[i], item[i], at + start, at + end, matched)):
                    out[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["id"], batch.schema.field(0).type), pa.array(out["item"], batch.schema.field(2).type), *(pa.array(out[c], pa.int32()) for c in ("start", "end", "matched"))], list(out))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH) -> DataFrame:
    """(id, item, start, end, matched) of verified overlaps; places count words of the document."""
    spark, kind, item_kind = docs.sparkSession, dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    items = benchmark.select(item_col, item_text).mapInArrow(_items, f"item {item_kind}, words array<int>, hashes array<long>")
    items = keep(items.where(F.size("words") >= LEAST_WORDS), "benchmark")
    longest = items.agg(F.max(F.size("words"))).first()[0] or SPAN
    short = [r[0] for r in items.select(F.size("words").alias("n")).where(f"n < {SPAN}").distinct().collect()]  # at most 4 lengths
    masks = MASKS + tuple("1" * n for n in sorted(short))
    tests = items.select("item", "hashes").mapInArrow(lambda b: _item_seeds(b, masks), f"item {item_kind}, hash long, at int")
    tests = keep(tests, "benchmark-seeds")
    # The filter has a fixed size: at most FILTER_BITS places come to the driver.
    low = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    high = F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = tests.select(F.explode(F.array(low, high)).alias("bit")).distinct().toArrow()["bit"].to_numpy()
    filter_ = np.zeros(FILTER_BITS, bool)
    filter_[bits] = True
    sent = share(spark, filter_)
    stretches = keep(
        docs.select(id_col, text_col).mapInArrow(
            lambda b: _hits(b, sent, masks, longest), f"id {kind}, begin int, words array<int>, hashes array<long>, places array<int>"
        ).withColumn("part", F.monotonically_increasing_id()), "benchmark-hits",
    )
    hits = stretches.select("part", F.explode(F.arrays_zip("hashes", "places")).alias("e")).select("part", F.col("e.hashes").alias("hash"), F.col("e.places").alias("place"))
    lined = hits.join(tests, "hash").select("part", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    return (
        lined.join(stretches.select("part", "id", "begin", F.col("words").alias("doc")), "part")
        .join(items.select("item", F.col("words").alias("test")), "item")
        .select("id", "begin", "item", "shift", "doc", "test")
        .mapInArrow(lambda b: _overlaps(b, min_match), f"id {kind}, item {item_kind}, start int, end int, matched int")
    )


def _by_text(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, *options) -> DataFrame:
    """``overlaps`` by id and hash of the text, as ids may be null or repeated."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc")).alias("_key"), text_col)
    return overlaps(keyed, benchmark, "_key", text_col, *options)


def _joined(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``docs`` joined with ``found`` by ``id.id`` and ``id.doc``, also where the id is null."""
    key = unused([*docs.columns, *found.columns], "_key")
    found = found.withColumnRenamed("id", key)
    same = docs[id_col].eqNullSafe(found[key]["id"]) & (F.xxhash64(docs[text_col]) == found[key]["doc"])
    return docs.join(found, same, how)


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH) -> DataFrame:
    """One row per document: id, contaminated, n_items, items (sorted), spans (word ranges, joined).

    ``items`` of a document are bounded by the benchmark.
    """
    found = _by_text(docs, benchmark, id_col, text_col, item_col, item_text, min_match).distinct()
    by_item = found.groupBy("id", "item").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    by_doc = by_item.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("item", "start", "end"))).alias("hits"))
    return _joined(docs.select(id_col, text_col), by_doc, id_col, text_col, "left").select(
        id_col, F.col("hits").isNotNull().alias("contaminated"), F.coalesce(F.size("hits"), F.lit(0)).alias("n_items"),
        F.coalesce(F.col("hits.item"), F.array().cast(by_doc.select("hits.item").schema[0].dataType)).alias("items"),
        F.coalesce(F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["start"].cast("string"), h["end"].cast("string"))), ","), F.lit("")).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH) -> DataFrame:
    """``docs`` without the contaminated ones."""
    found = _by_text(docs, benchmark, id_col, text_col, item_col, item_text, min_match)
    return _joined(docs, found.select("id").distinct(), id_col, text_col, "left_anti").select(*docs.columns)
