"""Secret scan with corpus-wide ownership frequency.

Three fixed patterns give base spans. Further candidates are long runs of token characters with
mixed classes and high entropy. Every candidate value is hashed, and the corpus counts in how many
distinct repositories and by how many distinct owners each hash appears. A value that many owners
carry is a widely copied example; one that a single owner carries looks live. Candidates that look
live and lie outside every base span are added as spans of kind ``owned``; base spans always stay.

Defined cases: a null or empty text has no span; a null owner or repository counts as the empty
name; rows with the same id stay separate rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.scratch import keep
from tideline.llm.text import _mask, chunks

# Fixed patterns of the contract; after a match, the smallest accepted length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

MIN_TOKEN, MIN_ENTROPY, LIVE_OWNERS = 16, 3.0, 1
DIGIT = _mask((48, 57))
ALPHA = _mask((65, 90), (97, 122))
TOKEN = DIGIT | ALPHA | np.isin(np.arange(256), np.frombuffer(b"+/_=-", np.uint8))

_SCHEMA = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, base string, "
    "candidates array<struct<kind:string,start:int,end:int,value_hash:string>>"
)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of kind, end, value) of the base kinds, sorted."""
    found = [
        (m.start(), 0, m.end(), m[2])
        for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= MIN_ASSIGN
    ]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(ACCESS, text) if len(m[0]) >= MIN_ACCESS]
    # Runs are maximal, so the shortest accepted length may be asked for in the pattern.
    found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(rf"[0-9a-f]{{{MIN_HEX},}}", text)]
    return sorted(found)


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def further_candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    out = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}", text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and entropy(v) >= MIN_ENTROPY:
            if not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                out.append((m.start(), 3, m.end(), v))
    return out


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def suspicious(texts: pa.Array) -> np.ndarray:
    """Rows that may hold a span; a superset, found without per-row Python."""
    texts = pc.fill_null(texts, "")
    hit = pc.match_substring_regex(texts, ASSIGN, ignore_case=True)
    hit = pc.or_(hit, pc.match_substring(texts, "AKIA")).to_numpy(zero_copy_only=False).astype(bool)
    for lo, hi, chunk in chunks(texts):
        runs = chunk.runs(TOKEN[chunk.raw])
        long = runs.end - runs.start >= MIN_TOKEN
        hit[lo + np.unique(runs.row[long])] = True
    return hit


def _scan(batches):
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        rows = [(0, 0, 0, empty, "", [])] * len(texts)
        for i in np.flatnonzero(suspicious(texts)):
            text = texts[int(i)].as_py() or ""
            base = base_spans(text)
            spans = joined(base)
            kinds = [k for _, k, _, _ in base]
            found = [
                {"kind": KINDS[k], "start": s, "end": e, "value_hash": hashlib.blake2b(v.encode(), digest_size=16).hexdigest()}
                for s, k, e, v in base + further_candidates(text, base)
            ]
            rows[i] = (*(kinds.count(k) for k in range(3)), hashlib.sha256(spans.encode()).hexdigest(), spans, found)
        columns = list(zip(*rows)) if rows else [[]] * 6
        struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_hash", pa.string())])
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(struct)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(list(c), t) for c, t in zip(columns, types))],
            [*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"],
        )


def scan(docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with base counts, base spans and all candidates."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(_scan, f"id {kind}, repo string, owner string, {_SCHEMA}")


def ownership(candidates: DataFrame) -> DataFrame:
    """Documents, repositories and owners of each value. Three aggregations, each combined before
    its shuffle, so a value in a third of all rows arrives as few rows."""
    return (
        candidates.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
        .groupBy("value_hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
        .groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))
    )


def find_secrets(
    docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text",
    live_owners: int = LIVE_OWNERS,
) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    ``spans`` is ``kind:start:end`` in code points, ends exclusive, by start and then kind.
    ``n_live`` counts candidates, base ones included, whose value has at most ``live_owners``
    owners; ``n_example`` the others.
    """
    scanned = keep(scan(docs, repo, owner, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "secrets")
    found = scanned.where(F.size("candidates") > 0).select("row", "owner", "repo", F.inline("candidates"))
    counts = ownership(found)
    judged = (
        found.join(counts, "value_hash").withColumn("live", F.col("owners") <= live_owners)
        .groupBy("row").agg(
            F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
            F.collect_list(F.when(F.col("live") & (F.col("kind") == "owned"), F.struct("start", "end"))).alias("added"),
        )
    )
    base = F.transform(
        F.filter("candidates", lambda c: c["kind"] != "owned"),
        lambda c: F.struct(c["start"].alias("start"), F.array_position(F.lit(list(KINDS)), c["kind"]).alias("rank"), c["end"].alias("end")),
    )
    added = F.transform(
        F.coalesce("added", F.array().cast("array<struct<start:int,end:int>>")),
        lambda c: F.struct(c["start"].alias("start"), F.lit(4).cast("long").alias("rank"), c["end"].alias("end")),
    )
    spans = F.array_join(
        F.transform(
            F.array_sort(F.concat(base, added)),
            lambda c: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), c["rank"].cast("int")), c["start"].cast("string"), c["end"].cast("string")),
        ), ",",
    )
    return scanned.join(judged, "row", "left").select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
