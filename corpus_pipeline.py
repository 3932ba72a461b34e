"""Documents made ready for training: five stages, each over all that its predecessor kept.

A stage's result is written before the next one begins, so each stage first clears the
intermediate tables and broadcasts of the one before it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontamination, line_dedup, minhash, packing, toxicity
from tideline.llm.queries import tokenizer_path
from tideline.llm.scratch import drop, keep, kept, release, sent, unused


_left: list[str] = []  # intermediate tables of the stage before
_shared: list = []  # and its broadcasts


def clearing(stage):
    """Remove what the stage before has left, whose result is written by now."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _left)
        release(_shared)
        before, held = len(kept), set(sent)
        out = stage(spark, docs, sf_dir)
        _left[:] = kept[before:]
        _shared[:] = [b for b in sent if b not in held]
        return out

    return run_stage


@clearing
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from this stage's documents
    and their labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    out = unused(docs.columns, "_toxicity")
    return toxicity.score(docs, model, out=out).where(F.col(out) < 0.5).select(*docs.columns)


@clearing
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that resemble an earlier one. No document goes: one that loses all
    its lines stays with an empty text."""
    return line_dedup.deduplicated(docs)


@clearing
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id."""
    return minhash.deduplicated(docs)


@clearing
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@clearing
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trees, MinHash and a tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
