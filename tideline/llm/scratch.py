"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import pickle
import uuid
import weakref
from contextlib import contextmanager, nullcontext

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a folder of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/tideline-llm"


#: Paths of the tables that this process has kept, in order.
kept: list[str] = []


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries made and run in here remove their shuffle files when they end, not when the driver
    happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def keep(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost
    executor costs only the tasks that were running. ``tidy``: the shuffle files go at once."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark) if tidy else nullcontext():
        df.write.parquet(path)
    kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove kept tables, once all that reads them has been written."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], name: str) -> str:
    """``name``, or one made from it, that no column has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Broadcasts of this process that something still refers to.
sent: weakref.WeakSet[Broadcast] = weakref.WeakSet()


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object of this subpackage's own classes, which travel by value."""
    out = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    sent.add(out)
    return out


def release(shares: list[Broadcast]) -> None:
    """Take back broadcasts, once all that reads them has been written: executors and the Python
    workers that they keep between tasks hold them until then."""
    for one in shares:
        if one in sent:
            sent.discard(one)
            one.destroy()


def shared(sent: Broadcast):
    return pickle.loads(sent.value)
