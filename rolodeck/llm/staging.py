"""Written tables in the shared checkpoint folder, where a plan is cut.

A stage boundary that is read more than once (or that loops) is a Parquet
table under ``spark.checkpoint.dir``: it survives lost executors, its size is
known to the planner (so a join broadcasts it only below the session's
threshold), and it can be dropped as soon as nothing reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from rolodeck.session import staging_path


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_collectors: list[list[Staged]] = []


@contextmanager
def collecting(into: list[Staged]) -> Iterator[None]:
    """Adds the tables that are written meanwhile to ``into``."""
    _collectors.append(into)
    try:
        yield
    finally:
        _collectors.remove(into)


def drop_unread(tables: list[Staged], reader: DataFrame) -> None:
    """Deletes those of ``tables`` that ``reader`` does not read, and takes them off the list."""
    files = reader.inputFiles() if tables else []
    kept = [t for t in tables if any(f"/{t.name}/" in f for f in files)]
    for t in tables:
        if t not in kept:
            t.drop()
    tables[:] = kept


class Staged:
    """One written table: ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.name = f"llm-{name}-{uuid.uuid4().hex}"
        self.path = staging_path(spark, self.name)
        df.write.option("compression", "zstd").parquet(self.path)
        p, fs = _path(spark, self.path)
        fs.deleteOnExit(p)  # what is still read when the session ends goes with it
        self.df = spark.read.schema(df.schema).parquet(self.path)
        for into in _collectors:
            into.append(self)

    def drop(self) -> None:
        p, fs = _path(self.df.sparkSession, self.path)
        fs.delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back."""
    return Staged(df, name).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
