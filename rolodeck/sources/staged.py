"""Written tables in the shared checkpoint folder, where a plan is cut.

Like ``checkpoint()``, a written table survives lost executors and cuts the
lineage; unlike it, its size is known to the planner, so a join with a small
one is planned as a broadcast below the session's threshold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from rolodeck.session import staging_path


class Staged:
    """One written table: ``df`` reads it, ``drop()`` deletes it; what is left goes when the session ends."""

    def __init__(self, df: DataFrame, name: str):
        self._spark = df.sparkSession
        path = staging_path(self._spark, f"{name}-{uuid.uuid4().hex}")
        df.write.option("compression", "lz4").parquet(path)
        self.df = self._spark.read.schema(df.schema).parquet(path)
        jvm = self._spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)

    def drop(self) -> None:
        self._fs.delete(self._path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df
