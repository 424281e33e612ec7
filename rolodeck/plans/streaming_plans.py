"""Registered streaming re-aims (T1–T3): each query runs its stream to the end
of the staged input (``availableNow``) and returns the sink table it wrote."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from rolodeck.plans.import_plans import _imp
from rolodeck.plans.io_plans import _stage_import_csv
from rolodeck.plans.oracle_fixtures import with_fixtures
from rolodeck.session import staging_path
from rolodeck.sources.fixtures import load_model
from rolodeck.sources.import_fixture import import_files, import_rows
from rolodeck.sources.staged import staged
from rolodeck.streaming import rollups as S

FILES_PER_TRIGGER = 8


def _fresh(spark, name):
    return staging_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def q_stream_daily_activity(spark, sf):
    """Activity lands as one file per UTC day, oldest first; the stream
    keeps the daily counts per (account, day, type) current."""
    act = load_model(spark, sf).activity
    src = _fresh(spark, "activity-src")
    (act.withColumn("day", F.date_format("created_at", "yyyy-MM-dd")).repartition("day")
     .write.mode("overwrite").partitionBy("day").parquet(src))
    out, ck = _fresh(spark, "activity-rollup"), _fresh(spark, "activity-ckpt")
    S.daily_activity_stream(spark, src, out, ck, delay="60 days", files_per_trigger=FILES_PER_TRIGGER).awaitTermination()
    return S.read_rollup(spark, out)


def q_stream_import_files(spark, sf):
    """The staged CSV files are validated once each, a few per micro-batch."""
    m = load_model(spark, sf)
    path = _stage_import_csv(spark, sf)
    files = import_files(spark, sf)
    # the job table: which uploaded file belongs to which job / mode
    modes = staged(spark.read.format("binaryFile").load(path + "/*/*.txt").select(F.col("path").alias("file")) \
        .withColumn("name", F.regexp_extract("file", r"file=([^/]+)/", 1)) \
        .join(files.select(F.col("file").alias("name"), "job_id", "account_id", "mode"), "name").drop("name"), "import-modes")
    out, ck = _fresh(spark, "import-review"), _fresh(spark, "import-ckpt")
    S.import_files_stream(spark, path + "/*/*.txt", modes, m.contacts, out, ck, files_per_trigger=2).awaitTermination()
    rev = spark.read.parquet(out)
    return rev.select(F.regexp_extract("file", r"file=([^/]+)/", 1).alias("file"), "row_number", "errors")


def q_stream_exactly_once_chunks(spark, sf):
    """Chunk records arrive again, in the same run, in a later run and in a stream of its own; each (job, row) is applied once."""
    m = load_model(spark, sf)
    rows = import_rows(spark, sf, m.contacts).select(
        "job_id", "row_number", F.lit("2024-01-31 12:00:00").cast("timestamp_ntz").alias("staged_at"))
    src = _fresh(spark, "chunks-src")
    out, ck = _fresh(spark, "chunks-out"), _fresh(spark, "chunks-ckpt")
    rows.filter(F.col("row_number") % 3 > 0).write.mode("overwrite").parquet(os.path.join(src, "part=1"))
    rows.filter(F.col("row_number") % 2 == 0).write.mode("overwrite").parquet(os.path.join(src, "part=2"))
    S.exactly_once_chunks(spark, src + "/*", rows.schema, out, ck).awaitTermination()
    rows.write.mode("overwrite").parquet(os.path.join(src, "part=3"))
    S.exactly_once_chunks(spark, src + "/*", rows.schema, out, ck).awaitTermination()
    S.exactly_once_chunks(spark, src + "/*", rows.schema, out, ck + "-anew").awaitTermination()
    return S.read_applied(spark, out, rows.schema).select("job_id", "row_number")


QUERIES = {
    "stream_daily_activity": q_stream_daily_activity,
    "stream_import_files": q_stream_import_files,
    "stream_exactly_once_chunks": q_stream_exactly_once_chunks,
}

ORACLE = {
    "stream_daily_activity": with_fixtures("""
        SELECT account_id, strftime(created_at, '%Y-%m-%d') AS d, type, count(*) AS n
        FROM contact_activity GROUP BY 1, 2, 3"""),
    "stream_exactly_once_chunks": _imp("SELECT job_id, row_number FROM import_rows"),
}
ORACLE["stream_import_files"] = _imp("SELECT file, row_number, to_json(errors)::VARCHAR AS errors FROM reviewed")
