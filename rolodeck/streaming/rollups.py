"""Structured Streaming re-aims.

* T2 ``daily_activity_stream``: activity files arrive in a folder; daily
  counts per (account, day, type) are kept current with a watermark,
  duplicate events (same id) are dropped within the watermark, and each
  micro-batch writes the counts that it changed under its batch id
  (``upsert_rollup``); ``read_rollup`` takes the latest of each. A replayed
  batch replaces itself, and what was there before stays readable meanwhile.
* T1 ``import_files_stream``: CSV files dropped in a folder are validated
  once each; the review rows of every micro-batch are written under a
  folder named by the batch id, so a replayed batch overwrites itself.
* T3 ``exactly_once_chunks``: import chunk records are applied once per
  (job, row), however late they come again and whatever stream brings them:
  a micro-batch leaves out what the ledger of applied rows (the sink itself)
  has from other batches, and replaces what it wrote itself.

All checkpoints and outputs live under the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolodeck.operators import importing as I
from rolodeck.sources import csvio

ACTIVITY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("account_id", T.IntegerType()),
    T.StructField("contact_id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])


ROLLUP_KEY = ["account_id", "d", "type"]
ROLLUP_SCHEMA = "account_id int, d string, type string, n long"


def _folders(spark: SparkSession, out_dir: str, kind: str) -> dict[int, str]:
    """Committed folders ``<kind>=<number>`` of a sink, by number."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = jvm.Path(out_dir)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for st in fs.globStatus(jvm.Path(top, f"{kind}=*")) or []:
        if fs.exists(jvm.Path(st.getPath(), "_SUCCESS")):
            found[int(st.getPath().getName().split("=")[1])] = st.getPath().toString()
    return found


def _drop_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_rollup(spark: SparkSession, out_dir: str) -> DataFrame:
    """T2's table: (account_id, d, type, n), of each key the count that was written last.

    Reads the newest committed base and the batches after it."""
    bases, batches = _folders(spark, out_dir, "base"), _folders(spark, out_dir, "batch")
    base = max(bases, default=-1)
    out = spark.createDataFrame([], ROLLUP_SCHEMA + ", no long")
    for no, path in [*([(base, bases[base])] if bases else []), *((no, p) for no, p in sorted(batches.items()) if no > base)]:
        out = out.unionByName(spark.read.schema(ROLLUP_SCHEMA).parquet(path).withColumn("no", F.lit(no).cast("long")))
    return out.groupBy(*ROLLUP_KEY).agg(F.max_by("n", "no").alias("n"))


def upsert_rollup(touched: DataFrame, batch_id: int, out_dir: str, compact_every: int = 16) -> None:
    """Write the counts that a batch changed; every so many batches all counts become a new base.

    Nothing that a reader needs is removed: batches and bases go once a later base has taken over twice."""
    spark = touched.sparkSession
    touched.select(*ROLLUP_KEY, "n").write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
    if (batch_id + 1) % compact_every:
        return
    read_rollup(spark, out_dir).write.mode("overwrite").parquet(f"{out_dir}/base={batch_id}")
    keep = batch_id - compact_every
    for kind in ("batch", "base"):
        for no, path in _folders(spark, out_dir, kind).items():
            if no < keep or (kind == "batch" and no == keep):
                _drop_folder(spark, path)


def daily_activity_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                          delay: str = "60 days", files_per_trigger: int = 1, available_now: bool = True, compact_every: int = 16):
    """Start the rollup stream; returns the StreamingQuery.

    The watermark delay bounds the state (event ids and open days): events
    older than the watermark are dropped (late data), everything within it is
    counted once per id. Update mode: a batch emits only the counts it changed.
    """
    events = (
        spark.readStream.schema(ACTIVITY_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
        .withColumn("event_time", F.col("created_at").cast("timestamp"))
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["id"])
    )
    counts = events.groupBy("account_id", F.window("event_time", "1 day").alias("w"), "type").agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_rollup(batch.withColumn("d", F.date_format(F.col("w.start"), "yyyy-MM-dd")), batch_id, out_dir, compact_every)

    w = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def import_files_stream(spark: SparkSession, source_glob: str, modes: DataFrame, contacts: DataFrame,
                        out_dir: str, checkpoint: str, files_per_trigger: int = 10, available_now: bool = True):
    """Validate each new CSV file once. The stream tracks which files
    were seen (file source + checkpoint); each micro-batch reviews just its
    files with the batch pipeline and writes the review under its batch id."""
    seen = (
        spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger)
        .load(source_glob).select(F.col("_metadata.file_path").alias("file"))
    )

    def review_batch(batch: DataFrame, batch_id: int) -> None:
        # the file names of one micro-batch (at most files_per_trigger of them)
        paths = [r.file for r in batch.select("file").distinct().collect()]
        if not paths:
            return
        files, rows = csvio.read_import_files(spark, paths, modes.filter(F.col("file").isin(paths)))
        written = []
        rev = I.review(rows, files, contacts, written)
        (rev.select("file", "job_id", "row_number", F.to_json("errors").alias("errors"), F.lit(batch_id).alias("batch_id"))
         .write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}")))
        for table in written:
            table.drop()

    w = seen.writeStream.foreachBatch(review_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def apply_once(batch: DataFrame, stream: str, batch_id: int, out_dir: str) -> None:
    """Write the rows of ``batch`` whose (job_id, row_number) no other batch of any stream has written; of rows with the
    same key in the batch the earliest staged one. The ledger is read for the jobs of the batch only."""
    spark = batch.sparkSession
    key = ["job_id", "row_number"]
    others = {no: p for no, p in _ledger(spark, out_dir).items() if no != (stream, batch_id)}
    rest = [c for c in batch.columns if c not in key]
    once = batch.groupBy(*key).agg(F.min(F.struct("staged_at", *[c for c in rest if c != "staged_at"])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
    if others:
        applied = spark.read.schema(batch.select(*key).schema).parquet(*others.values()).join(batch.select("job_id").distinct(), "job_id", "left_semi")
        once = once.join(applied, key, "left_anti")
    once.select(*batch.columns).write.mode("overwrite").parquet(os.path.join(out_dir, f"stream={stream}", f"batch={batch_id}"))


def _ledger(spark: SparkSession, out_dir: str) -> dict[tuple[str, int], str]:
    """Committed folders of T3's sink by (stream, batch)."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = jvm.Path(out_dir)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    streams = [st.getPath() for st in fs.globStatus(jvm.Path(top, "stream=*")) or []]
    return {(p.getName().split("=")[1], no): path for p in streams for no, path in _folders(spark, p.toString(), "batch").items()}


def read_applied(spark: SparkSession, out_dir: str, schema: T.StructType) -> DataFrame:
    """T3's table: every applied row."""
    paths = list(_ledger(spark, out_dir).values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def exactly_once_chunks(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, checkpoint: str,
                        files_per_trigger: int = 100, available_now: bool = True):
    """Apply each (job_id, row_number) once across restarts, replays and streams.

    ``source_dir`` holds chunk records (job_id, row_number, …, staged_at). A
    replayed micro-batch replaces its own folder; a row that comes again in a
    later batch, a later run or a stream with a new checkpoint is in the ledger
    and adds nothing, at any time. The stream itself keeps no state."""
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    recs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    w = recs.writeStream.foreachBatch(lambda batch, batch_id: apply_once(batch, stream, batch_id, out_dir)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
