"""Life of an import job (I8): confirm and cancel as a batch, chunks applied in runs that can be interrupted.

Requests change a job's status by a table of allowed transitions. A run
applies the next chunks of all importing jobs, in job order, and is committed
as a whole: its changed rows and its ledger (a row per job and chunk with what
became of the rows) lie in a folder of the run, which counts only once its
marker is written. A run that breaks off leaves nothing behind, the next one
begins at the first chunk that no committed run has, and each run works on the
snapshot with the committed runs laid over it, so an interrupted job ends with
the counters of an uninterrupted one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolodeck.operators import importing as I
from rolodeck.sources.staged import staged

# Fixed values: (action, status of the job) -> next status; outcome codes and messages.
ALLOWED = {("confirm", "ready"): "importing", ("cancel", "validating"): "cancelled", ("cancel", "ready"): "cancelled"}
APPLIED, NOT_FOUND, NOTHING = "APPLIED", "NOT_FOUND", "NOTHING_TO_IMPORT"
REFUSED = {"confirm": "IMPORT_NOT_READY", "cancel": "IMPORT_NOT_CANCELLABLE"}
MESSAGES = {"confirm": ("This import is ", ", so it can't be started"), "cancel": ("This import is ", ", so it can't be cancelled")}
NOTHING_MESSAGE = "There are no valid rows to import"

TABLES = ("contacts", "tags", "links", "activity", "errors", "ledger")
MARKER = "_COMMITTED"


def judge_requests(jobs: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Confirm and cancel requests in ``seq`` order. ``jobs``: id, account_id, status, valid_rows; ``requests``: seq,
    account_id, job_id, action. Returns outcomes (seq, job_id, action, outcome, message) and jobs (id, status of those changed).

    No allowed transition leads to a status that allows another one, so a job changes at most once in a batch: by the first
    request that its status allows. Later requests meet the new status, earlier ones the old one. Finding the first is a
    map-side combined minimum, so a job that a third of all requests name is no hot task.
    """
    allowed = requests.sparkSession.createDataFrame([(a, s, n) for (a, s), n in ALLOWED.items()], "action string, was string, next string")
    j = jobs.select(F.col("id").alias("job_id"), "account_id", F.col("status").alias("was"), F.col("valid_rows").alias("_valid"))
    judged = requests.select("seq", "account_id", "job_id", "action").join(j, ["job_id", "account_id"], "left").join(F.broadcast(allowed), ["action", "was"], "left")  # three rows
    empty = (F.col("action") == "confirm") & (F.col("was") == "ready") & (F.coalesce("_valid", F.lit(0)) <= 0)
    possible = F.col("next").isNotNull() & ~empty
    first = judged.filter(possible).groupBy("job_id", "account_id").agg(F.min("seq").alias("_at"), F.min_by("next", "seq").alias("_becomes"))
    seen = judged.join(first, ["job_id", "account_id"], "left").withColumn("status", F.when(F.col("seq") > F.col("_at"), F.col("_becomes")).otherwise(F.col("was")))
    refused = F.create_map(*[F.lit(x) for kv in REFUSED.items() for x in kv])[F.col("action")]
    text = F.lit(None)
    for action, (head, tail) in MESSAGES.items():
        text = F.when(F.col("action") == action, F.concat(F.lit(head), "status", F.lit(tail))).otherwise(text)
    nothing = empty & (F.col("status") == "ready")
    applied = F.col("seq").eqNullSafe(F.col("_at"))
    outcome = F.when(F.col("was").isNull(), NOT_FOUND).when(applied, APPLIED).when(nothing, NOTHING).otherwise(refused)
    message = F.when(F.col("was").isNull() | applied, None).when(nothing, NOTHING_MESSAGE).otherwise(text)
    return {"outcomes": seen.select("seq", "job_id", "action", outcome.alias("outcome"), message.alias("message")),
            "jobs": first.select(F.col("job_id").alias("id"), F.col("_becomes").alias("status"))}


class Runs:
    """The committed runs under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, no: int) -> str:
        return f"{self.path}/run={no}"

    def committed(self) -> list[int]:
        found = self._fs.globStatus(self._jvm.Path(f"{self.path}/run=*/{MARKER}")) or []
        return sorted(int(st.getPath().getParent().getName().split("=")[1]) for st in found)

    def write(self, outputs: dict[str, DataFrame]) -> int:
        """A run's tables, replacing what a run that broke off left under the same number; not committed yet."""
        no = max(self.committed(), default=-1) + 1
        for name in TABLES:
            outputs[name].write.mode("overwrite").parquet(f"{self._folder(no)}/{name}")
        return no

    def commit(self, no: int) -> None:
        self._fs.create(self._jvm.Path(f"{self._folder(no)}/{MARKER}")).close()

    def read(self, name: str) -> DataFrame | None:
        """A table's rows of all committed runs, with ``run``; None before the first."""
        out = None
        for no in self.committed():
            df = self.spark.read.parquet(f"{self._folder(no)}/{name}").withColumn("run", F.lit(no))
            out = df if out is None else out.unionByName(df)
        return out

    def over(self, name: str, base: DataFrame, key: list[str]) -> DataFrame:
        """``base`` with the rows that the committed runs added or changed."""
        mine = self.read(name)
        if mine is None:
            return base
        latest = mine.groupBy(*key).agg(F.max_by(F.struct(*[c for c in base.columns if c not in key]), "run").alias("r")).select(*key, "r.*")
        return base.join(latest.select(*key), key, "left_anti").unionByName(latest.select(*base.columns))


def pending_chunks(reviewed: DataFrame, importing: DataFrame, ledger: DataFrame | None, chunk: int) -> DataFrame:
    """(job_id, chunk) of importing jobs that no committed run has applied."""
    rows = reviewed.join(importing.select("job_id"), "job_id", "left_semi")
    chunks = rows.select("job_id", _chunk(chunk)).distinct()
    return chunks if ledger is None else chunks.join(ledger.select("job_id", "chunk"), ["job_id", "chunk"], "left_anti")


def _chunk(size: int):
    return F.floor((F.col("row_number") - 1) / size).alias("chunk")


def run(runs: Runs, reviewed: DataFrame, jobs: DataFrame, contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, as_of: dt.datetime,
        max_chunks: int | None = None, chunk: int = I.CHUNK_SIZE, commit: bool = True) -> bool:
    """Apply the next chunks (at most ``max_chunks`` of all jobs together, in job order) and commit them; False if none is left.

    ``reviewed``: rows of I4's review; ``jobs``: job_id, status. ``commit=False`` breaks off before the marker, as a lost driver would.
    """
    todo = pending_chunks(reviewed, jobs.filter(F.col("status") == "importing"), runs.read("ledger"), chunk)
    if max_chunks is not None:
        todo = todo.orderBy("job_id", "chunk").limit(max_chunks)
    todo = staged(todo, "chunks")
    if todo.isEmpty():
        return False
    rows = staged(reviewed.withColumn("chunk", _chunk(chunk)).join(todo, ["job_id", "chunk"], "left_semi").drop("chunk"), "chunk-rows")
    now = [staged(runs.over("contacts", contacts, ["id"]), "contacts"), runs.over("tags", tags.withColumn("id", F.col("id").cast("long")), ["id"]),
           runs.over("links", contact_tags.withColumn("tag_id", F.col("tag_id").cast("long")), ["contact_id", "tag_id"])]
    made, changed = I.apply_create(rows, *now, as_of), I.apply_update(rows, *now, as_of)
    errors = made["errors"].unionByName(changed["errors"])
    fate = made["outcomes"].unionByName(changed["outcomes"]).unionByName(errors.select("file", "job_id", "row_number", F.lit("error").alias("outcome")).distinct())
    each = rows.select("job_id", "row_number", (F.size("errors") > 0).alias("rejected")).join(fate.select("job_id", "row_number", "outcome"), ["job_id", "row_number"], "left")
    ledger = each.groupBy("job_id", _chunk(chunk)).agg(
        F.count_distinct("row_number").alias("rows"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "updated", "unchanged")],
        F.count_if(F.col("rejected")).alias("rejected"), F.count_if(F.col("outcome") == "error").alias("errors"))
    no = runs.write({
        "contacts": made["new_contacts"].unionByName(changed["updated_contacts"]).select(*contacts.columns),
        "tags": made["new_tags"].unionByName(changed["new_tags"]).dropDuplicates(["id"]),
        "links": made["new_links"].unionByName(changed["new_links"]).dropDuplicates(["contact_id", "tag_id"]),
        "activity": made["activity"].unionByName(changed["activity"]), "errors": errors, "ledger": ledger})
    if commit:
        runs.commit(no)
    return True


def job_counters(runs: Runs, jobs: DataFrame) -> DataFrame:
    """Per job of ``jobs`` (job_id, status, total_rows): processed rows, what became of them, and completed once all are."""
    ledger = runs.read("ledger")
    names = ("rows", "created", "updated", "unchanged", "rejected", "errors")
    if ledger is None:
        sums = jobs.select("job_id", *[F.lit(0).cast("long").alias(n) for n in names])
    else:
        sums = ledger.groupBy("job_id").agg(*[F.sum(n).alias(n) for n in names])
    z = {n: F.coalesce(n, F.lit(0)).cast("long") for n in names}
    status = F.when((F.col("status") == "importing") & (z["rows"] >= F.col("total_rows")), "completed").otherwise(F.col("status"))
    return jobs.select("job_id", "status", "total_rows").join(sums, "job_id", "left").select(
        "job_id", z["rows"].alias("processed"), z["created"].alias("created"), z["updated"].alias("updated"), z["unchanged"].alias("unchanged"),
        (z["rejected"] + z["errors"]).alias("error_rows"), status.alias("status"))
