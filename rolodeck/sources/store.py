"""The contact store: derived tables written once as Parquet, read by every query.

Contacts are the table every operator scans, so they are stored the way the
scans and joins want them: with their links in buckets by contact id, so that
the two join without an exchange, and sorted inside each file by (account_id,
created_at, id), which gives Parquet min/max statistics for tenant filters and
keyset seeks. The store lives in the shared
checkpoint folder, keyed by a fingerprint of the input files (path, size,
modification time) and of the derivation, and is published with a marker file written last, so a
half-written attempt is never read and a lost executor only costs a retry.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from rolodeck.session import staging_path
from rolodeck.sources import fixtures as fx
from rolodeck.sources.contacts import BUCKETS, read_bucketed, write_bucketed

INPUTS = ("customer", "part", "orders", "events", "supplier")
TABLES = ("contacts", "tags", "contact_tags", "activity", "import_jobs")
#: Rises with each change of what is derived, so that a store of an earlier derivation is not read.
DERIVATION = 3
MARKER = "_READY"
SCHEMAS = "_SCHEMAS"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Hash of the derivation and of the input files' paths, sizes and modification times."""
    parts = [sf_dir, f"derivation {DERIVATION}"]
    for name in INPUTS:
        p, fs = _fs(spark, f"{sf_dir}/{name}.parquet")
        for st in fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]:
            parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.sha1("|".join(sorted(parts)).encode()).hexdigest()[:16]


def _read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _read_marker(spark: SparkSession, base: str) -> str | None:
    return _read_text(spark, os.path.join(base, MARKER))


def _write_marker(spark: SparkSession, base: str, attempt: str) -> str:
    try:
        _write_text(spark, os.path.join(base, MARKER), attempt, overwrite=False)  # fails if another writer published first
    except Exception:  # noqa: BLE001
        return _read_marker(spark, base)
    return attempt


def build(spark: SparkSession, sf_dir: str, attempt_dir: str) -> None:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = {t: (_table_name(attempt_dir, t), os.path.join(attempt_dir, t)) for t in BUCKETS}
    contacts = fx.contacts(spark, sf_dir)
    write_bucketed(contacts, "contacts", *place["contacts"], buckets)
    # the other tables take the stored contacts, so that these are derived once
    m = fx.derive_model(spark, sf_dir, read_bucketed(spark, "contacts", *place["contacts"], contacts.schema, buckets))
    write_bucketed(m.contact_tags, "contact_tags", *place["contact_tags"], buckets)
    m.tags.write.mode("overwrite").parquet(os.path.join(attempt_dir, "tags"))
    (m.activity.repartitionByRange("account_id", "created_at", "id").sortWithinPartitions("account_id", "created_at", "id")
     .write.mode("overwrite").parquet(os.path.join(attempt_dir, "activity")))
    m.import_jobs.write.mode("overwrite").parquet(os.path.join(attempt_dir, "import_jobs"))
    _record_schemas(spark, attempt_dir, buckets)


def _table_name(attempt_dir: str, table: str) -> str:
    return f"rolodeck_{hashlib.sha1(attempt_dir.encode()).hexdigest()[:12]}_{table}"


def _record_schemas(spark: SparkSession, attempt_dir: str, buckets: int) -> str:
    """Write the tables' schemas and the number of buckets next to them, so readers pass them instead of
    inferring them (a footer-reading job per table and query). The content
    comes from the files, so concurrent writers write the same text."""
    schemas = {t: json.loads(spark.read.parquet(os.path.join(attempt_dir, t)).schema.json()) for t in TABLES}
    text = json.dumps(schemas | {"buckets": buckets})
    # written under a temporary name and renamed, so a reader never sees half a file
    tmp = os.path.join(attempt_dir, f"{SCHEMAS}.tmp-{uuid.uuid4().hex[:8]}")
    _write_text(spark, tmp, text)
    tp, fs = _fs(spark, tmp)
    if not fs.rename(tp, _fs(spark, os.path.join(attempt_dir, SCHEMAS))[0]):
        fs.delete(tp, False)  # another reader recorded the same schemas first
    return text


def stored_model(spark: SparkSession, sf_dir: str) -> fx.Model:
    """The derived model for ``sf_dir``, built on first use and then read."""
    base = staging_path(spark, f"store-{fingerprint(spark, sf_dir)}")
    attempt = _read_marker(spark, base)
    if attempt is None:
        attempt_dir = os.path.join(base, f"attempt-{uuid.uuid4().hex[:12]}")
        build(spark, sf_dir, attempt_dir)
        attempt = _write_marker(spark, base, attempt_dir)
    recorded = json.loads(_read_text(spark, os.path.join(attempt, SCHEMAS)))
    read = {}
    for t in TABLES:
        schema, path = StructType.fromJson(recorded[t]), os.path.join(attempt, t)
        if t in BUCKETS:
            read[t] = read_bucketed(spark, t, _table_name(attempt, t), path, schema, recorded["buckets"])
        else:
            read[t] = spark.read.schema(schema).parquet(path)
    return fx.Model(**read)

