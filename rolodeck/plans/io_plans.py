"""Registered source / sink queries (S1 is in listing; S2, S3, S6, S8–S11 here)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rolodeck.functions.csvcells import csv_quote
from rolodeck.functions.jsonpayload import json_object, json_path
from rolodeck.operators import listing as L
from rolodeck.plans.oracle_fixtures import with_fixtures
from rolodeck.session import staging_path
from rolodeck.sources import csvio
from rolodeck.sources import generator as G
from rolodeck.sources.fixtures import AS_OF, load_model, raw
from rolodeck.sources.import_fixture import import_files, import_rows

EXPORT_QUERY = L.ListQuery()  # the default list: active contacts, newest first


def q_export_csv(spark, sf):
    m = load_model(spark, sf)
    return csvio.export_lines(m.contacts, m.tags, m.contact_tags, EXPORT_QUERY, AS_OF)


def _stage_import_csv(spark, sf) -> str:
    """Write the derived import files as real CSV text (header + rows, CRLF,
    RFC 4180 quoting) into a fresh folder under the shared checkpoint folder."""
    m = load_model(spark, sf)
    files = import_files(spark, sf)
    rows = import_rows(spark, sf, m.contacts)
    quoted = lambda arr: F.array_join(F.transform(arr, lambda x: csv_quote(x)), ",")
    lines = files.select("file", F.lit(0).cast("long").alias("n"), quoted(F.col("header")).alias("line")).unionByName(
        rows.select("file", "row_number", quoted(F.col("cells")).alias("line")).withColumnRenamed("row_number", "n"))
    path = staging_path(spark, f"csv-import-{uuid.uuid4().hex[:12]}")
    (lines.repartition("file").sortWithinPartitions("file", "n").select("file", "line")
     .write.mode("overwrite").partitionBy("file").option("lineSep", "\r\n").text(path))
    return path


def q_csv_scan(spark, sf):
    path = _stage_import_csv(spark, sf)
    rec = csvio.read_csv_records(spark, path + "/*/*.txt")
    return rec.select(F.regexp_extract("file", r"file=([^/]+)/", 1).alias("file"), "record_no",
                      F.size("cells").alias("n_cells"), F.array_join("cells", "|").alias("cells"), "too_long")


def _stage_uploads(spark, sf) -> tuple[str, object]:
    """The import files under their own names, and beside each, in turn, one that is no .csv, holds a NUL byte, is too
    large or is empty; (folder, the list of what was uploaded)."""
    files = import_files(spark, sf).select("file", F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("k"))
    turn = F.col("k") % 4
    name = F.concat(F.element_at(F.array(F.lit("notes-"), F.lit("binary-"), F.lit("large-"), F.lit("empty-")), turn + 1), "k", F.when(turn == 0, ".txt").otherwise(".csv"))
    content = F.when(turn == 0, "no table").when(turn == 1, "first_name\0,last_name").when(turn == 2, F.repeat(F.lit("first_name,last_name;"), csvio.MAX_BYTES // 20))
    planted = files.select(name.alias("file"), content.alias("line"))
    path = staging_path(spark, f"uploads-{uuid.uuid4().hex[:12]}")
    planted.filter(F.col("line").isNotNull()).repartition("file").write.mode("overwrite").partitionBy("file").text(path + "/planted")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    to = jvm.Path(path + "/files")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(to)
    for staged in (_stage_import_csv(spark, sf), path + "/planted"):
        for folder in fs.globStatus(jvm.Path(staged + "/file=*")):  # one part file each
            part = fs.globStatus(jvm.Path(folder.getPath(), "part-*"))[0].getPath()
            fs.rename(part, jvm.Path(to, folder.getPath().getName().removeprefix("file=")))
    listed = files.select("file").unionByName(planted.select("file"))
    return path + "/files", listed.select(F.concat(F.lit(fs.makeQualified(to).toString() + "/"), "file").alias("path"))


def q_csv_intake_screen(spark, sf):
    path, uploads = _stage_uploads(spark, sf)
    return csvio.intake_screen(spark, path, expected=uploads).select(F.element_at(F.split("file", "/"), -1).alias("file"), "ok", "reason")


def q_unnest_rows(spark, sf):
    """Parallel arrays (one per column, as an import chunk sends them) back to rows."""
    rows = import_rows(spark, sf, load_model(spark, sf).contacts)
    chunk = rows.groupBy("file", F.floor((F.col("row_number") - 1) / 500).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("row_number", F.col("cells")[0].alias("c0"), F.col("cells")[2].alias("c2")))).alias("s"))
    arrays = chunk.select("file", "chunk", F.transform("s", lambda x: x["row_number"]).alias("ns"),
                          F.transform("s", lambda x: x["c0"]).alias("firsts"), F.transform("s", lambda x: x["c2"]).alias("emails"))
    return G.rows_from_arrays(arrays, ["file"], ["ns", "firsts", "emails"]).select(
        "file", F.col("ns").alias("row_number"), F.col("firsts").alias("first_cell"), F.col("emails").alias("third_cell"))


def q_synthetic_contacts(spark, sf):
    n = raw(spark, sf, "customer").count()  # scale the generator with the data
    return G.synthetic_contacts(spark, n, seed=7).select("id", "account_id", "first_name", "last_name", "email", "phone", "company", "created_at")


def q_json_payload(spark, sf):
    a = load_model(spark, sf).activity
    built = json_object(F.struct(F.col("type").alias("type"), F.get_json_object("payload", "$.k").cast("int").alias("k"),
                                 F.lit(None).cast("string").alias("note")))
    return a.select("id", built.alias("payload"), json_path("payload", "$.k").alias("k"))


def q_activity_append(spark, sf):
    """Append activity in three batches, one of them twice, and read the table back."""
    a = load_model(spark, sf).activity
    path = staging_path(spark, f"activity-{uuid.uuid4().hex[:12]}")
    for batch in (0, 1, 2, 1):
        G.append_activity(a.filter(F.col("id") % 3 == batch), path, f"b{batch}")
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "export_csv": q_export_csv,
    "csv_scan": q_csv_scan,
    "csv_intake_screen": q_csv_intake_screen,
    "unnest_rows": q_unnest_rows,
    "synthetic_contacts": q_synthetic_contacts,
    "json_payload": q_json_payload,
    "activity_append": q_activity_append,
}


def _cell(x: str) -> str:
    safe = (f"CASE WHEN regexp_matches({x}, '^[=@\\t\\r]') OR (regexp_matches({x}, '^[+-]') "
            f"AND NOT regexp_full_match(substr({x}, 2), '[\\d\\s().-]*')) THEN '''' || {x} ELSE {x} END")
    return f"(CASE WHEN regexp_matches({safe}, '[\",\\r\\n]') THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' ELSE {safe} END)"


ORACLE = {
    "export_csv": with_fixtures(f"""
        SELECT account_id, CAST(0 AS BIGINT) AS pos, chr(65279) || 'first_name,last_name,email,phone,company,tags' AS line
        FROM (SELECT DISTINCT account_id FROM contacts WHERE deleted_at IS NULL)
        UNION ALL
        SELECT c.account_id, CAST(c.pos AS BIGINT),
               {_cell("c.first_name")} || ',' || {_cell("c.last_name")} || ',' || {_cell("coalesce(c.email, '')")} || ',' ||
               {_cell("coalesce(c.phone, '')")} || ',' || {_cell("coalesce(c.company, '')")} || ',' || {_cell("coalesce(t.tags, '')")}
        FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, id DESC) AS pos
              FROM contacts WHERE deleted_at IS NULL) c
        LEFT JOIN (SELECT ct.contact_id, string_agg(tg.name, ';' ORDER BY lower(tg.name), tg.id) AS tags
                   FROM contact_tags ct JOIN tags tg ON tg.id = ct.tag_id GROUP BY 1) t ON t.contact_id = c.id
        WHERE c.pos <= 50000"""),
    "json_payload": with_fixtures("""
        SELECT id, json_object('type', type, 'k', CAST(json_extract_string(payload, '$.k') AS INTEGER), 'note', NULL)::VARCHAR AS payload,
               json_extract_string(payload, '$.k') AS k
        FROM contact_activity"""),
    "activity_append": with_fixtures("""
        SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM contact_activity GROUP BY 1"""),
}


def _import_sql(body: str) -> str:
    from rolodeck.plans.import_plans import _imp

    return _imp(body)


ORACLE["unnest_rows"] = _import_sql("SELECT file, row_number, cells[1] AS first_cell, cells[3] AS third_cell FROM import_rows")
ORACLE["csv_intake_screen"] = _import_sql("""
    SELECT file, true AS ok, CAST(NULL AS VARCHAR) AS reason FROM import_files
    UNION ALL
    SELECT CASE k % 4 WHEN 0 THEN 'notes-' || k || '.txt' WHEN 1 THEN 'binary-' || k || '.csv' WHEN 2 THEN 'large-' || k || '.csv' ELSE 'empty-' || k || '.csv' END, false,
           CASE k % 4 WHEN 0 THEN 'Upload a .csv file' WHEN 1 THEN 'This does not look like a text CSV file' WHEN 2 THEN 'File too large' ELSE 'The file is empty' END
    FROM (SELECT CAST(regexp_extract(file, '[0-9]+') AS INTEGER) AS k FROM import_files)""")
ORACLE["csv_scan"] = _import_sql("""
    SELECT file, CAST(1 AS INTEGER) AS record_no, len(header) AS n_cells, array_to_string(header, '|') AS cells, false AS too_long
    FROM import_files
    UNION ALL
    SELECT file, CAST(row_number + 1 AS INTEGER), len(cells), array_to_string(cells, '|'), false FROM import_rows""")


def q_csv_row_numbers(spark, sf):
    """1-based data row numbers per file, in file order."""
    path = _stage_import_csv(spark, sf)
    rec = csvio.read_csv_records(spark, path + "/*/*.txt").filter(F.col("record_no") > 1)
    return rec.select(F.regexp_extract("file", r"file=([^/]+)/", 1).alias("file"), (F.col("record_no") - 1).cast("long").alias("row_number"),
                      F.get(F.col("cells"), 0).alias("first_cell"))


QUERIES["csv_row_numbers"] = q_csv_row_numbers
ORACLE["csv_row_numbers"] = _import_sql("SELECT file, row_number, cells[1] AS first_cell FROM import_rows")
