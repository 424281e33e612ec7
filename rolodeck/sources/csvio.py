"""CSV sources and sinks (S2 read, S3 intake screen, S6 export, S11-style writes).

Reading keeps every cell: a record is an array of as many cells as its text
has, so surplus cells survive (for the rejected-rows file) and there is no
column limit. Files of any size are read (``read_csv``): Spark splits a file at
line breaks, and whether a line begins inside a quoted cell follows from the
quotes before it, of its own split by a running count and of the splits before
by a prefix scan over a row per split. Lines between the same two record ends
are joined again, and row numbers are counted the same way.

Uploads for import are whole texts within the upload limit (``file_texts``,
``read_import_files``), as a file beyond it is refused unread.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolodeck.functions.csvcells import csv_line, csv_line_from_array
from rolodeck.operators import listing as L
from rolodeck.session import checkpoint_dir
from rolodeck.sources.staged import staged

# Fixed values
MAX_RECORD_CHARS = 20_000
MAX_BYTES = 5 * 1024 * 1024
EXPORT_CAP = 50_000
EXPORT_HEADER = ["first_name", "last_name", "email", "phone", "company", "tags"]
BOM = "\ufeff"


#: Marks of cell ends, record ends and quoted text, led by NUL, which a text file does not have (``intake_screen``).
_CELL, _RECORD, _QUOTED = "\0c", "\0r", "\0q"


def file_texts(spark: SparkSession, path: str | list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """(file, text): whole text of each file, one task per file. A file above ``max_bytes`` or with a NUL byte has a null
    text; the content of the former is not read."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length", "content")
    small = listed.filter(F.col("length") <= max_bytes).select(
        "file", F.when(~F.contains("content", F.lit(bytearray([0]))), F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    return small.unionByName(listed.filter(F.col("length") > max_bytes).select("file", F.lit(None).cast("string").alias("text")))


def _misplaced(x, i):
    return (i % 2 == 0) & (x != "") & (((i > 0) & ~x.rlike(r"\A[,\r\n]")) | ~x.rlike(r"[,\r\n]\z"))


def _marked(x, i):
    ends = F.regexp_replace(F.replace(x, F.lit(","), F.lit(_CELL)), "\r\n|\n|\r", _RECORD)
    return F.when(i % 2 == 1, F.concat(F.lit(_QUOTED), x)).when((x == "") & (i > 0), '"').otherwise(ends)


def _cut(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``invalid`` and ``records`` of a text: its records as the text stands between its record ends, cell ends marked.

    Cut at the quote characters, every second part of a text is quoted. The
    others hold the structure: their commas and line breaks end cells and
    records, and an empty one between two quoted parts is a doubled quote.
    ``invalid``: a quoted cell is not closed, or a quote stands inside an
    unquoted cell or is followed by more text. Linear in the text: the lambdas
    read nothing but their part (an outer column could be computed anew for
    each part once the optimizer has moved a filter), which the line break
    added at the end allows, as the last part is then like any other.
    """
    cut = df.withColumn("_parts", F.split(F.concat(text, F.lit("\n")), '"'))
    records = F.filter(F.split(F.array_join(F.transform("_parts", _marked), ""), _RECORD), lambda r: r != "")
    invalid = F.col("_parts").isNull() | (F.size("_parts") % 2 == 0) | (F.size(F.filter("_parts", _misplaced)) > 0)
    return cut.withColumn("invalid", invalid).withColumn("records", records).drop("_parts")


def parsed(texts: DataFrame) -> DataFrame:
    """(file, invalid, records) of whole texts (``_cut``)."""
    return _cut(texts, F.regexp_replace("text", "^\ufeff", "")).select("file", "invalid", "records")


def _parsed_segments(segments: DataFrame) -> DataFrame:
    """(file, split, id, invalid, records) of (file, split, id, text, bom)."""
    text = F.when(F.col("bom"), F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))
    return _cut(segments, text).select("file", "split", "id", "invalid", "records")


def _cells(record: str) -> Column:
    return F.transform(F.split(record, _CELL), lambda c: F.replace(c, F.lit(_QUOTED), F.lit("")))


def _too_long(cells: str) -> Column:
    return F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) > MAX_RECORD_CHARS


def _records(files: DataFrame) -> DataFrame:
    """(file, record_no, cells, too_long) of the files' parsed records."""
    # outer, as the filter that Spark infers for an inner explode would build the records twice
    rec = files.select("file", F.posexplode_outer("records").alias("_i", "_record")).filter(F.col("_record").isNotNull())
    rec = rec.select("file", (F.col("_i") + 1).alias("record_no"), _cells("_record").alias("cells"))
    return rec.withColumn("too_long", _too_long("cells"))


def _earlier(splits: DataFrame, value: Column, out: str) -> DataFrame:
    """Prefix scan over the splits of each file (a row a split): ``out`` = the sum of ``value`` over the splits before."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, id, line, quotes): lines in the order of (split, id); quotes in the split up to and with the line."""
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"),
        F.make_valid_utf8("value").alias("line"))
    so_far = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return text.withColumn("quotes", F.sum(own).over(so_far))


def _segments(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, split, id, text): lines joined to whole records, each where its first line is; (file, open, binary) of the files.

    A line that begins and ends outside quotes is a segment by itself; only the others are grouped, by file and by the
    number of segments that begin before.
    """
    outside = (F.col("quotes") % 2) == 0
    per_split = lines.groupBy("file", "split").agg(
        F.max("quotes").alias("in_split"), F.count_if(outside).alias("even"), F.count_if(~outside).alias("odd"), F.max(F.contains("line", F.lit("\0"))).alias("binary"))
    scanned = _earlier(per_split, F.col("in_split"), "before")
    # ends of records in the splits before: lines after which the number of quotes is even
    scanned = staged(_earlier(scanned, F.when(F.col("before") % 2 == 0, F.col("even")).otherwise(F.col("odd")), "ended_before"), "csv-splits")
    status = scanned.groupBy("file").agg((F.sum("in_split") % 2 == 1).alias("open"), F.max("binary").alias("binary"))
    in_order = Window.partitionBy("file", "split").orderBy("id")
    placed = lines.join(scanned.select("file", "split", "before", "ended_before"), ["file", "split"])
    after = (F.col("before") + F.col("quotes")) % 2 == 0  # the line ends outside quotes
    placed = placed.withColumn("ends", after).withColumn("begins", F.coalesce(F.lag("ends").over(in_order), F.col("before") % 2 == 0))
    ended = F.sum(F.col("ends").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ends").cast("long")
    placed = staged(placed.withColumn("segment", F.col("ended_before") + ended).select("file", "split", "id", "line", "begins", "ends", "segment"), "csv-lines")
    single = placed.filter("begins AND ends").select("file", "split", "id", F.col("line").alias("text"))
    parts = placed.filter("NOT (begins AND ends)").groupBy("file", "segment").agg(F.sum(F.length("line")).alias("size"), F.min(F.struct("split", "id")).alias("first"), F.array_sort(F.collect_list(F.struct("split", "id", "line"))).alias("lines"))
    joined = parts.select("file", "first.split", "first.id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    return single.unionByName(joined), status


def read_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """S2 for files of any size: (files, records).

    ``files``: (file, invalid) of each non-empty file; invalid if a quoted cell is not closed, a quote stands elsewhere, or
    the file holds a NUL byte (it then has no records). ``records``: (file, record_no, cells, too_long); record 1 is the header.
    A line up to the next line feed and a record are rows, of any size that a row may have.
    """
    segments, status = _segments(_lines(spark, path))
    first = F.struct("split", "id")
    heads = segments.groupBy("file").agg(F.min(first).alias("head"))
    named = segments.join(heads, "file").withColumn("bom", first == F.col("head"))
    made = staged(_parsed_segments(named), "csv-records")
    files = status.join(made.groupBy("file").agg(F.max("invalid").alias("misplaced")), "file", "left").select(
        "file", (F.col("open") | F.col("binary") | F.coalesce("misplaced", F.lit(False))).alias("invalid"), "binary")
    text = made.join(files.filter("NOT binary").select("file"), "file", "left_semi")
    counts = _earlier(text.groupBy("file", "split").agg(F.sum(F.size("records")).alias("n")), F.col("n"), "before")
    so_far = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = text.withColumn("_here", F.coalesce(F.sum(F.size("records")).over(so_far), F.lit(0))).join(counts.select("file", "split", "before"), ["file", "split"])
    rec = placed.select("file", (F.col("before") + F.col("_here")).alias("_n"), F.posexplode("records").alias("_i", "_record"))
    rec = rec.select("file", (F.col("_n") + F.col("_i") + 1).cast("int").alias("record_no"), _cells("_record").alias("cells"))
    return files.select("file", "invalid"), rec.withColumn("too_long", _too_long("cells"))


def read_csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record_no, cells, too_long) for every record of every file
    under ``path``; record 1 is the header. Blank lines are skipped; quotes,
    doubled quotes, embedded separators and line breaks of any kind (also
    mixed in a file) are handled. A record of more than ``MAX_RECORD_CHARS``
    characters is flagged ``too_long``."""
    return read_csv(spark, path)[1]


def read_import_files(spark: SparkSession, path: str | list[str], modes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2 + S5 inputs for the import pipeline: (files, rows) in the shape
    ``rolodeck.operators.importing`` expects. ``modes``: file, job_id,
    account_id, mode (one row per uploaded file). A file that is too large or
    binary is not parsed and comes back invalid. Files are parsed once, into
    the shared checkpoint folder, as the review reads the rows several times."""
    checkpoint_dir(spark)
    texts = parsed(file_texts(spark, path)).checkpoint()
    rec = _records(texts)
    header = rec.filter(F.col("record_no") == 1).select("file", F.col("cells").alias("header"), "too_long")
    files = modes.join(header, "file", "left").join(texts.select("file", "invalid"), "file", "left").select(
        "file", "job_id", "account_id", "mode", F.element_at(F.split("file", "/"), -1).alias("filename"), "header",
        (F.coalesce("invalid", F.lit(False)) | F.coalesce("too_long", F.lit(False))).alias("invalid"))
    rows = rec.filter(F.col("record_no") > 1).join(modes, "file").select(
        "file", "job_id", "account_id", "mode", (F.col("record_no") - 1).cast("long").alias("row_number"), "cells",
        F.col("too_long").alias("invalid"))
    return files, rows


def intake_screen(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, expected: DataFrame | None = None) -> DataFrame:
    """S3: refuse files that are not .csv, empty, too large or binary (NUL
    byte). The size filter is checked on file metadata before any content is
    read; only files within the limit are scanned for NUL bytes.

    Spark's file sources do not list zero-byte files; pass ``expected`` (a
    ``path`` column, e.g. from the upload/job table) to report those as empty.
    """
    meta = spark.read.format("binaryFile").load(path).select("path", "length")
    if expected is not None:
        meta = expected.select("path").join(meta, "path", "full").withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))
    nul = spark.read.format("binaryFile").load(path).filter(F.col("length") <= max_bytes).select(
        "path", F.contains(F.col("content"), F.lit(bytearray([0]))).alias("has_nul"))
    j = meta.join(nul, "path", "left")
    reason = (
        F.when(~F.col("path").rlike(r"(?i)\.csv$"), F.lit("Upload a .csv file"))
        .when(F.col("length") == 0, F.lit("The file is empty"))
        .when(F.col("length") > max_bytes, F.lit("File too large"))
        .when(F.coalesce("has_nul", F.lit(False)), F.lit("This does not look like a text CSV file"))
    )
    return j.select(F.col("path").alias("file"), reason.isNull().alias("ok"), reason.alias("reason"))


# ---------------------------------------------------------------- S6 export


def export_lines(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, q: L.ListQuery,
                 as_of: dt.datetime, cap: int = EXPORT_CAP) -> DataFrame:
    """The active contacts matching the list filters, in list order, at
    most ``cap`` per account, as formula-safe CSV lines; ``pos`` 0 is the
    header (with the BOM). Tags are joined after the cap."""
    q = L.ListQuery(**{**q.__dict__, "status": "active", "cursor": None, "limit": 1})
    sort = q.resolved_sort()
    df = L.list_filtered(contacts, tags, contact_tags, q, as_of)
    top = L.top_n_per_group(df, ["account_id"], L.sort_columns(sort, q.order), cap, out="pos", key="id", order_needs=[L.SORT_COLUMNS[sort]])
    tl = L.contact_tag_list(contact_tags, tags, top.select("id")).withColumnRenamed("contact_id", "id")
    row = F.struct(F.col("pos").cast("long").alias("pos"), csv_line([
        "first_name", "last_name", "email", "phone", "company",
        F.array_join(F.coalesce(F.transform("tags", lambda t: t["name"]), F.array().cast("array<string>")), ";")]).alias("line"))
    header = F.struct(F.lit(0).cast("long").alias("pos"),
                      F.concat(F.lit(BOM), csv_line_from_array(F.array(*[F.lit(h) for h in EXPORT_HEADER]))).alias("line"))
    # each account's first row also emits the header line, so no second pass over the ranked rows finds the accounts
    lines = top.join(tl, "id", "left").select(
        "account_id", F.explode(F.when(F.col("pos") == 1, F.array(header, row)).otherwise(F.array(row))).alias("l"))
    return lines.select("account_id", "l.pos", "l.line")


def write_export(lines: DataFrame, path: str) -> None:
    """Write one CSV file per account folder, lines in order, CRLF endings."""
    (lines.repartition("account_id").sortWithinPartitions("account_id", "pos")
     .select("account_id", "line").write.mode("overwrite").partitionBy("account_id")
     .option("lineSep", "\r\n").text(path))


def write_csv_lines(lines: DataFrame, path: str) -> None:
    """Write pre-built CSV lines (e.g. the rejected-rows file) with CRLF endings."""
    lines.select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)
