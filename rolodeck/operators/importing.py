"""Bulk CSV import as Spark jobs.

Inputs are parsed file rows ``(file, job_id, account_id, mode, row_number,
cells array<string>)`` and one header row per file ``(file, job_id,
account_id, mode, filename, header array<string>)``. Validation is a
projection of built-in expressions over each row; the file-level checks
(duplicates in the file, e-mails already in the table) are a grouped
aggregate plus joins keyed by (file, e-mail) or (account, e-mail).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolodeck.functions.csvcells import csv_line_from_array
from rolodeck.functions.text import js_trim, normalize_header, split_tags
from rolodeck.functions.validators import is_email, is_phone
from rolodeck.functions.jsonpayload import json_object
from rolodeck.operators import predicates as P
from rolodeck.session import checkpoint_dir
from rolodeck.sources.contacts import with_generated_columns
from rolodeck.sources.staged import Staged

# Canonical columns, header aliases, labels, limits, messages.
COLUMNS = ["first_name", "last_name", "email", "phone", "company", "tags"]
ALIASES = {
    "first_name": "first_name", "firstname": "first_name", "given_name": "first_name",
    "last_name": "last_name", "lastname": "last_name", "surname": "last_name", "family_name": "last_name",
    "email": "email", "email_address": "email", "e_mail": "email",
    "phone": "phone", "phone_number": "phone", "mobile": "phone",
    "company": "company", "company_name": "company", "organization": "company",
    "tags": "tags", "tag": "tags",
}
LABELS = {"first_name": "First name", "last_name": "Last name", "phone": "Phone", "company": "Company"}
REQUIRED = {"create": ["first_name", "last_name"], "update": ["email"]}
CLEAR_TOKEN = "[clear]"
MAX_TAGS = 20
NAME_MAX, COMPANY_MAX, TAG_MAX = 100, 150, 50
MAX_ROWS = 50_000
CHUNK_SIZE = 500

ERR_T = "array<struct<field:string,message:string>>"


def _empty_errors() -> Column:
    return F.array().cast(ERR_T)


def _err(field: str, message) -> Column:
    msg = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(field).alias("field"), msg.alias("message"))


def _errs(*pairs: tuple[Column, Column]) -> Column:
    """Ordered errors: keep each error whose condition holds."""
    return F.filter(
        F.array(*[F.when(cond, e) for cond, e in pairs]).cast(ERR_T), lambda x: x.isNotNull()
    )


# ---------------------------------------------------------------- S4 header map


def alias_map() -> Column:
    """The 18 header aliases as a literal map (normalised name → column)."""
    return F.create_map(*[F.lit(x) for kv in sorted(ALIASES.items()) for x in kv])


def header_map(files: DataFrame) -> DataFrame:
    """Per file, column → cell index, the ignored header names (in file
    order) and the first header problem, if any.

    Each file's header is one array, so this is a projection with
    higher-order functions over that array: no explode, join or shuffle.
    """
    aliases = alias_map()
    n = F.size("header")
    cols = F.transform("header", lambda h: F.try_element_at(aliases, normalize_header(h)))
    positions = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def earlier(c: Column, i: Column) -> Column:
        # null-safe: unmapped header cells are null and must not make the test unknown
        return F.exists(F.slice("_cols", 1, F.greatest(i, F.lit(1))), lambda x: x.eqNullSafe(c)) & (i > 0)

    with_cols = files.select("file", "mode", "header", F.when(n > 0, cols).otherwise(F.array().cast("array<string>")).alias("_cols"))
    pos = F.when(F.size("_cols") > 0, positions).otherwise(F.array().cast("array<int>"))
    first_seen = F.filter(pos, lambda i: F.get(F.col("_cols"), i).isNotNull() & ~earlier(F.get(F.col("_cols"), i), i))
    repeats = F.filter(pos, lambda i: F.get(F.col("_cols"), i).isNotNull() & earlier(F.get(F.col("_cols"), i), i))
    index = F.map_from_entries(F.transform(first_seen, lambda i: F.struct(F.get(F.col("_cols"), i).alias("column"), i.alias("pos"))))
    ignored = F.filter(F.transform(pos, lambda i: F.when(F.get(F.col("_cols"), i).isNull() & (js_trim(F.get(F.col("header"), i)) != ""),
                                                         js_trim(F.get(F.col("header"), i)))), lambda x: x.isNotNull())
    dup = F.get(F.col("_cols"), F.get(repeats, 0))
    agg = with_cols.select("file", "mode", index.alias("index"), ignored.alias("ignored"), dup.alias("_dup"))
    idx = F.col("index")

    def missing(mode: str) -> Column:
        req = REQUIRED[mode]
        lst = F.filter(F.array(*[F.lit(c) for c in req]), lambda c: ~F.array_contains(F.map_keys(idx), c))
        return lst

    miss = F.when(F.col("mode") == "create", missing("create")).otherwise(missing("update"))
    problem = (
        F.when(F.col("_dup").isNotNull(), F.concat(F.lit('The column "'), F.col("_dup"), F.lit('" appears twice in the header')))
        .when(F.size(miss) > 0, F.concat(F.when(F.size(miss) > 1, F.lit("Missing required columns: ")).otherwise(F.lit("Missing required column: ")),
                                         F.array_join(miss, ", ")))
        .when((F.col("mode") == "update") & (F.size(F.map_keys(idx)) < 2),
              F.lit("An update file needs the email column plus at least one column to change"))
    )
    return agg.select("file", "index", "ignored", problem.alias("problem"))


# ---------------------------------------------------------------- S5 file failures


def file_failures(files: DataFrame, rows: DataFrame, headers: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """File-level reason the file cannot be used, in the reference's check
    order: invalid CSV → empty → too many rows → header only → bad header."""
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("invalid")).alias("bad"))
    j = files.select("file", "header", F.coalesce(F.col("invalid"), F.lit(False)).alias("hbad")).join(counts, "file", "left").join(
        headers.select("file", "problem"), "file", "left"
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    reason = (
        F.when(F.col("hbad") | (F.coalesce(F.col("bad"), F.lit(0)) > 0), F.lit("The file is not valid CSV (unterminated quoted field)"))
        .when(F.col("header").isNull(), F.lit("The file is empty"))
        .when(n > max_rows, F.concat(F.lit("The file has "), F.format_number(n, 0), F.lit(f"; the limit is {max_rows:,}")))
        .when(n == 0, F.lit("The file has a header but no data rows"))
        .otherwise(F.col("problem"))
    )
    return j.select("file", reason.alias("reason"))


# ---------------------------------------------------------------- I1 / I2 row validation


def _cell_expr(c: str) -> Column:
    """Trimmed cell of a mapped column ('' past the end of a short row), or null
    when the column is not in the file."""
    i = F.try_element_at(F.col("index"), F.lit(c))
    return F.when(i.isNotNull(), js_trim(F.coalesce(F.get(F.col("cells"), i), F.lit(""))))


def _cell(c: str) -> Column:
    """The projected cell (see ``validate_rows``: cells are computed once)."""
    return F.col(f"_c_{c}")


def _pick(mode: str, c: str, required: bool = False, clearable: bool = False):
    """(present, value, error) for one field, as the reference's ``pick``."""
    raw = _cell(c)
    label = LABELS[c]
    if mode == "create":
        present = raw.isNotNull()
        value = F.when(raw != "", raw)
        err = (raw == "") if required else F.lit(False)
        return present, value, (err, _err(c, f"{label} is required"))
    is_clear = F.lower(raw) == CLEAR_TOKEN
    present = raw.isNotNull() & (raw != "") & (F.lit(clearable) | ~is_clear)
    value = F.when(~is_clear, raw)
    err = (raw != "") & is_clear & F.lit(not clearable)
    return present, value, (err, _err(c, f"{label} can't be cleared"))


def validate_rows(rows: DataFrame, headers: DataFrame, mode: str) -> DataFrame:
    """I1 (create) / I2 (update): values with presence flags and ordered errors.

    Output: file, job_id, account_id, row_number, cells, ``v`` (struct of
    first_name, last_name, email, phone, company, tags and ``*_set`` flags)
    and ``errors`` array<struct<field,message>>.
    """
    r = rows.filter(F.col("mode") == mode).join(headers.select("file", "index"), "file")
    # project every cell once; later expressions refer to these columns
    r = r.select("*", *[_cell_expr(c).alias(f"_c_{c}") for c in COLUMNS])
    r = r.withColumn("_email_ok", is_email(F.col("_c_email")))
    f_set, f_val, f_req = _pick(mode, "first_name", required=True)
    l_set, l_val, l_req = _pick(mode, "last_name", required=True)
    p_set, p_val, p_clr = _pick(mode, "phone", clearable=True)
    c_set, c_val, c_clr = _pick(mode, "company", clearable=True)

    raw_email = _cell("email")
    email_ok = F.col("_email_ok")
    email_val = F.when((raw_email != "") & email_ok, F.lower(raw_email))
    email_set = raw_email.isNotNull() & ((raw_email == "") | email_ok)
    email_errs = [
        ((raw_email == "") & F.lit(mode == "update"), _err("email", "Email is required to find the contact")),
        ((raw_email != "") & ~email_ok, _err("email", "Not a valid email address")),
    ]

    raw_tags = _cell("tags")
    tags_given = raw_tags.isNotNull() & (raw_tags != "")
    tags_clear = tags_given & F.lit(mode == "update") & (F.lower(raw_tags) == CLEAR_TOKEN)
    parts = F.when(tags_given & ~tags_clear, split_tags(raw_tags)).otherwise(F.array().cast("array<string>"))
    tag_err = F.filter(
        F.transform(
            parts,
            lambda t: F.when(F.length(t) > TAG_MAX, _err("tags", F.concat(F.lit('Tag "'), F.substring(t, 1, 20), F.lit(f'…" is longer than {TAG_MAX} characters'))))
            .when(F.contains(t, F.lit(",")), _err("tags", F.concat(F.lit('Tag "'), t, F.lit('" cannot contain commas')))),
        ),
        lambda x: x.isNotNull(),
    )
    good = F.filter(parts, lambda t: (F.length(t) <= TAG_MAX) & ~F.contains(t, F.lit(",")))
    # W3 within a row: the first spelling of a tag wins (case-insensitive)
    kept = F.aggregate(
        good,
        F.array().cast("array<string>"),
        lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t))),
    )

    v = r.withColumn("_parts", parts).withColumn("_kept", kept)
    parts = F.col("_parts")
    errors = F.concat(
        _errs(
            f_req,
            (f_val.isNotNull() & (F.length(f_val) > NAME_MAX), _err("first_name", f"First name is limited to {NAME_MAX} characters")),
            l_req,
            (l_val.isNotNull() & (F.length(l_val) > NAME_MAX), _err("last_name", f"Last name is limited to {NAME_MAX} characters")),
            *email_errs,
            p_clr,
            (p_set & p_val.isNotNull() & ~is_phone(p_val), _err("phone", "Phone must be 7 to 15 digits")),
            c_clr,
            (c_set & c_val.isNotNull() & (F.length(c_val) > COMPANY_MAX), _err("company", f"Company is limited to {COMPANY_MAX} characters")),
            (tags_clear, _err("tags", "Import only adds tags; remove tags in the app")),
        ),
        tag_err,
        _errs((F.size(F.col("_kept")) > MAX_TAGS, _err("tags", f"A contact can get at most {MAX_TAGS} tags per row"))),
    )
    values = F.struct(
        f_set.alias("first_name_set"), F.when(f_set, f_val).alias("first_name"),
        l_set.alias("last_name_set"), F.when(l_set, l_val).alias("last_name"),
        email_set.alias("email_set"), email_val.alias("email"),
        p_set.alias("phone_set"), F.when(p_set, p_val).alias("phone"),
        c_set.alias("company_set"), F.when(c_set, c_val).alias("company"),
        F.col("_kept").alias("tags"),
    )
    return v.select("file", "job_id", "account_id", "mode", "row_number", "cells", values.alias("v"), errors.alias("errors"))


# ---------------------------------------------------------------- W1 / J6 / I3


def file_duplicates(validated: DataFrame) -> DataFrame:
    """Rows whose (valid) e-mail already appeared on an earlier row of the
    same file, with that first row. A grouped min per (file, e-mail) joined
    back — no window holding a whole file or a hot e-mail in one task."""
    keyed = validated.filter(F.col("v.email").isNotNull()).select("file", F.col("v.email").alias("email"), "row_number")
    first = keyed.groupBy("file", "email").agg(F.min("row_number").alias("first_row"))
    return keyed.join(first, ["file", "email"]).filter(F.col("row_number") > F.col("first_row")).select("file", "row_number", "first_row")


def email_lookup(contacts: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each (account, e-mail) asked for, the active owner's name and
    whether a trashed contact has it. Contacts are first semi-joined to the
    asked keys, so only matching rows are aggregated."""
    keys = candidates.select("account_id", "email").distinct()
    hits = contacts.filter(F.col("email").isNotNull()).join(keys, ["account_id", "email"], "left_semi")
    return hits.groupBy("account_id", "email").agg(
        F.max(F.when(P.is_active(), F.concat_ws(" ", "first_name", "last_name"))).alias("active_name"),
        F.bool_or(P.is_trashed()).alias("trashed"),
    )


def check_existing(validated_with_dups: DataFrame, contacts: DataFrame) -> DataFrame:
    """Only rows still clean are checked against the table: create → the
    e-mail is used by an active contact; update → no active contact has it
    (or only a trashed one)."""
    clean = validated_with_dups.filter((F.size("errors") == 0) & F.col("v.email").isNotNull()).select(
        "file", "mode", "account_id", F.col("v.email").alias("email"), "row_number"
    )
    known = email_lookup(contacts, clean)
    j = clean.join(known, ["account_id", "email"], "left")
    msg = (
        F.when((F.col("mode") == "create") & F.col("active_name").isNotNull(), F.concat(F.lit("Already used by "), F.col("active_name")))
        .when((F.col("mode") == "update") & F.col("active_name").isNull() & F.coalesce(F.col("trashed"), F.lit(False)), F.lit("This contact is in the trash"))
        .when((F.col("mode") == "update") & F.col("active_name").isNull(), F.lit("No contact has this email"))
    )
    return j.filter(msg.isNotNull()).select("file", "row_number", msg.alias("message"))


def review(rows: DataFrame, files: DataFrame, contacts: DataFrame, written: list[Staged] | None = None) -> DataFrame:
    """The whole validation (I1/I2 → W1 → I3): every data row with its full
    ordered error list. A file that fails as a whole (S5) has no reviewed
    rows, so nothing of it is ever applied.

    The rows, what they validate to and the duplicates are each read several
    times, so they are written once; ``written`` takes these tables, for a
    caller that drops them when it has read the review."""
    written = [] if written is None else written

    def once(df: DataFrame, name: str) -> DataFrame:
        written.append(Staged(df, name))
        return written[-1].df

    # dealt anew, as a parsed file is one task and validating is more work than the size of its rows shows
    rows = once(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "row_number"), "import-rows")
    headers = once(header_map(files), "import-headers")
    # one row a file, of a size the planner knows: the rows meet it where they lie, not dealt by file, where one file is one task
    usable = once(headers.join(file_failures(files, rows, headers).filter(F.col("reason").isNull()).select("file"), "file"), "import-usable")
    v = once(validate_rows(rows, usable, "create").unionByName(validate_rows(rows, usable, "update")), "import-validated")
    dups = once(file_duplicates(v), "import-duplicates")
    v = v.join(dups, ["file", "row_number"], "left").withColumn(
        "errors",
        F.concat("errors", F.when(F.col("first_row").isNotNull(),
                                  F.array(_err("email", F.concat(F.lit("Duplicate of row "), F.col("first_row").cast("string"), F.lit(" in this file"))))
                                  ).otherwise(_empty_errors())),
    ).drop("first_row")
    existing = check_existing(v, contacts)
    return v.join(existing, ["file", "row_number"], "left").withColumn(
        "errors", F.concat("errors", F.when(F.col("message").isNotNull(), F.array(_err("email", F.col("message")))).otherwise(_empty_errors()))
    ).drop("message")


# ---------------------------------------------------------------- I4 / A15 / A16 / A20 / S7


def import_errors(reviewed: DataFrame, phase: str = "validate") -> DataFrame:
    """I4: one row per problem, in row order then discovery order."""
    return reviewed.select("file", "job_id", "row_number", "cells", F.posexplode("errors").alias("pos", "e")).select(
        "file", "job_id", "row_number", "pos", F.lit(phase).alias("phase"), F.col("e.field").alias("field"),
        F.col("e.message").alias("message"), F.col("cells").alias("row_data"),
    )


def error_reasons(errors: DataFrame) -> DataFrame:
    """Per rejected row, ``field: message`` joined by '; ' in error order."""
    return errors.groupBy("file", "row_number").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("phase") != "validate", "pos", "field", "message"))),
                lambda s: F.concat(F.coalesce(F.concat(s["field"], F.lit(": ")), F.lit("")), s["message"]),
            ),
            "; ",
        ).alias("reasons"),
        F.first("row_data").alias("row_data"),
    )


def error_rows_distinct(errors: DataFrame) -> DataFrame:
    """Distinct rejected rows per file and phase."""
    return errors.groupBy("file", "phase").agg(F.count_distinct("row_number").alias("n"))


def error_page(errors: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Per file, errors ordered by (row, discovery order), ``limit`` (1–500)
    rows after ``offset``, with the file's total. The window runs per file,
    whose errors are bounded by the import row limit."""
    limit = min(max(limit, 1), 500)
    w = Window.partitionBy("file").orderBy("row_number", F.col("phase") != "validate", "pos")
    ranked = errors.withColumn("_k", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("file")))
    return ranked.filter((F.col("_k") > offset) & (F.col("_k") <= offset + limit)).select(
        "file", F.col("_k").alias("k"), F.col("row_number").alias("row"), "phase", "field", "message", "total")


def job_summary(reviewed: DataFrame, files: DataFrame, rows: DataFrame) -> DataFrame:
    """Per file: totals, notes, status ('ready' / 'failed'), failure
    reason and whether there is anything to import."""
    headers = header_map(files)
    fails = file_failures(files, rows, headers)
    counts = reviewed.groupBy("file").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.size("errors") > 0).alias("error_rows")
    )
    j = files.select("file", "job_id", "account_id", "mode").join(headers.select("file", "ignored"), "file", "left").join(
        fails, "file", "left").join(counts, "file", "left")
    total = F.coalesce(F.col("total_rows"), F.lit(0))
    errs = F.coalesce(F.col("error_rows"), F.lit(0))
    failed = F.col("reason").isNotNull()
    notes = F.when(~failed & (F.size(F.coalesce(F.col("ignored"), F.array())) > 0),
                   F.concat(F.lit("Ignored columns: "), F.array_join("ignored", ", "))).otherwise(F.lit(""))
    return j.select(
        "file", "job_id", "account_id", "mode",
        F.when(failed, F.lit(0)).otherwise(total).cast("long").alias("total_rows"),
        F.when(failed, F.lit(0)).otherwise(total - errs).cast("long").alias("valid_rows"),
        F.when(failed, F.lit(0)).otherwise(errs).cast("long").alias("error_rows"),
        notes.alias("notes"),
        F.when(failed, "failed").otherwise("ready").alias("status"),
        F.col("reason").alias("failure_reason"),
        F.when(failed, F.lit(None)).when(total - errs > 0, "importable").otherwise("NOTHING_TO_IMPORT").alias("verdict"),
    )


def rejected_rows_csv(errors: DataFrame, files: DataFrame) -> DataFrame:
    """The rejected rows as uploaded plus an ``error`` column: header and
    rows padded to the widest row of the file; one CSV line per output row
    (``line_no`` 0 is the header)."""
    reasons = error_reasons(errors)
    width = reasons.groupBy("file").agg(F.max(F.size("row_data")).alias("_w"))
    hdr = files.select("file", "header").join(width, "file")
    hw = F.greatest(F.size("header"), F.col("_w"))

    def padded(arr: Column, w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), w - 1), lambda i: F.coalesce(F.get(arr, i), F.lit("")))

    head = hdr.select("file", F.lit(0).cast("long").alias("line_no"),
                      csv_line_from_array(F.concat(padded(F.col("header"), hw), F.array(F.lit("error")))).alias("line"), hw.alias("_hw"))
    body = reasons.join(head.select("file", "_hw"), "file").select(
        "file", F.col("row_number").cast("long").alias("line_no"),
        csv_line_from_array(F.concat(padded(F.col("row_data"), F.col("_hw")), F.array(F.col("reasons")))).alias("line"),
    )
    return head.drop("_hw").unionByName(body)


def chunk_progress(reviewed: DataFrame, chunk: int = CHUNK_SIZE) -> DataFrame:
    """Rows per chunk of ``chunk`` and the processed count after each
    chunk (window over the per-chunk counts only)."""
    per = reviewed.groupBy("file", F.floor((F.col("row_number") - 1) / chunk).cast("long").alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") == 0).alias("valid")
    )
    w = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("processed", F.sum("rows").over(w))


# ---------------------------------------------------------------- apply: J13, M9, I5, I6, I7


def exclude_rejected(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Skip rows rejected in review."""
    rej = errors.filter(F.col("phase") == "validate").select("file", "row_number").distinct()
    return rows.join(rej, ["file", "row_number"], "left_anti")


def new_contact_id(job: Column, row: Column) -> Column:
    """Deterministic id for an imported contact (negative, so never equal to a
    source id; unique for files below one million rows)."""
    return -(job.cast("long") * 1_000_000 + row.cast("long"))


def ensure_tags(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """M9 (+W3 across rows): resolve (account, name, order) to tags; an
    existing tag (case-insensitive) keeps its id and casing, a new one takes
    the first spelling by order. Returns account_id, key, tag_id, name, is_new."""
    firsts = wanted.groupBy("account_id", F.lower("name").alias("key")).agg(F.min_by("name", "order").alias("first_name"))
    have = tags.select("account_id", F.lower("name").alias("key"), F.col("id").cast("long").alias("tag_id"), F.col("name").alias("have_name"))
    j = firsts.join(have, ["account_id", "key"], "left")
    return j.select(
        "account_id", "key",
        F.coalesce(F.col("tag_id"), F.xxhash64(F.col("account_id"), F.col("key"))).alias("tag_id"),
        F.coalesce(F.col("have_name"), F.col("first_name")).alias("name"),
        F.col("tag_id").isNull().alias("is_new"),
    )


def _tag_wants(valid: DataFrame) -> DataFrame:
    return valid.select("file", "account_id", "job_id", "row_number", "contact_id", F.posexplode("v.tags").alias("tpos", "name")).withColumn(
        "order", F.struct("job_id", "row_number", "tpos"))


def apply_create(reviewed: DataFrame, contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame,
                 as_of: dt.datetime) -> dict[str, DataFrame]:
    """Insert accepted rows of create files. A row whose e-mail an active
    contact took since review becomes a phase-``import`` error; the rest go
    on. Returns new_contacts, new_tags, new_links, activity, errors."""
    ok = reviewed.filter((F.col("mode") == "create") & (F.size("errors") == 0))
    taken = contacts.filter(P.is_active() & F.col("email").isNotNull()).select("account_id", F.col("email").alias("_e"))
    # rows without an e-mail get a unique key, so they spread over partitions instead of sharing the null one
    keyed = ok.withColumn("_e", F.col("v.email")).withColumn(
        "_ek", P.spread_nulls(F.col("_e"), F.concat_ws(":", F.col("job_id"), F.col("row_number"))))
    taken_k = taken.withColumnRenamed("_e", "_ek").distinct().withColumn("_taken", F.lit(True))
    # rows of several create jobs may claim one new e-mail: as when the jobs run one
    # after another, the first (job_id, row_number) creates the contact and the
    # later ones find it taken. An e-mail appears at most once per file (W1), so
    # the window holds at most one row per job. (Whether a key is taken depends on
    # the key only, so the window may run over taken keys too.)
    first = F.row_number().over(Window.partitionBy("account_id", "_ek").orderBy("job_id", "row_number"))
    # one join with the contacts, checkpointed: every output below reads it instead of re-joining
    checkpoint_dir(reviewed.sparkSession)
    judged = keyed.join(taken_k, ["account_id", "_ek"], "left").withColumn("_taken", F.coalesce(F.col("_taken"), F.lit(False))) \
        .withColumn("_k", first).checkpoint()
    lost = judged.filter(F.col("_taken") | (F.col("_k") > 1)).drop("_taken", "_k", "_ek")
    kept = judged.filter(~F.col("_taken") & (F.col("_k") == 1)).drop("_taken", "_k", "_ek") \
        .withColumn("contact_id", new_contact_id(F.col("job_id"), F.col("row_number")))
    ts = P.ts_lit(as_of)
    new_contacts = with_generated_columns(kept.select(
        F.col("contact_id").alias("id"), "account_id", F.col("v.first_name").alias("first_name"), F.col("v.last_name").alias("last_name"),
        F.col("v.email").alias("email"), F.col("v.phone").alias("phone"), F.col("v.company").alias("company"),
        F.lit(1).alias("version"), ts.alias("created_at"), ts.alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    ))
    wants = _tag_wants(kept)
    resolved = ensure_tags(tags, wants.select("account_id", "name", "order"))
    links = wants.withColumn("key", F.lower("name")).join(resolved.select("account_id", "key", "tag_id", F.col("name").alias("tag_name")), ["account_id", "key"])
    links = links.dropDuplicates(["contact_id", "tag_id"])
    created_ev = kept.select("account_id", "contact_id", F.lit("CONTACT_CREATED").alias("type"),
                             json_object(F.struct(F.col("job_id").cast("string").alias("import"))).alias("payload"), "row_number", F.lit(0).alias("tpos"), "job_id")
    tag_ev = links.select("account_id", "contact_id", F.lit("TAG_ADDED").alias("type"),
                          json_object(F.struct(F.struct(F.col("tag_id").alias("id"), F.col("tag_name").alias("name")).alias("tag"),
                                             F.col("job_id").cast("string").alias("import"))).alias("payload"), "row_number", (F.col("tpos") + 1).alias("tpos"), "job_id")
    activity = created_ev.unionByName(tag_ev).select(
        F.xxhash64(F.lit("import-activity"), "job_id", "row_number", "tpos").alias("id"), "account_id", "contact_id", "type", "payload", ts.alias("created_at"))
    errors = lost.select("file", "job_id", "row_number", F.lit(0).alias("pos"), F.lit("import").alias("phase"), F.lit("email").alias("field"),
                         F.lit("Already used by another contact").alias("message"), F.col("cells").alias("row_data"))
    return {
        "new_contacts": new_contacts,
        "new_tags": resolved.filter("is_new").select(F.col("tag_id").alias("id"), "account_id", "name", ts.alias("created_at")),
        "new_links": links.select("contact_id", "tag_id", ts.alias("created_at")),
        "activity": activity,
        "errors": errors,
        "outcomes": kept.select("file", "job_id", "row_number", F.lit("created").alias("outcome")),
    }


FIELDS = ["first_name", "last_name", "phone", "company"]
API_NAMES = {"first_name": "firstName", "last_name": "lastName", "phone": "phone", "company": "company"}


def changed_fields(old_prefix: str = "c.", set_prefix: str = "v.") -> Column:
    """F24 for import rows: {field: {from, to}} of present fields whose value
    differs (null-safe), keyed by the API field name, in field order."""
    entries = [
        F.when(F.col(f"{set_prefix}{f}_set") & ~F.col(f"{old_prefix}{f}").eqNullSafe(F.col(f"{set_prefix}{f}")),
               F.struct(F.lit(API_NAMES[f]).alias("key"),
                        F.struct(F.col(f"{old_prefix}{f}").alias("from"), F.col(f"{set_prefix}{f}").alias("to")).alias("value")))
        for f in FIELDS
    ]
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def apply_update(reviewed: DataFrame, contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame,
                 as_of: dt.datetime) -> dict[str, DataFrame]:
    """Match accepted rows of update files to active contacts by e-mail,
    change only present and differing fields (version + 1), add tags (never
    remove). ``updated`` when a field or a link changed, else ``unchanged``."""
    ok = reviewed.filter((F.col("mode") == "update") & (F.size("errors") == 0))
    active = contacts.filter(P.is_active() & F.col("email").isNotNull())
    cur = active.select(F.struct(*[F.col(c) for c in contacts.columns]).alias("c"), "account_id", F.col("email").alias("_e"))
    # one join with the contacts, checkpointed: every output below reads it instead of re-joining
    checkpoint_dir(reviewed.sparkSession)
    j = ok.withColumn("_e", F.col("v.email")).join(cur, ["account_id", "_e"], "left").checkpoint()
    missing = j.filter(F.col("c").isNull())
    # Several update jobs of a batch may touch one contact; as when the jobs run
    # one after another, each row is judged against the state the earlier rows
    # (job_id, row_number) left. An e-mail appears at most once per file (W1), so
    # these windows hold at most one row per job. They are keyed like the match
    # join, (account, e-mail) = one active contact, and reuse its partitioning.
    contact = Window.partitionBy("account_id", "_e")
    earlier = contact.orderBy("job_id", "row_number").rowsBetween(Window.unboundedPreceding, -1)
    upto = contact.orderBy("job_id", "row_number").rowsBetween(Window.unboundedPreceding, 0)

    def before(f: str) -> Column:
        last_set = F.last(F.when(F.col(f"v.{f}_set"), F.struct(F.col(f"v.{f}").alias("x"))), ignorenulls=True).over(earlier)
        return F.when(last_set.isNotNull(), last_set["x"]).otherwise(F.col(f"c.{f}"))

    matched = j.filter(F.col("c").isNotNull()).withColumn("contact_id", F.col("c.id")) \
        .withColumn("b", F.struct(*[before(f).alias(f) for f in FIELDS])).withColumn("_chg", changed_fields("b.", "v."))
    field_changed = F.size("_chg") > 0
    matched = matched.withColumn("_ver", F.col("c.version") + F.sum(field_changed.cast("int")).over(upto)) \
        .withColumn("_last_ver", F.col("c.version") + F.sum(field_changed.cast("int")).over(contact))
    ts = P.ts_lit(as_of)

    wants = _tag_wants(matched)
    resolved = ensure_tags(tags, wants.select("account_id", "name", "order"))
    links = wants.withColumn("key", F.lower("name")).join(resolved.select("account_id", "key", "tag_id", F.col("name").alias("tag_name")), ["account_id", "key"])
    existing = contact_tags.select("contact_id", F.col("tag_id").cast("long").alias("tag_id"))
    # a link wanted by several rows is added by the first of them (at most one row per job wants it)
    new_links = links.join(existing, ["contact_id", "tag_id"], "left_anti") \
        .withColumn("_k", F.row_number().over(Window.partitionBy("contact_id", "tag_id").orderBy("order"))).filter(F.col("_k") == 1).drop("_k")
    link_rows = new_links.groupBy("file", "row_number").agg(F.count(F.lit(1)).alias("_nl"))

    m = matched.join(link_rows, ["file", "row_number"], "left")
    touched = field_changed | (F.coalesce(F.col("_nl"), F.lit(0)) > 0)
    updated = m.filter(field_changed)

    def nv(f: str) -> Column:
        return F.when(F.col(f"v.{f}_set"), F.col(f"v.{f}")).otherwise(F.col(f"b.{f}"))

    # the contact's row after its last changing import row
    next_rows = with_generated_columns(updated.filter(F.col("_ver") == F.col("_last_ver")).select(
        F.col("c.id").alias("id"), "account_id", nv("first_name").alias("first_name"), nv("last_name").alias("last_name"),
        F.col("c.email").alias("email"), nv("phone").alias("phone"), nv("company").alias("company"),
        F.col("_ver").alias("version"), F.col("c.created_at").alias("created_at"), ts.alias("updated_at"),
        F.col("c.deleted_at").alias("deleted_at"),
    ))
    upd_ev = updated.select("account_id", "contact_id", F.lit("CONTACT_UPDATED").alias("type"), json_object(F.struct(
        F.map_from_entries("_chg").alias("changes"), F.col("_ver").alias("version"), F.col("job_id").cast("string").alias("import"))).alias("payload"),
        "job_id", "row_number", F.lit(0).alias("tpos"))
    tag_ev = new_links.select("account_id", "contact_id", F.lit("TAG_ADDED").alias("type"), json_object(F.struct(
        F.struct(F.col("tag_id").alias("id"), F.col("tag_name").alias("name")).alias("tag"), F.col("job_id").cast("string").alias("import"))).alias("payload"),
        "job_id", "row_number", (F.col("tpos") + 1).alias("tpos"))
    activity = upd_ev.unionByName(tag_ev).select(
        F.xxhash64(F.lit("import-activity"), "job_id", "row_number", "tpos").alias("id"), "account_id", "contact_id", "type", "payload", ts.alias("created_at"))
    errors = missing.select("file", "job_id", "row_number", F.lit(0).alias("pos"), F.lit("import").alias("phase"), F.lit("email").alias("field"),
                           F.lit("No contact has this email").alias("message"), F.col("cells").alias("row_data"))
    return {
        "updated_contacts": next_rows,
        "new_tags": resolved.filter("is_new").select(F.col("tag_id").alias("id"), "account_id", "name", ts.alias("created_at")),
        "new_links": new_links.select("contact_id", "tag_id", ts.alias("created_at")),
        "activity": activity,
        "errors": errors,
        "outcomes": m.select("file", "job_id", "row_number", F.when(touched, "updated").otherwise("unchanged").alias("outcome")),
    }


def import_counters(summary: DataFrame, outcomes: DataFrame, import_errors_df: DataFrame) -> DataFrame:
    """Per job after the import: processed, created, updated, unchanged,
    error rows (review rows + distinct import-phase rows), status completed."""
    o = outcomes.groupBy("file").agg(
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome") == "updated").alias("updated"),
        F.count_if(F.col("outcome") == "unchanged").alias("unchanged"),
    )
    e = import_errors_df.filter(F.col("phase") == "import").groupBy("file").agg(F.count_distinct("row_number").alias("_ie"))
    s = summary.filter(F.col("status") == "ready").join(o, "file", "left").join(e, "file", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return s.select(
        "file", "job_id", F.col("total_rows").alias("processed"), z("created").alias("created"), z("updated").alias("updated"),
        z("unchanged").alias("unchanged"), (F.col("error_rows") + z("_ie")).alias("error_rows"), F.lit("completed").alias("status"),
    )
