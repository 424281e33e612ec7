"""Parsed import files derived from the test tables (for the import pipeline).

Six files for each 150,000 part keys, so that no file outgrows the limits of
an upload (50,000 rows, 5 MB): of the first 150,000, rows are split by
``p_partkey % 6`` (data row number ``p_partkey div 6 + 1``), the next keys
make files 6–11 alike, and so on. Of each six, files 0–3 are create files, 4–5
update files; the file number's parity is the account. Cell values are chosen so that every
validation message occurs, and some rows re-use the e-mail of an existing
(derived) contact. The SQL twin is in ``rolodeck.plans.import_plans``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolodeck.sources.fixtures import raw

# The header of each file kind.
CREATE_HEADER = ["First Name", "LASTNAME", "E-mail", "Phone", "Company", "Tags", "Favourite colour"]
UPDATE_HEADER = ["email", "Company", "phone", "tags"]
N_FILES = 6
FILE_ROWS = 25_000
JOB_BASE = 9000


def _file_no():
    p = F.col("p_partkey")
    return (p % N_FILES + N_FILES * F.floor(p / (N_FILES * FILE_ROWS))).cast("int")


def _mode(file_no):
    return F.when(file_no % N_FILES < 4, "create").otherwise("update")


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw(spark, sf_dir, "part").select(_file_no().alias("file_no")).distinct()
    mode = _mode(F.col("file_no"))
    return p.select(
        F.concat(F.lit("import-"), F.col("file_no").cast("string"), F.lit(".csv")).alias("file"),
        (F.col("file_no") + JOB_BASE).cast("long").alias("job_id"),
        (F.col("file_no") % 2).cast("int").alias("account_id"),
        mode.alias("mode"),
        F.concat(F.lit("Import-"), F.col("file_no").cast("string"), F.lit(".CSV")).alias("filename"),
        F.when(mode == "create", F.array(*[F.lit(h) for h in CREATE_HEADER])).otherwise(F.array(*[F.lit(h) for h in UPDATE_HEADER])).alias("header"),
        F.lit(False).alias("invalid"),
    )


def import_rows(spark: SparkSession, sf_dir: str, contacts: DataFrame) -> DataFrame:
    """One parsed data row per ``part`` row: file, job_id, account_id, mode,
    row_number, cells (ragged rows included), invalid (always false here)."""
    part = raw(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    known = contacts.select(F.col("id").alias("_cid"), F.col("email").alias("known_email"))
    prior = contacts.select(F.col("id").alias("_pid"), F.col("email").alias("prior_email"))
    j = part.join(known.hint("merge"), part.p_partkey == known._cid, "left").join(prior.hint("merge"), part.p_partkey - N_FILES == prior._pid, "left")
    p = F.col("p_partkey")
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    last = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    fresh = F.lower(F.concat(first, F.lit("."), last, F.lit("."), p.cast("string"), F.lit("@import.test")))
    create_cells = F.array(
        F.when(p % 17 == 0, F.lit("")).otherwise(first),
        F.when(p % 29 == 0, F.repeat(F.lit("x"), 101)).otherwise(F.concat(F.lit(" "), last)),
        F.when(p % 11 == 0, F.lit("not-an-email"))
        .when(p % 13 == 0, F.lit(""))
        .when((p % 19 == 0) & F.col("known_email").isNotNull(), F.upper(F.col("known_email")))
        .when(p % 23 == 0, F.concat(F.lit("dup"), (p % 4).cast("string"), F.lit("@example.test")))
        .otherwise(fresh),
        F.when(p % 7 == 0, F.lit("12-34"))
        .when(p % 9 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("+1 555 "), F.lpad((p % 1000).cast("string"), 3, "0"), F.lit(" "), F.lpad((p % 10000).cast("string"), 4, "0"))),
        F.when(p % 31 == 0, F.repeat(F.lit("c"), 151)).otherwise(F.col("p_brand")),
        F.when(p % 37 == 0, F.lit("a,b;ok"))
        .when(p % 41 == 0, F.concat(F.repeat(F.lit("t"), 51), F.lit(";VIP")))
        .otherwise(F.concat(F.col("p_type"), F.lit("; "), F.lower(F.col("p_type")), F.lit(";VIP"))),
        F.lit("blue"),
    )
    # the cells stand once in the plan, so that the generated code stays small enough to be compiled
    n_cells = F.when((p % 47 == 0) & (p % 43 != 0), 3).otherwise(len(CREATE_HEADER))
    extra = F.when(p % 43 == 0, F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>"))
    create_cells = F.concat(F.slice(create_cells, F.lit(1), n_cells), extra)
    upd_email = (
        F.when(p % 11 == 0, F.concat(F.lit("nobody."), p.cast("string"), F.lit("@nowhere.test")))
        .when(p % 13 == 0, F.lit(""))
        .when((p % 23 == 0) & F.col("prior_email").isNotNull(), F.col("prior_email"))
        .otherwise(F.coalesce(F.col("known_email"), fresh))
    )
    update_cells = F.array(
        upd_email,
        F.when(p % 3 == 0, F.lit("[clear]")).when(p % 5 == 0, F.lit("")).otherwise(F.concat(F.col("p_brand"), F.lit(" Co"))),
        F.when(p % 4 == 0, F.lit("[CLEAR]")).when(p % 7 == 0, F.lit("abc")).otherwise(F.lit("")),
        F.when(p % 43 == 0, F.lit("[clear]")).otherwise(F.lit("imported")),
    )
    fno = _file_no()
    mode = _mode(fno)
    return j.select(
        F.concat(F.lit("import-"), fno.cast("string"), F.lit(".csv")).alias("file"),
        (fno + JOB_BASE).cast("long").alias("job_id"),
        (fno % 2).cast("int").alias("account_id"),
        mode.alias("mode"),
        (F.floor(p / N_FILES) % FILE_ROWS + 1).cast("long").alias("row_number"),
        F.when(mode == "create", create_cells).otherwise(update_cells).alias("cells"),
        F.lit(False).alias("invalid"),
    )
