"""Registered import-pipeline queries and their DuckDB oracles.

The DuckDB side re-derives the same import files from ``part`` and
re-implements the header mapping and row validation in SQL, so each Spark
operator is checked against an independent formulation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rolodeck.functions.text import JS_SPACE_CLASS
from rolodeck.functions.validators import EMAIL_PATTERN
from rolodeck.operators import importing as I
from rolodeck.operators import importjobs as J
from rolodeck.plans.oracle_fixtures import with_fixtures
from rolodeck.session import checkpoint_dir, staging_path
from rolodeck.sources.fixtures import AS_OF, load_model, raw
from rolodeck.sources.import_fixture import CREATE_HEADER, UPDATE_HEADER, import_files, import_rows


class _Run:
    """The inputs of one import run. The review is written once to the shared
    checkpoint folder (it is what the apply step reads back, as a stored
    review would be), so later steps read it instead of re-deriving it in
    every branch of the plan."""

    def __init__(self, spark, sf):
        checkpoint_dir(spark)
        self.m = load_model(spark, sf)
        self.files = import_files(spark, sf)
        self.rows = import_rows(spark, sf, self.m.contacts)
        self._reviewed = None

    def reviewed(self):
        if self._reviewed is None:
            written = []
            self._reviewed = I.review(self.rows, self.files, self.m.contacts, written).checkpoint()
            for table in written:
                table.drop()
        return self._reviewed


def _errtext(col):
    return F.array_join(F.transform(col, lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")


def _values(df, with_flags: bool):
    cols = [
        "file", "row_number",
        F.col("v.first_name").alias("first_name"), F.col("v.last_name").alias("last_name"), F.col("v.email").alias("email"),
        F.col("v.phone").alias("phone"), F.col("v.company").alias("company"), F.array_join("v.tags", ";").alias("tags"),
        _errtext(F.col("errors")).alias("errors"),
    ]
    if with_flags:
        cols += [F.col(f"v.{f}_set").alias(f"{f}_set") for f in ("first_name", "last_name", "email", "phone", "company")]
    return df.select(*cols)


def q_csv_header_map(spark, sf):
    r = _Run(spark, sf)
    h = I.header_map(r.files)
    return h.select(
        "file",
        F.array_join(F.transform(F.array_sort(F.map_entries("index")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("mapped"),
        F.array_join("ignored", ", ").alias("ignored"),
        "problem",
    )


def q_csv_file_failures(spark, sf):
    r = _Run(spark, sf)
    return I.file_failures(r.files, r.rows, I.header_map(r.files))


def _validated(spark, sf, mode):
    r = _Run(spark, sf)
    return I.validate_rows(r.rows, I.header_map(r.files), mode)


def q_import_validate_create(spark, sf):
    return _values(_validated(spark, sf, "create"), False)


def q_import_validate_update(spark, sf):
    return _values(_validated(spark, sf, "update"), True)


def q_file_duplicates(spark, sf):
    r = _Run(spark, sf)
    h = I.header_map(r.files)
    v = I.validate_rows(r.rows, h, "create").unionByName(I.validate_rows(r.rows, h, "update"))
    return I.file_duplicates(v)


def q_import_check_existing(spark, sf):
    r = _Run(spark, sf)
    full = r.reviewed()
    return full.select("file", "row_number", F.filter("errors", lambda e: F.startswith(e["message"], F.lit("Already used by"))
                                                      | F.startswith(e["message"], F.lit("No contact has"))
                                                      | F.startswith(e["message"], F.lit("This contact is in"))).alias("e")) \
        .filter(F.size("e") > 0).select("file", "row_number", F.col("e")[0]["message"].alias("message"))


def q_import_email_lookup(spark, sf):
    r = _Run(spark, sf)
    cand = r.rows.select("account_id", F.lower(F.when(F.col("mode") == "create", F.col("cells")[2]).otherwise(F.col("cells")[0])).alias("email"))
    return I.email_lookup(r.m.contacts, cand.filter(F.col("email").isNotNull() & (F.col("email") != "")))


def q_import_errors(spark, sf):
    e = I.import_errors(_Run(spark, sf).reviewed())
    return e.select("file", "row_number", "pos", "phase", "field", "message", F.to_json("row_data").alias("row_data"))


def q_error_reasons(spark, sf):
    return I.error_reasons(I.import_errors(_Run(spark, sf).reviewed())).select("file", "row_number", "reasons")


def q_error_rows_distinct(spark, sf):
    return I.error_rows_distinct(I.import_errors(_Run(spark, sf).reviewed()))


def q_import_job_summary(spark, sf):
    r = _Run(spark, sf)
    return I.job_summary(r.reviewed(), r.files, r.rows)


def q_rejected_rows_csv(spark, sf):
    r = _Run(spark, sf)
    return I.rejected_rows_csv(I.import_errors(r.reviewed()), r.files)


def q_import_chunk_progress(spark, sf):
    return I.chunk_progress(_Run(spark, sf).reviewed(), 50)


def q_exclude_rejected(spark, sf):
    r = _Run(spark, sf)
    return I.exclude_rejected(r.rows, I.import_errors(r.reviewed())).select("file", "row_number")


def q_import_apply_create(spark, sf):
    r = _Run(spark, sf)
    out = I.apply_create(r.reviewed(), r.m.contacts, r.m.tags, r.m.contact_tags, AS_OF)
    return out["new_contacts"].select("id", "account_id", "first_name", "last_name", "email", "phone", "company")


def q_import_update_match(spark, sf):
    r = _Run(spark, sf)
    out = I.apply_update(r.reviewed(), r.m.contacts, r.m.tags, r.m.contact_tags, AS_OF)
    return out["outcomes"].select("file", "row_number", "outcome").unionByName(
        out["errors"].select("file", "row_number", F.col("message").alias("outcome")))


def q_import_apply_update(spark, sf):
    r = _Run(spark, sf)
    out = I.apply_update(r.reviewed(), r.m.contacts, r.m.tags, r.m.contact_tags, AS_OF)
    # a new tag's id is a hash id: TAG_ADDED events are checked by tag name and import
    tag = F.col("type") == "TAG_ADDED"
    return out["activity"].select("contact_id", "type", F.when(~tag, F.col("payload")).alias("payload"),
                                  F.when(tag, F.get_json_object("payload", "$.tag.name")).alias("tag_name"),
                                  F.get_json_object("payload", "$.import").alias("import_id"))


def q_import_counters(spark, sf):
    r = _Run(spark, sf)
    rev = r.reviewed()
    c = I.apply_create(rev, r.m.contacts, r.m.tags, r.m.contact_tags, AS_OF)
    u = I.apply_update(rev, r.m.contacts, r.m.tags, r.m.contact_tags, AS_OF)
    outcomes = c["outcomes"].unionByName(u["outcomes"])
    errs = I.import_errors(rev).unionByName(c["errors"]).unionByName(u["errors"])
    return I.import_counters(I.job_summary(rev, r.files, r.rows), outcomes, errs)


def q_first_spelling_wins(spark, sf):
    r = _Run(spark, sf)
    rev = r.reviewed().filter(F.size("errors") == 0)
    wants = rev.select("account_id", "job_id", "row_number", F.posexplode("v.tags").alias("tpos", "name")).withColumn(
        "order", F.struct("job_id", "row_number", "tpos"))
    return I.ensure_tags(r.m.tags, wants.select("account_id", "name", "order")).select("account_id", "key", "name", "is_new")


QUERIES = {
    "csv_header_map": q_csv_header_map,
    "csv_file_failures": q_csv_file_failures,
    "import_validate_create": q_import_validate_create,
    "import_validate_update": q_import_validate_update,
    "file_duplicates": q_file_duplicates,
    "import_check_existing": q_import_check_existing,
    "import_email_lookup": q_import_email_lookup,
    "import_errors": q_import_errors,
    "error_reasons": q_error_reasons,
    "error_rows_distinct": q_error_rows_distinct,
    "import_job_summary": q_import_job_summary,
    "rejected_rows_csv": q_rejected_rows_csv,
    "import_chunk_progress": q_import_chunk_progress,
    "exclude_rejected": q_exclude_rejected,
    "import_apply_create": q_import_apply_create,
    "import_update_match": q_import_update_match,
    "import_apply_update": q_import_apply_update,
    "import_counters": q_import_counters,
    "first_spelling_wins": q_first_spelling_wins,
}

# ---------------------------------------------------------------- DuckDB twin


def _lit_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _trim(x: str) -> str:
    cls = JS_SPACE_CLASS
    return f"regexp_replace({x}, '^{cls}+|{cls}+$', '', 'g')"


_ALIASES = ", ".join(f"('{a}', '{c}')" for a, c in sorted(I.ALIASES.items()))
_EMAIL_RE = EMAIL_PATTERN.replace("'", "''")

IMPORT_CTES = f"""
import_files AS (
  SELECT DISTINCT 'import-' || CAST(p_partkey % 6 + 6 * (p_partkey // 150000) AS VARCHAR) || '.csv' AS file,
         CAST(p_partkey % 6 + 6 * (p_partkey // 150000) + 9000 AS BIGINT) AS job_id, CAST(p_partkey % 6 % 2 AS INTEGER) AS account_id,
         CASE WHEN p_partkey % 6 < 4 THEN 'create' ELSE 'update' END AS mode,
         CASE WHEN p_partkey % 6 < 4 THEN {_lit_list(CREATE_HEADER)} ELSE {_lit_list(UPDATE_HEADER)} END AS header
  FROM part
),
import_rows AS (
  SELECT 'import-' || CAST(p % 6 + 6 * (p // 150000) AS VARCHAR) || '.csv' AS file, CAST(p % 6 + 6 * (p // 150000) + 9000 AS BIGINT) AS job_id,
         CAST(p % 6 % 2 AS INTEGER) AS account_id, CASE WHEN p % 6 < 4 THEN 'create' ELSE 'update' END AS mode,
         CAST(p // 6 % 25000 + 1 AS BIGINT) AS row_number,
         CASE WHEN p % 6 < 4 THEN
           CASE WHEN p % 43 = 0 THEN list_concat(cc, ['extra']) WHEN p % 47 = 0 THEN cc[1:3] ELSE cc END
         ELSE [CASE WHEN p % 11 = 0 THEN 'nobody.' || CAST(p AS VARCHAR) || '@nowhere.test'
                    WHEN p % 13 = 0 THEN ''
                    WHEN p % 23 = 0 AND prior_email IS NOT NULL THEN prior_email
                    ELSE coalesce(known_email, fresh) END,
               CASE WHEN p % 3 = 0 THEN '[clear]' WHEN p % 5 = 0 THEN '' ELSE p_brand || ' Co' END,
               CASE WHEN p % 4 = 0 THEN '[CLEAR]' WHEN p % 7 = 0 THEN 'abc' ELSE '' END,
               CASE WHEN p % 43 = 0 THEN '[clear]' ELSE 'imported' END] END AS cells
  FROM (
    SELECT *, [CASE WHEN p % 17 = 0 THEN '' ELSE fst END,
               CASE WHEN p % 29 = 0 THEN repeat('x', 101) ELSE ' ' || lst END,
               CASE WHEN p % 11 = 0 THEN 'not-an-email' WHEN p % 13 = 0 THEN ''
                    WHEN p % 19 = 0 AND known_email IS NOT NULL THEN upper(known_email)
                    WHEN p % 23 = 0 THEN 'dup' || CAST(p % 4 AS VARCHAR) || '@example.test' ELSE fresh END,
               CASE WHEN p % 7 = 0 THEN '12-34' WHEN p % 9 = 0 THEN ''
                    ELSE '+1 555 ' || lpad(CAST(p % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(p % 10000 AS VARCHAR), 4, '0') END,
               CASE WHEN p % 31 = 0 THEN repeat('c', 151) ELSE p_brand END,
               CASE WHEN p % 37 = 0 THEN 'a,b;ok' WHEN p % 41 = 0 THEN repeat('t', 51) || ';VIP'
                    ELSE p_type || '; ' || lower(p_type) || ';VIP' END,
               'blue'] AS cc
    FROM (SELECT pt.p_partkey AS p, pt.p_brand, pt.p_type, split_part(pt.p_name, ' ', 1) AS fst, split_part(pt.p_name, ' ', 2) AS lst,
                 lower(split_part(pt.p_name, ' ', 1) || '.' || split_part(pt.p_name, ' ', 2) || '.' || CAST(pt.p_partkey AS VARCHAR) || '@import.test') AS fresh,
                 k.email AS known_email, pr.email AS prior_email
          FROM part pt LEFT JOIN contacts k ON k.id = pt.p_partkey LEFT JOIN contacts pr ON pr.id = pt.p_partkey - 6) b
  ) x
),
aliases(alias, col) AS (VALUES {_ALIASES}),
header_cells AS (
  SELECT f.file, f.mode, h.pos - 1 AS pos, h.raw, a.col
  FROM import_files f,
       LATERAL (SELECT unnest(f.header) AS raw, unnest(generate_series(1, len(f.header))) AS pos) h
  LEFT JOIN aliases a ON a.alias = regexp_replace(lower({_trim("regexp_replace(h.raw, '^\\x{FEFF}', '')")}), '[\\s-]+', '_', 'g')
),
header_ranked AS (
  SELECT *, CASE WHEN col IS NOT NULL THEN row_number() OVER (PARTITION BY file, col ORDER BY pos) END AS k FROM header_cells
),
header_map AS (
  SELECT file, mode,
         max(pos) FILTER (WHERE col = 'first_name' AND k = 1) AS i_first_name,
         max(pos) FILTER (WHERE col = 'last_name' AND k = 1) AS i_last_name,
         max(pos) FILTER (WHERE col = 'email' AND k = 1) AS i_email,
         max(pos) FILTER (WHERE col = 'phone' AND k = 1) AS i_phone,
         max(pos) FILTER (WHERE col = 'company' AND k = 1) AS i_company,
         max(pos) FILTER (WHERE col = 'tags' AND k = 1) AS i_tags,
         count(DISTINCT col) AS n_mapped,
         coalesce(string_agg({_trim("raw")}, ', ' ORDER BY pos) FILTER (WHERE col IS NULL AND {_trim("raw")} <> ''), '') AS ignored,
         arg_min(col, pos) FILTER (WHERE k = 2) AS dup
  FROM header_ranked GROUP BY file, mode
),
header_problem AS (
  SELECT *, CASE WHEN dup IS NOT NULL THEN 'The column "' || dup || '" appears twice in the header'
                 WHEN mode = 'create' AND i_first_name IS NULL AND i_last_name IS NULL THEN 'Missing required columns: first_name, last_name'
                 WHEN mode = 'create' AND i_first_name IS NULL THEN 'Missing required column: first_name'
                 WHEN mode = 'create' AND i_last_name IS NULL THEN 'Missing required column: last_name'
                 WHEN mode = 'update' AND i_email IS NULL THEN 'Missing required column: email'
                 WHEN mode = 'update' AND n_mapped < 2 THEN 'An update file needs the email column plus at least one column to change'
            END AS problem
  FROM header_map
),
cells AS (
  SELECT r.file, r.job_id, r.account_id, r.mode, r.row_number, r.cells,
         CASE WHEN h.i_first_name IS NOT NULL THEN {_trim("coalesce(r.cells[h.i_first_name + 1], '')")} END AS c_first,
         CASE WHEN h.i_last_name IS NOT NULL THEN {_trim("coalesce(r.cells[h.i_last_name + 1], '')")} END AS c_last,
         CASE WHEN h.i_email IS NOT NULL THEN {_trim("coalesce(r.cells[h.i_email + 1], '')")} END AS c_email,
         CASE WHEN h.i_phone IS NOT NULL THEN {_trim("coalesce(r.cells[h.i_phone + 1], '')")} END AS c_phone,
         CASE WHEN h.i_company IS NOT NULL THEN {_trim("coalesce(r.cells[h.i_company + 1], '')")} END AS c_company,
         CASE WHEN h.i_tags IS NOT NULL THEN {_trim("coalesce(r.cells[h.i_tags + 1], '')")} END AS c_tags
  FROM import_rows r JOIN header_problem h ON h.file = r.file AND h.mode = r.mode WHERE h.problem IS NULL
),
checks AS (
  SELECT *,
    regexp_matches(c_email, '{_EMAIL_RE}') AND length(c_email) <= 254 AND length(split_part(c_email, '@', 1)) <= 64 AS email_ok,
    lower(c_first) = '[clear]' AS first_clear, lower(c_last) = '[clear]' AS last_clear,
    lower(c_phone) = '[clear]' AS phone_clear, lower(c_company) = '[clear]' AS company_clear,
    c_tags IS NOT NULL AND c_tags <> '' AS tags_given,
    CASE WHEN c_tags IS NOT NULL AND c_tags <> '' AND NOT (mode = 'update' AND lower(c_tags) = '[clear]')
         THEN list_filter(list_transform(string_split(c_tags, ';'), lambda x: {_trim("x")}), lambda x: x <> '')
         ELSE []::VARCHAR[] END AS parts
  FROM cells
),
vals AS (
  SELECT *,
    CASE WHEN mode = 'create' THEN c_first IS NOT NULL ELSE c_first IS NOT NULL AND c_first <> '' AND NOT first_clear END AS first_name_set,
    CASE WHEN mode = 'create' THEN c_last IS NOT NULL ELSE c_last IS NOT NULL AND c_last <> '' AND NOT last_clear END AS last_name_set,
    c_email IS NOT NULL AND (c_email = '' OR email_ok) AS email_set,
    CASE WHEN mode = 'create' THEN c_phone IS NOT NULL ELSE c_phone IS NOT NULL AND c_phone <> '' END AS phone_set,
    CASE WHEN mode = 'create' THEN c_company IS NOT NULL ELSE c_company IS NOT NULL AND c_company <> '' END AS company_set,
    list_reduce(list_filter(parts, lambda t: length(t) <= 50 AND strpos(t, ',') = 0),
                lambda acc, t: CASE WHEN list_bool_or(list_transform(acc, lambda a: lower(a) = lower(t))) THEN acc ELSE list_append(acc, t) END,
                []::VARCHAR[]) AS kept
  FROM checks
),
validated AS (
  SELECT file, job_id, account_id, mode, row_number, cells,
    CASE WHEN first_name_set AND c_first <> '' AND NOT (mode = 'update' AND first_clear) THEN c_first END AS first_name,
    CASE WHEN last_name_set AND c_last <> '' AND NOT (mode = 'update' AND last_clear) THEN c_last END AS last_name,
    CASE WHEN c_email <> '' AND email_ok THEN lower(c_email) END AS email,
    CASE WHEN phone_set AND c_phone <> '' AND NOT phone_clear THEN c_phone END AS phone,
    CASE WHEN company_set AND c_company <> '' AND NOT company_clear THEN c_company END AS company,
    kept AS tags, first_name_set, last_name_set, email_set, phone_set, company_set,
    list_concat(list_concat(list_filter([
      CASE WHEN mode = 'create' AND c_first = '' THEN {{'field': 'first_name', 'message': 'First name is required'}} END,
      CASE WHEN first_name_set AND c_first <> '' AND NOT (mode = 'update' AND first_clear) AND length(c_first) > 100
           THEN {{'field': 'first_name', 'message': 'First name is limited to 100 characters'}} END,
      CASE WHEN mode = 'update' AND c_first <> '' AND first_clear THEN {{'field': 'first_name', 'message': 'First name can''t be cleared'}} END,
      CASE WHEN mode = 'create' AND c_last = '' THEN {{'field': 'last_name', 'message': 'Last name is required'}} END,
      CASE WHEN last_name_set AND c_last <> '' AND NOT (mode = 'update' AND last_clear) AND length(c_last) > 100
           THEN {{'field': 'last_name', 'message': 'Last name is limited to 100 characters'}} END,
      CASE WHEN mode = 'update' AND c_last <> '' AND last_clear THEN {{'field': 'last_name', 'message': 'Last name can''t be cleared'}} END,
      CASE WHEN mode = 'update' AND c_email = '' THEN {{'field': 'email', 'message': 'Email is required to find the contact'}} END,
      CASE WHEN c_email <> '' AND NOT email_ok THEN {{'field': 'email', 'message': 'Not a valid email address'}} END,
      CASE WHEN phone_set AND c_phone <> '' AND NOT (mode = 'update' AND phone_clear)
                AND NOT (regexp_matches(c_phone, '^\\+?[\\d\\s().-]+$')
                         AND length(regexp_replace(c_phone, '\\D', '', 'g')) BETWEEN 7 AND 15)
           THEN {{'field': 'phone', 'message': 'Phone must be 7 to 15 digits'}} END,
      CASE WHEN company_set AND c_company <> '' AND NOT (mode = 'update' AND company_clear) AND length(c_company) > 150
           THEN {{'field': 'company', 'message': 'Company is limited to 150 characters'}} END,
      CASE WHEN tags_given AND mode = 'update' AND lower(c_tags) = '[clear]'
           THEN {{'field': 'tags', 'message': 'Import only adds tags; remove tags in the app'}} END
    ], lambda x: x IS NOT NULL),
    list_filter(list_transform(parts, lambda t: CASE
        WHEN length(t) > 50 THEN {{'field': 'tags', 'message': 'Tag "' || substr(t, 1, 20) || '…" is longer than 50 characters'}}
        WHEN strpos(t, ',') > 0 THEN {{'field': 'tags', 'message': 'Tag "' || t || '" cannot contain commas'}} END), lambda x: x IS NOT NULL)),
    CASE WHEN len(kept) > 20 THEN [{{'field': 'tags', 'message': 'A contact can get at most 20 tags per row'}}] ELSE [] END) AS errors
  FROM vals
),
dups AS (
  SELECT file, email, min(row_number) AS first_row FROM validated WHERE email IS NOT NULL GROUP BY file, email
),
with_dups AS (
  SELECT v.*, CASE WHEN d.first_row < v.row_number
                   THEN list_append(v.errors, {{'field': 'email', 'message': 'Duplicate of row ' || CAST(d.first_row AS VARCHAR) || ' in this file'}})
                   ELSE v.errors END AS errors2
  FROM validated v LEFT JOIN dups d ON d.file = v.file AND d.email = v.email
),
lookup AS (
  SELECT account_id, email, max(CASE WHEN deleted_at IS NULL THEN first_name || ' ' || last_name END) AS active_name,
         bool_or(deleted_at IS NOT NULL) AS trashed
  FROM contacts WHERE email IS NOT NULL GROUP BY account_id, email
),
existing AS (
  SELECT w.file, w.row_number,
         CASE WHEN w.mode = 'create' AND l.active_name IS NOT NULL THEN 'Already used by ' || l.active_name
              WHEN w.mode = 'update' AND l.active_name IS NULL AND coalesce(l.trashed, false) THEN 'This contact is in the trash'
              WHEN w.mode = 'update' AND l.active_name IS NULL THEN 'No contact has this email' END AS message
  FROM with_dups w LEFT JOIN lookup l ON l.account_id = w.account_id AND l.email = w.email
  WHERE len(w.errors2) = 0 AND w.email IS NOT NULL
),
reviewed AS (
  SELECT w.* EXCLUDE (errors, errors2),
         CASE WHEN e.message IS NOT NULL THEN list_append(w.errors2, {{'field': 'email', 'message': e.message}}) ELSE w.errors2 END AS errors
  FROM with_dups w LEFT JOIN existing e ON e.file = w.file AND e.row_number = w.row_number
),
errs AS (
  SELECT r.file, r.job_id, r.row_number, u.pos - 1 AS pos, 'validate' AS phase, u.e.field AS field, u.e.message AS message, r.cells AS row_data
  FROM reviewed r, LATERAL (SELECT unnest(r.errors) AS e, unnest(generate_series(1, len(r.errors))) AS pos) u
)
"""


def _imp(body: str, extra: str = "") -> str:
    ctes = IMPORT_CTES.strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return with_fixtures(body, ctes)


# accepted create rows; jobs apply in job order, so a row finds its e-mail taken when an active
# contact owns it or an earlier row (job_id, row_number) of a create job created it
_CREATES = """
creates AS (
  SELECT r.*, EXISTS (SELECT 1 FROM contacts c WHERE c.deleted_at IS NULL AND c.account_id = r.account_id AND c.email = r.email)
              OR EXISTS (SELECT 1 FROM reviewed p WHERE p.mode = 'create' AND len(p.errors) = 0 AND p.account_id = r.account_id
                         AND p.email = r.email AND (p.job_id < r.job_id OR (p.job_id = r.job_id AND p.row_number < r.row_number))) AS taken
  FROM reviewed r WHERE r.mode = 'create' AND len(r.errors) = 0
)
"""

_ERRTEXT = "array_to_string(list_transform(errors, lambda e: e.field || ': ' || e.message), '; ')"
_VALS = f"file, row_number, first_name, last_name, email, phone, company, array_to_string(tags, ';') AS tags, {_ERRTEXT} AS errors"


def _csv_cell(x: str) -> str:
    safe = (f"CASE WHEN regexp_matches({x}, '^[=@\\t\\r]') OR (regexp_matches({x}, '^[+-]') "
            f"AND NOT regexp_full_match(substr({x}, 2), '[\\d\\s().-]*')) THEN '''' || {x} ELSE {x} END")
    return (f"(CASE WHEN regexp_matches({safe}, '[\",\\r\\n]') THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' ELSE {safe} END)")


_REASONS = """
SELECT file, row_number, string_agg(coalesce(field || ': ', '') || message, '; ' ORDER BY pos) AS reasons, first(row_data) AS row_data
FROM errs GROUP BY file, row_number
"""

ORACLE = {
    "csv_header_map": _imp("""
        SELECT h.file, m.mapped, h.ignored, h.problem FROM header_problem h JOIN (
          SELECT file, string_agg(col || '=' || CAST(pos AS VARCHAR), ',' ORDER BY col) AS mapped
          FROM header_ranked WHERE k = 1 GROUP BY file) m ON m.file = h.file"""),
    "csv_file_failures": _imp("""
        SELECT f.file, CASE WHEN coalesce(n.n, 0) > 50000 THEN 'The file has ' || format('{:,}', n.n) || '; the limit is 50,000'
                            WHEN coalesce(n.n, 0) = 0 THEN 'The file has a header but no data rows' ELSE h.problem END AS reason
        FROM import_files f LEFT JOIN (SELECT file, count(*) AS n FROM import_rows GROUP BY file) n ON n.file = f.file
        LEFT JOIN header_problem h ON h.file = f.file"""),
    "import_validate_create": _imp(f"SELECT {_VALS} FROM validated WHERE mode = 'create'"),
    "import_validate_update": _imp(f"""SELECT {_VALS}, first_name_set, last_name_set, email_set, phone_set, company_set
                                       FROM validated WHERE mode = 'update'"""),
    "file_duplicates": _imp("""SELECT v.file, v.row_number, d.first_row FROM validated v JOIN dups d ON d.file = v.file AND d.email = v.email
                               WHERE v.row_number > d.first_row"""),
    "import_check_existing": _imp("SELECT file, row_number, message FROM existing WHERE message IS NOT NULL"),
    "import_email_lookup": _imp("""
        SELECT l.account_id, l.email, l.active_name, l.trashed FROM lookup l
        WHERE (l.account_id, l.email) IN (SELECT DISTINCT account_id, lower(CASE WHEN mode = 'create' THEN cells[3] ELSE cells[1] END) FROM import_rows
                                          WHERE coalesce(CASE WHEN mode = 'create' THEN cells[3] ELSE cells[1] END, '') <> '')"""),
    "import_errors": _imp("SELECT file, row_number, pos, phase, field, message, to_json(row_data)::VARCHAR AS row_data FROM errs"),
    "error_reasons": _imp(f"SELECT file, row_number, reasons FROM ({_REASONS}) x"),
    "error_rows_distinct": _imp("SELECT file, phase, count(DISTINCT row_number) AS n FROM errs GROUP BY file, phase"),
    "import_job_summary": _imp("""
        SELECT f.file, f.job_id, f.account_id, f.mode,
               CAST(CASE WHEN h.problem IS NOT NULL THEN 0 ELSE coalesce(c.t, 0) END AS BIGINT) AS total_rows,
               CAST(CASE WHEN h.problem IS NOT NULL THEN 0 ELSE coalesce(c.t, 0) - coalesce(c.e, 0) END AS BIGINT) AS valid_rows,
               CAST(CASE WHEN h.problem IS NOT NULL THEN 0 ELSE coalesce(c.e, 0) END AS BIGINT) AS error_rows,
               CASE WHEN h.problem IS NULL AND h.ignored <> '' THEN 'Ignored columns: ' || h.ignored ELSE '' END AS notes,
               CASE WHEN h.problem IS NOT NULL OR c.t IS NULL THEN 'failed' ELSE 'ready' END AS status,
               CASE WHEN h.problem IS NOT NULL THEN h.problem WHEN c.t IS NULL THEN 'The file has a header but no data rows' END AS failure_reason,
               CASE WHEN h.problem IS NOT NULL OR c.t IS NULL THEN NULL
                    WHEN c.t - c.e > 0 THEN 'importable' ELSE 'NOTHING_TO_IMPORT' END AS verdict
        FROM import_files f LEFT JOIN header_problem h ON h.file = f.file
        LEFT JOIN (SELECT file, count(*) AS t, count(*) FILTER (WHERE len(errors) > 0) AS e FROM reviewed GROUP BY file) c ON c.file = f.file"""),
    "rejected_rows_csv": _imp(f"""
        SELECT r.file, CAST(0 AS BIGINT) AS line_no,
               array_to_string(list_transform(list_append(list_transform(generate_series(1, w.hw), lambda i: coalesce(f.header[i], '')), 'error'),
                                              lambda x: {_csv_cell("x")}), ',') AS line
        FROM (SELECT DISTINCT file FROM rs) r JOIN import_files f ON f.file = r.file JOIN w ON w.file = r.file
        UNION ALL
        SELECT r.file, CAST(r.row_number AS BIGINT),
               array_to_string(list_transform(list_append(list_transform(generate_series(1, w.hw), lambda i: coalesce(r.row_data[i], '')), r.reasons),
                                              lambda x: {_csv_cell("x")}), ',')
        FROM rs r JOIN w ON w.file = r.file""",
        extra=f"""rs AS ({_REASONS}),
        w AS (SELECT rs.file, greatest(len(any_value(f.header)), max(len(rs.row_data))) AS hw
              FROM rs JOIN import_files f ON f.file = rs.file GROUP BY rs.file)"""),
    "import_chunk_progress": _imp("""
        SELECT file, chunk, rows, valid, sum(rows) OVER (PARTITION BY file ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS processed
        FROM (SELECT file, CAST(floor((row_number - 1) / 50) AS BIGINT) AS chunk, count(*) AS rows,
                     count(*) FILTER (WHERE len(errors) = 0) AS valid FROM reviewed GROUP BY 1, 2) x"""),
    "exclude_rejected": _imp("""
        SELECT r.file, r.row_number FROM import_rows r
        WHERE NOT EXISTS (SELECT 1 FROM errs e WHERE e.file = r.file AND e.row_number = r.row_number AND e.phase = 'validate')"""),
    "import_apply_create": _imp("""
        SELECT -(r.job_id * 1000000 + r.row_number) AS id, r.account_id, r.first_name, r.last_name, r.email, r.phone, r.company
        FROM creates r WHERE NOT r.taken""", _CREATES),
    "import_update_match": _imp("""
        SELECT r.file, r.row_number,
               CASE WHEN c.id IS NULL THEN 'No contact has this email'
                    WHEN (r.first_name_set AND c.first_name IS DISTINCT FROM r.first_name)
                      OR (r.last_name_set AND c.last_name IS DISTINCT FROM r.last_name)
                      OR (r.phone_set AND c.phone IS DISTINCT FROM r.phone)
                      OR (r.company_set AND c.company IS DISTINCT FROM r.company)
                      OR EXISTS (SELECT 1 FROM unnest(r.tags) u(t)
                                 WHERE NOT EXISTS (SELECT 1 FROM contact_tags ct JOIN tags tg ON tg.id = ct.tag_id
                                                   WHERE ct.contact_id = c.id AND tg.account_id = r.account_id AND lower(tg.name) = lower(u.t)))
                    THEN 'updated' ELSE 'unchanged' END AS outcome
        FROM reviewed r LEFT JOIN contacts c ON c.deleted_at IS NULL AND c.account_id = r.account_id AND c.email = r.email
        WHERE r.mode = 'update' AND len(r.errors) = 0"""),
}


# ---------------------------------------------------------------- O6, W3, M9, I8


def q_import_error_page(spark, sf):
    return I.error_page(I.import_errors(_Run(spark, sf).reviewed()), limit=50, offset=10)


def q_first_spelling_in_row(spark, sf):
    """W3 within a row: tags de-duplicated case-insensitively, first spelling kept."""
    r = _Run(spark, sf)
    v = I.validate_rows(r.rows, I.header_map(r.files), "create")
    return v.filter(F.size("v.tags") > 0).select("file", "row_number", F.array_join("v.tags", ";").alias("tags"))


def q_import_pipeline(spark, sf):
    """I8 end to end: CSV files on disk → review → apply (create and update) → counters."""
    from rolodeck.plans.io_plans import _stage_import_csv
    from rolodeck.sources import csvio

    m = load_model(spark, sf)
    path = _stage_import_csv(spark, sf) + "/*/*.txt"
    jobs = import_files(spark, sf)
    modes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")) \
        .withColumn("name", F.regexp_extract("file", r"file=([^/]+)/", 1)) \
        .join(jobs.select(F.col("file").alias("name"), "job_id", "account_id", "mode"), "name").drop("name")
    files, rows = csvio.read_import_files(spark, path, modes)
    rev = I.review(rows, files, m.contacts).checkpoint()
    c = I.apply_create(rev, m.contacts, m.tags, m.contact_tags, AS_OF)
    u = I.apply_update(rev, m.contacts, m.tags, m.contact_tags, AS_OF)
    errs = I.import_errors(rev).unionByName(c["errors"]).unionByName(u["errors"])
    out = I.import_counters(I.job_summary(rev, files, rows), c["outcomes"].unionByName(u["outcomes"]), errs)
    return out.select(F.regexp_extract("file", r"file=([^/]+)/", 1).alias("file"), "processed", "created", "updated", "unchanged",
                      "error_rows", "status")


RESUME_CHUNK = 100  # rows of a chunk, so that jobs of every scale have several


def job_requests(spark, sf):
    """Confirm and cancel requests of the derived jobs, from all events: the account is at times another one."""
    e = raw(spark, sf, "events")
    k, job = F.col("event_id"), F.col("user_id")
    return e.select(k.alias("seq"), F.when(k % 13 == 0, 1 - job % 2).otherwise(job % 2).cast("int").alias("account_id"), F.floor(job / 3).alias("job_id"),
                    F.when(F.col("event_type").isin("click", "view"), "confirm").otherwise("cancel").alias("action"))


def request_jobs(spark, sf):
    """The derived jobs, some of them still validating, some ready without a valid row."""
    k = F.col("id")
    j = load_model(spark, sf).import_jobs
    return j.withColumn("status", F.when(k % 10 == 7, "validating").otherwise(F.col("status"))).withColumn("valid_rows", F.when(k % 30 == 1, 0).otherwise(F.col("valid_rows")))


def q_import_requests(spark, sf):
    """I8: confirm and cancel, as a batch."""
    return J.judge_requests(request_jobs(spark, sf), job_requests(spark, sf))["outcomes"]


def q_import_resume(spark, sf):
    """I8: all jobs confirmed and applied in runs of a few chunks, every second one broken off before its commit; the counters at the end."""
    r = _Run(spark, sf)
    rev = r.reviewed()
    summary = I.job_summary(rev, r.files, r.rows).withColumn("status", F.when(F.col("status") == "ready", "importing").otherwise(F.col("status"))).checkpoint()
    runs = J.Runs(spark, staging_path(spark, f"import-runs-{uuid.uuid4().hex[:12]}"))
    chunks = J.pending_chunks(rev, summary.filter("status = 'importing'"), None, RESUME_CHUNK).count()
    step = dict(max_chunks=-(-chunks // 3), chunk=RESUME_CHUNK)
    args = (runs, rev, summary, r.m.contacts, r.m.tags, r.m.contact_tags, AS_OF)
    J.run(*args, **step, commit=False)
    while J.run(*args, **step):
        pass
    return J.job_counters(runs, summary).join(summary.select("job_id", "file"), "job_id").filter("status = 'completed'").select(
        "file", "job_id", "processed", "created", "updated", "unchanged", "error_rows", "status")


QUERIES["import_requests"] = q_import_requests
QUERIES["import_resume"] = q_import_resume
QUERIES["import_error_page"] = q_import_error_page
QUERIES["ensure_tags"] = q_first_spelling_wins
QUERIES["first_spelling_wins"] = q_first_spelling_in_row
QUERIES["import_pipeline"] = q_import_pipeline

_UPDATE_OUTCOME = ORACLE["import_update_match"][ORACLE["import_update_match"].rindex("SELECT r.file, r.row_number,"):]
_COUNTERS = f"""
SELECT s.file, CAST(s.t AS BIGINT) AS processed,
       CAST(coalesce(cr.n, 0) AS BIGINT) AS created,
       CAST(coalesce(up.updated, 0) AS BIGINT) AS updated, CAST(coalesce(up.unchanged, 0) AS BIGINT) AS unchanged,
       CAST(s.e + coalesce(cr.lost, 0) + coalesce(up.missing, 0) AS BIGINT) AS error_rows, 'completed' AS status
FROM (SELECT file, count(*) AS t, count(*) FILTER (WHERE len(errors) > 0) AS e FROM reviewed GROUP BY file) s
LEFT JOIN (SELECT r.file, count(*) FILTER (WHERE NOT taken) AS n, count(*) FILTER (WHERE taken) AS lost
           FROM creates r GROUP BY r.file) cr ON cr.file = s.file
LEFT JOIN (SELECT file, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged,
                  count(*) FILTER (WHERE outcome = 'No contact has this email') AS missing
           FROM ({_UPDATE_OUTCOME}) x GROUP BY file) up ON up.file = s.file
"""
ORACLE["import_counters"] = _imp(f"SELECT file, CAST(9000 + CAST(regexp_extract(file, '(\\d+)', 1) AS INTEGER) AS BIGINT) AS job_id, "
                                 f"processed, created, updated, unchanged, error_rows, status FROM ({_COUNTERS}) z", _CREATES)
ORACLE["import_pipeline"] = _imp(_COUNTERS, _CREATES)
ORACLE["import_resume"] = ORACLE["import_counters"]
ORACLE["import_requests"] = _imp("""
    SELECT seq, job_id, action, outcome,
           CASE outcome WHEN 'NOTHING_TO_IMPORT' THEN 'There are no valid rows to import'
                        WHEN 'IMPORT_NOT_READY' THEN 'This import is ' || status || ', so it can''t be started'
                        WHEN 'IMPORT_NOT_CANCELLABLE' THEN 'This import is ' || status || ', so it can''t be cancelled' END AS message
    FROM (SELECT *, CASE WHEN was IS NULL THEN 'NOT_FOUND' WHEN seq = least(go, stop) THEN 'APPLIED'
                         WHEN action = 'confirm' AND status = 'ready' THEN 'NOTHING_TO_IMPORT' WHEN action = 'confirm' THEN 'IMPORT_NOT_READY' ELSE 'IMPORT_NOT_CANCELLABLE' END AS outcome
          FROM (SELECT *, CASE WHEN seq <= coalesce(least(go, stop), seq) THEN was WHEN go = least(go, stop) THEN 'importing' ELSE 'cancelled' END AS status
                FROM (SELECT *, min(CASE WHEN action = 'confirm' AND was = 'ready' AND valid > 0 THEN seq END) OVER w AS go,
                             min(CASE WHEN action = 'cancel' AND was IN ('validating', 'ready') THEN seq END) OVER w AS stop
                      FROM (SELECT q.*, j.status AS was, j.valid FROM (
                              SELECT event_id AS seq, CAST(CASE WHEN event_id % 13 = 0 THEN 1 - user_id % 2 ELSE user_id % 2 END AS INTEGER) AS account_id, user_id // 3 AS job_id,
                                     CASE WHEN event_type IN ('click', 'view') THEN 'confirm' ELSE 'cancel' END AS action FROM events) q
                            LEFT JOIN (SELECT id, account_id, CASE WHEN id % 10 = 7 THEN 'validating' ELSE status END AS status,
                                              CASE WHEN id % 30 = 1 THEN 0 ELSE valid_rows END AS valid FROM import_jobs) j ON j.id = q.job_id AND j.account_id = q.account_id) x
                      WINDOW w AS (PARTITION BY job_id, account_id)) y) z) o""")
ORACLE["import_error_page"] = _imp("""
    SELECT file, k, row_number AS "row", phase, field, message, total FROM (
      SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_number, pos) AS k, count(*) OVER (PARTITION BY file) AS total FROM errs) x
    WHERE k > 10 AND k <= 60""")
ORACLE["first_spelling_wins"] = _imp("""
    SELECT file, row_number, array_to_string(tags, ';') AS tags FROM validated WHERE mode = 'create' AND len(tags) > 0""")
ORACLE["ensure_tags"] = _imp("""
    SELECT w.account_id, w.key, coalesce(t.name, w.first) AS name, t.id IS NULL AS is_new
    FROM (SELECT r.account_id, lower(u.tag) AS key, arg_min(u.tag, (r.job_id, r.row_number, u.pos)) AS first
          FROM reviewed r, LATERAL (SELECT unnest(r.tags) AS tag, unnest(generate_series(1, len(r.tags))) AS pos) u
          WHERE len(r.errors) = 0 GROUP BY 1, 2) w
    LEFT JOIN tags t ON t.account_id = w.account_id AND lower(t.name) = w.key""")

# I6 in job order: each matched row against the fields the earlier rows of its contact left
_J = "CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || {x} || '\"' END"
_UPD_FIELDS = [("first_name", "firstName"), ("last_name", "lastName"), ("phone", "phone"), ("company", "company")]
_UPDATES = """
upd AS (
  SELECT r.*, c.id AS contact_id, c.version AS c_version, """ + ", ".join(f"c.{f} AS c_{f}" for f, _ in _UPD_FIELDS) + """
  FROM reviewed r JOIN contacts c ON c.deleted_at IS NULL AND c.account_id = r.account_id AND c.email = r.email
  WHERE r.mode = 'update' AND len(r.errors) = 0
),
bef AS (
  SELECT u.*, """ + ", ".join(
    f"coalesce(last_value(CASE WHEN {f}_set THEN {{'x': {f}}} END IGNORE NULLS) OVER w, {{'x': c_{f}}}).x AS b_{f}"
    for f, _ in _UPD_FIELDS) + """
  FROM upd u
  WINDOW w AS (PARTITION BY contact_id ORDER BY job_id, row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
chg AS (
  SELECT b.*, list_filter([""" + ", ".join(
    f"CASE WHEN {f}_set AND b_{f} IS DISTINCT FROM {f} THEN "
    f"'\"{api}\":{{\"from\":' || {_J.format(x=f'b_{f}')} || ',\"to\":' || {_J.format(x=f)} || '}}' END"
    for f, api in _UPD_FIELDS) + """], lambda x: x IS NOT NULL) AS ch
  FROM bef b
),
ver AS (
  SELECT *, c_version + sum(CASE WHEN len(ch) > 0 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY contact_id ORDER BY job_id, row_number ROWS UNBOUNDED PRECEDING) AS ver
  FROM chg
),
wants AS (
  SELECT u.account_id, u.contact_id, u.job_id, u.row_number, t.pos, t.name, lower(t.name) AS key
  FROM upd u, LATERAL (SELECT unnest(u.tags) AS name, unnest(generate_series(1, len(u.tags))) AS pos) t
),
new_links AS (
  SELECT w.*, coalesce(tg.name, f.first) AS tag_name,
         row_number() OVER (PARTITION BY w.contact_id, w.key ORDER BY w.job_id, w.row_number, w.pos) AS k
  FROM wants w
  JOIN (SELECT account_id, key, arg_min(name, (job_id, row_number, pos)) AS first FROM wants GROUP BY 1, 2) f
    ON f.account_id = w.account_id AND f.key = w.key
  LEFT JOIN tags tg ON tg.account_id = w.account_id AND lower(tg.name) = w.key
  WHERE tg.id IS NULL OR NOT EXISTS (SELECT 1 FROM contact_tags ct WHERE ct.contact_id = w.contact_id AND ct.tag_id = tg.id)
)
"""
ORACLE["import_apply_update"] = _imp("""
    SELECT contact_id, 'CONTACT_UPDATED' AS type,
           '{"changes":{' || array_to_string(ch, ',') || '},"version":' || CAST(ver AS VARCHAR) || ',"import":"' || CAST(job_id AS VARCHAR) || '"}' AS payload,
           CAST(NULL AS VARCHAR) AS tag_name, CAST(job_id AS VARCHAR) AS import_id
    FROM ver WHERE len(ch) > 0
    UNION ALL
    SELECT contact_id, 'TAG_ADDED', CAST(NULL AS VARCHAR), tag_name, CAST(job_id AS VARCHAR) FROM new_links WHERE k = 1""", _UPDATES)
