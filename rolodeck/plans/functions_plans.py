"""Registered scalar-function queries (F1–F23, P14–P16) and tenant operators
(J9–J11), each over columns of the test tables, with DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rolodeck.functions import text as T
from rolodeck.functions import rules
from rolodeck.functions.activity_text import LABELS as ACTIVITY_LABELS, activity_detail, activity_title
from rolodeck.functions.csvcells import csv_line_from_array, csv_safe
from rolodeck.functions.jsonpayload import json_object
from rolodeck.functions.validators import EMAIL_PATTERN, is_email, is_phone
from rolodeck.operators import metrics as M
from rolodeck.operators import tenants as TN
from rolodeck.plans.changes_plans import _ACC, _FOLD_CTES, APPLIED_ACTIVITY_SQL
from rolodeck.plans.import_plans import _imp
from rolodeck.plans.oracle_fixtures import with_fixtures
from rolodeck.sources import generator as G
from rolodeck.sources.contacts import generated_columns
from rolodeck.sources.fixtures import AS_OF, load_model, raw

# Parameters
PHONE_CANDIDATE = r"\+?[0-9(][0-9 ().-]{5,}[0-9)]"
EMAIL_CANDIDATE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
SEED_TAGS = [("Lead", 0.2), ("Customer", 0.3), ("Partner", 0.05)]


def _c(spark, sf):
    return load_model(spark, sf).contacts


def q_derived_columns(spark, sf):
    c = _c(spark, sf)
    g = generated_columns()
    return c.select("id", *[g[k].alias(k) for k in ("name_sort", "search_name", "phone_digits", "company_lower")])


def _padded_names(spark, sf):
    cu = raw(spark, sf, "customer")
    k = F.col("c_custkey")
    padded = (F.when(k % 4 == 0, F.concat(F.lit("\u00a0"), F.col("c_name"), F.lit("\u3000")))
              .when(k % 4 == 1, F.concat(F.lit("\t "), F.col("c_mktsegment"), F.lit(" \r\n")))
              .when(k % 4 == 2, F.lit(" \ufeff "))
              .otherwise(F.col("c_name")))
    return cu.select(k.alias("id"), padded.alias("raw"))


def q_trim_to_null(spark, sf):
    return _padded_names(spark, sf).select("id", T.trim_to_null("raw").alias("value"), T.trim_lower("raw").alias("lower_value"))


def q_split_tags(spark, sf):
    p = raw(spark, sf, "part")
    s = F.concat(F.col("p_name"), F.lit(" ; ;"), F.col("p_brand"), F.lit(";  "), F.col("p_type"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(T.split_tags(s), "|").alias("tags"))


def q_digits_only(spark, sf):
    c = _c(spark, sf)
    return c.select("id", T.digits_only("phone").alias("digits"), F.length(T.digits_only("phone")).alias("n_digits"))


def q_normalize_header(spark, sf):
    p = raw(spark, sf, "part")
    h = F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" - "), F.col("p_type"), F.lit("  "))
    return p.select(F.col("p_partkey").alias("id"), T.normalize_header(h).alias("header"))


def q_utc_day(spark, sf):
    e = raw(spark, sf, "events")
    return e.select("event_id", M.utc_day("ts").alias("day"))


def q_interval_math(spark, sf):
    c = _c(spark, sf)
    return c.select(
        "id",
        (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("plus_1h"),
        F.date_add(F.to_date("created_at"), 30).alias("plus_30d"),
        (F.col("updated_at") < F.lit(AS_OF - dt.timedelta(days=90)).cast("timestamp_ntz")).alias("stale"),
        F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("month_start"),
    )


def q_text_timestamp(spark, sf):
    from rolodeck.operators.listing import text_timestamp

    return raw(spark, sf, "events").select("event_id", text_timestamp(F.col("ts")).alias("ts_text"))


def q_round1_pct(spark, sf):
    e = raw(spark, sf, "events")
    return e.select("event_id", M.round1(F.col("value") / 100.0).alias("pct"),
                    M.pct_or_zero(F.col("user_id") % 7, F.col("event_id") % 5).alias("share"))


def q_clamp(spark, sf):
    p = raw(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.least(F.greatest(F.col("p_size") - 10, F.lit(1)), F.lit(25)).alias("clamped"))


def q_initials(spark, sf):
    c = _c(spark, sf)
    return c.select("id", T.initials("first_name", "last_name").alias("initials"))


def q_stable_bucket(spark, sf):
    c = _c(spark, sf)
    return c.select("id", T.stable_bucket(F.concat_ws(" ", "first_name", "last_name")).alias("slot"))


def q_csv_safe(spark, sf):
    c = _c(spark, sf)
    k = F.col("id")
    cell = (F.when(k % 5 == 0, F.concat(F.lit("="), F.col("first_name")))
            .when(k % 5 == 1, F.concat(F.lit("-"), F.col("last_name")))
            .when(k % 5 == 2, F.coalesce(F.col("phone"), F.lit("@x")))
            .when(k % 5 == 3, F.concat(F.lit("+"), F.col("phone_digits")))
            .otherwise(F.coalesce(F.col("company"), F.lit("\tTab"))))
    return c.select("id", cell.alias("cell"), csv_safe(cell).alias("safe"))


def q_csv_quote_line(spark, sf):
    p = raw(spark, sf, "part")
    cells = F.array(F.col("p_name"), F.concat(F.col("p_brand"), F.lit(", Inc")), F.concat(F.lit('say "'), F.col("p_type"), F.lit('"')),
                    F.concat(F.lit("line1\n"), F.col("p_type")), F.lit(""))
    return p.select(F.col("p_partkey").alias("id"), csv_line_from_array(cells).alias("line"))


def q_trim_lower(spark, sf):
    return _padded_names(spark, sf).select("id", T.trim_lower("raw").alias("lower_value"))


def q_slug(spark, sf):
    return _c(spark, sf).select("id", T.slug(F.concat_ws(" ", "first_name", "company")).alias("slug"))


def q_pad_left(spark, sf):
    return _c(spark, sf).select("id", T.pad_left(F.col("id") % 1000, 4).alias("padded"))


def q_truncate_text(spark, sf):
    return _c(spark, sf).select("id", T.truncate_text("company_lower", 7).alias("short"))


def q_error_filename(spark, sf):
    s = raw(spark, sf, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.col("s_name"), F.lit(".CSV"))) \
        .when(F.col("s_suppkey") % 3 == 1, F.concat(F.col("s_name"), F.lit(".csv"))).otherwise(F.col("s_name"))
    return s.select(F.col("s_suppkey").alias("id"), T.error_filename(name).alias("errors_file"))


def q_json_object_build(spark, sf):
    m = load_model(spark, sf)
    j = m.contact_tags.join(m.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return j.select("contact_id", "tag_id", json_object(F.struct(F.struct(F.col("tag_id").alias("id"), "name").alias("tag"),
                                                                 F.lit(None).cast("string").alias("import"))).alias("payload"))


def q_uuid_check(spark, sf):
    e = raw(spark, sf, "events")
    h = F.md5(F.col("event_id").cast("string"))
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    cand = F.when(F.col("event_id") % 3 == 0, F.upper(u)).when(F.col("event_id") % 3 == 1, u).otherwise(F.substring(u, 2, 40))
    return e.select("event_id", cand.alias("candidate"), T.is_uuid(cand).alias("is_uuid"))


def q_array_membership(spark, sf):
    c = _c(spark, sf)
    return c.select("id", F.col("first_name").isin("red", "blue", "green").alias("is_primary_color"))


def _tokens(spark, sf, pattern):
    d = raw(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("pos", "token"))


def q_phone_validate(spark, sf):
    t = _tokens(spark, sf, PHONE_CANDIDATE)
    return t.select("doc_id", "pos", "token", is_phone("token").alias("valid"))


def q_email_validate(spark, sf):
    t = _tokens(spark, sf, EMAIL_CANDIDATE)
    return t.select("doc_id", "pos", "token", is_email("token").alias("valid"))


def q_field_limits(spark, sf):
    """All rules over the cells of every import row, of create and of update files."""
    from rolodeck.sources.import_fixture import import_rows

    r = import_rows(spark, sf, _c(spark, sf))
    create, cell = F.col("mode") == "create", lambda i: F.get(F.col("cells"), i)
    names = F.when(create, cell(5)).otherwise(cell(3))
    rows = r.select("file", "row_number", *[c.alias(n) for n, c in {
        "first_name": F.when(create, T.trim_to_null(cell(0))), "last_name": F.when(create, T.trim_to_null(cell(1))), "email": T.trim_lower(F.when(create, cell(2)).otherwise(cell(0))),
        "phone": T.trim_to_null(F.when(create, cell(3)).otherwise(cell(2))), "company": T.trim_to_null(F.when(create, cell(4)).otherwise(cell(1))), "tags": F.split(names, ";"), "create": create}.items()])
    given = {f: (F.col("create") if f.endswith("_name") else F.lit(True)) for f in rules.API_NAMES}
    errors = rules.field_errors(given, rules.trimmed_tags("tags"))
    return rows.select("file", "row_number", rules.errors_text(errors).alias("errors"))


def q_activity_text(spark, sf):
    from rolodeck.plans.changes_plans import _applied

    a = _applied(spark, sf)["activity"].unionByName(load_model(spark, sf).activity)
    return a.select("contact_id", "type", activity_title("type", "payload").alias("title"), activity_detail("type", "payload").alias("detail"))


def q_bernoulli_cross_join(spark, sf):
    return G.bernoulli_tags(_c(spark, sf), SEED_TAGS, seed=11).select("account_id", "contact_id", "tag_name")


def _clone(spark, sf):
    m = load_model(spark, sf)
    off = m.contacts.agg(F.max("id")).first()[0] + 1  # one scalar: the id space to move past
    return TN.clone_tenant(m.contacts, m.tags, m.contact_tags, src=1, dst=2, id_offset=off, tag_offset=10)


def q_clone_tenant(spark, sf):
    out = _clone(spark, sf)
    c = out["contacts"].groupBy("account_id").agg(F.count(F.lit(1)).alias("contacts"))
    t = out["tags"].groupBy("account_id").agg(F.count(F.lit(1)).alias("tags"))
    acc = out["contacts"].select(F.col("id").alias("contact_id"), "account_id")
    links = out["contact_tags"].join(acc, "contact_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("links"))
    return c.join(t, "account_id", "left").join(links, "account_id", "left")


def q_recent_tag_history(spark, sf):
    m = load_model(spark, sf)
    return TN.recent_tag_history(m.contacts, m.tags, m.contact_tags, 2000)


QUERIES = {
    "derived_columns": q_derived_columns,
    "trim_to_null": q_trim_to_null,
    "split_tags": q_split_tags,
    "digits_only": q_digits_only,
    "normalize_header": q_normalize_header,
    "utc_day": q_utc_day,
    "interval_math": q_interval_math,
    "text_timestamp": q_text_timestamp,
    "round1_pct": q_round1_pct,
    "clamp": q_clamp,
    "initials": q_initials,
    "stable_bucket": q_stable_bucket,
    "activity_text": q_activity_text,
    "csv_safe": q_csv_safe,
    "csv_quote_line": q_csv_quote_line,
    "trim_lower": q_trim_lower,
    "slug": q_slug,
    "pad_left": q_pad_left,
    "truncate_text": q_truncate_text,
    "error_filename": q_error_filename,
    "json_object_build": q_json_object_build,
    "uuid_check": q_uuid_check,
    "array_membership": q_array_membership,
    "phone_validate": q_phone_validate,
    "email_validate": q_email_validate,
    "field_limits": q_field_limits,
    "bernoulli_cross_join": q_bernoulli_cross_join,
    "clone_tenant": q_clone_tenant,
    "recent_tag_history": q_recent_tag_history,
}

_TRIM = "regexp_replace({x}, '^[\\t\\n\\x0B\\f\\r\\p{{Z}}\\x{{FEFF}}]+|[\\t\\n\\x0B\\f\\r\\p{{Z}}\\x{{FEFF}}]+$', '', 'g')"
_PAD = """CASE WHEN c_custkey % 4 = 0 THEN chr(160) || c_name || chr(12288)
               WHEN c_custkey % 4 = 1 THEN chr(9) || ' ' || c_mktsegment || ' ' || chr(13) || chr(10)
               WHEN c_custkey % 4 = 2 THEN ' ' || chr(65279) || ' ' ELSE c_name END"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _safe(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '^[=@\\t\\r]') OR (regexp_matches({x}, '^[+-]') "
            f"AND NOT regexp_full_match(substr({x}, 2), '[\\d\\s().-]*')) THEN '''' || {x} ELSE {x} END")


def _quote(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END)"


_EMAIL_RE = EMAIL_PATTERN.replace("'", "''")

ORACLE = {
    "derived_columns": with_fixtures("SELECT id, name_sort, search_name, phone_digits, company_lower FROM contacts"),
    "trim_to_null": with_fixtures(f"""
        SELECT c_custkey AS id, nullif({_TRIM.format(x=_PAD)}, '') AS value, lower(nullif({_TRIM.format(x=_PAD)}, '')) AS lower_value
        FROM customer"""),
    "split_tags": with_fixtures(f"""
        SELECT p_partkey AS id,
               array_to_string(list_filter(list_transform(string_split(p_name || ' ; ;' || p_brand || ';  ' || p_type, ';'),
                                                          lambda x: {_TRIM.format(x='x')}), lambda x: x <> ''), '|') AS tags
        FROM part"""),
    "digits_only": with_fixtures("""
        SELECT id, regexp_replace(coalesce(phone, ''), '\\D', '', 'g') AS digits,
               length(regexp_replace(coalesce(phone, ''), '\\D', '', 'g')) AS n_digits FROM contacts"""),
    "normalize_header": with_fixtures(f"""
        SELECT p_partkey AS id,
               regexp_replace(lower({_TRIM.format(x="regexp_replace(h, '\\x{FEFF}', '', 'g')")}), '[\\s-]+', '_', 'g') AS header
        FROM (SELECT p_partkey, ' ' || array_to_string(list_transform(string_split(p_name, ' '),
                                 lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' - ' || p_type || '  ' AS h FROM part) x"""),
    "utc_day": with_fixtures("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events"),
    "interval_math": with_fixtures(f"""
        SELECT id, created_at + INTERVAL 1 HOUR AS plus_1h, CAST(created_at AS DATE) + 30 AS plus_30d,
               updated_at < TIMESTAMP '{AS_OF - dt.timedelta(days=90):%Y-%m-%d %H:%M:%S}' AS stale,
               date_trunc('month', created_at) AS month_start FROM contacts"""),
    "text_timestamp": with_fixtures("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text FROM events"),
    "round1_pct": with_fixtures("""
        SELECT event_id, floor(value / 100.0 * 1000 + 0.5) / 10 AS pct,
               CASE WHEN event_id % 5 > 0 THEN floor((user_id % 7) / (event_id % 5) * 1000 + 0.5) / 10 ELSE 0.0 END AS share
        FROM events"""),
    "clamp": with_fixtures("SELECT p_partkey AS id, least(greatest(p_size - 10, 1), 25) AS clamped FROM part"),
    "initials": with_fixtures("SELECT id, upper(left(coalesce(first_name, ''), 1) || left(coalesce(last_name, ''), 1)) AS initials FROM contacts"),
    "stable_bucket": with_fixtures("""
        SELECT id, CAST(list_reduce(list_transform(string_split(lower(first_name || ' ' || last_name), ''), lambda ch: unicode(ch)),
                                    lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) % 8 AS INTEGER) AS slot
        FROM contacts"""),
    "csv_safe": with_fixtures(f"""
        SELECT id, cell, {_safe('cell')} AS safe FROM (
          SELECT id, CASE WHEN id % 5 = 0 THEN '=' || first_name WHEN id % 5 = 1 THEN '-' || last_name
                          WHEN id % 5 = 2 THEN coalesce(phone, '@x') WHEN id % 5 = 3 THEN '+' || phone_digits
                          ELSE coalesce(company, chr(9) || 'Tab') END AS cell FROM contacts) x"""),
    "csv_quote_line": with_fixtures(f"""
        SELECT p_partkey AS id, array_to_string(list_transform([p_name, p_brand || ', Inc', 'say "' || p_type || '"',
                                                                'line1' || chr(10) || p_type, ''],
                                                               lambda x: {_quote(_safe('x'))}), ',') AS line FROM part"""),
    "slug": with_fixtures("SELECT id, regexp_replace(lower(concat_ws(' ', first_name, company)), '[^a-z]', '', 'g') AS slug FROM contacts"),
    "pad_left": with_fixtures("SELECT id, lpad(CAST(id % 1000 AS VARCHAR), 4, '0') AS padded FROM contacts"),
    "truncate_text": with_fixtures("SELECT id, substr(company_lower, 1, 7) AS short FROM contacts"),
    "trim_lower": with_fixtures(f"SELECT c_custkey AS id, lower(nullif({_TRIM.format(x=_PAD)}, '')) AS lower_value FROM customer"),
    "error_filename": with_fixtures("""
        SELECT s_suppkey AS id,
               regexp_replace(CASE WHEN s_suppkey % 3 = 0 THEN s_name || '.CSV' WHEN s_suppkey % 3 = 1 THEN s_name || '.csv' ELSE s_name END,
                              '\\.[cC][sS][vV]$', '') || '-errors.csv' AS errors_file FROM supplier"""),
    "json_object_build": with_fixtures("""
        SELECT ct.contact_id, ct.tag_id, json_object('tag', json_object('id', ct.tag_id, 'name', t.name), 'import', NULL)::VARCHAR AS payload
        FROM contact_tags ct JOIN tags t ON t.id = ct.tag_id"""),
    "uuid_check": with_fixtures("""
        SELECT event_id, candidate,
               regexp_full_match(candidate, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') AS is_uuid
        FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(u) WHEN event_id % 3 = 1 THEN u ELSE substr(u, 2, 40) END AS candidate
              FROM (SELECT event_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS u
                    FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events) a) b) c"""),
    "array_membership": with_fixtures("SELECT id, first_name IN ('red', 'blue', 'green') AS is_primary_color FROM contacts"),
    "phone_validate": with_fixtures(f"""
        SELECT doc_id, pos, token,
               regexp_full_match(token, '\\+?[\\d\\s().-]+') AND length(regexp_replace(token, '\\D', '', 'g')) BETWEEN 7 AND 15 AS valid
        FROM (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token
              FROM (SELECT doc_id, regexp_extract_all(text, {_q(PHONE_CANDIDATE)}) AS toks FROM documents) d) x"""),
    "email_validate": with_fixtures(f"""
        SELECT doc_id, pos, token,
               regexp_matches(token, '{_EMAIL_RE}') AND length(token) <= 254 AND length(split_part(token, '@', 1)) <= 64 AS valid
        FROM (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token
              FROM (SELECT doc_id, regexp_extract_all(text, {_q(EMAIL_CANDIDATE)}) AS toks FROM documents) d) x"""),
    "clone_tenant": with_fixtures("""
        SELECT c.account_id, c.contacts, t.tags, l.links FROM
          (SELECT account_id, count(*) AS contacts FROM (SELECT account_id FROM contacts UNION ALL SELECT 2 FROM contacts WHERE account_id = 1) GROUP BY 1) c
          LEFT JOIN (SELECT account_id, count(*) AS tags FROM (SELECT account_id FROM tags UNION ALL SELECT 2 FROM tags WHERE account_id = 1) GROUP BY 1) t
            ON t.account_id = c.account_id
          LEFT JOIN (SELECT account_id, count(*) AS links FROM (
                       SELECT c.account_id FROM contact_tags ct JOIN contacts c ON c.id = ct.contact_id
                       UNION ALL SELECT 2 FROM contact_tags ct JOIN contacts c ON c.id = ct.contact_id JOIN tags g ON g.id = ct.tag_id
                       WHERE c.account_id = 1 AND g.account_id = 1) GROUP BY 1) l ON l.account_id = c.account_id"""),
    "recent_tag_history": with_fixtures("""
        SELECT ct.contact_id, ct.tag_id, t.name, r.created_at + INTERVAL 1 HOUR AS event_at
        FROM contact_tags ct
        JOIN (SELECT id, created_at FROM contacts
              QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, id DESC) <= 2000) r ON r.id = ct.contact_id
        JOIN tags t ON t.id = ct.tag_id"""),
    "bernoulli_cross_join": with_fixtures("""
        SELECT c.account_id, c.id AS contact_id, t.name AS tag_name
        FROM contacts c CROSS JOIN (VALUES ('Lead', 0.2), ('Customer', 0.3), ('Partner', 0.05)) t(name, p)
        WHERE CAST('0x' || substr(md5('11:' || c.id || ':' || t.name), 1, 8) AS BIGINT) / 4294967296.0 < t.p"""),
    "field_limits": _imp("""
        SELECT file, row_number, array_to_string(list_filter([
                 CASE WHEN mode = 'create' AND first = '' THEN 'firstName: firstName should not be empty' END,
                 CASE WHEN mode = 'create' AND length(first) > 100 THEN 'firstName: firstName must be shorter than or equal to 100 characters' END,
                 CASE WHEN mode = 'create' AND last = '' THEN 'lastName: lastName should not be empty' END,
                 CASE WHEN mode = 'create' AND length(last) > 100 THEN 'lastName: lastName must be shorter than or equal to 100 characters' END,
                 CASE WHEN email <> '' AND NOT (email LIKE '%_@_%.__%') THEN 'email: email must be an email' END,
                 CASE WHEN phone <> '' AND NOT (regexp_full_match(phone, '[+]?[0-9 ().-]+') AND length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)
                      THEN 'phone: phone must be 7-15 digits and may contain + ( ) - . and spaces' END,
                 CASE WHEN length(company) > 150 THEN 'company: company must be shorter than or equal to 150 characters' END,
                 CASE WHEN len(names) > 20 THEN 'tags: tags must contain no more than 20 elements' END,
                 CASE WHEN len(list_filter(names, lambda x: length(x) > 50)) > 0 THEN 'tags: each value in tags must be shorter than or equal to 50 characters' END,
                 CASE WHEN len(list_filter(names, lambda x: contains(x, ','))) > 0 THEN 'tags: tag names cannot contain commas' END], lambda x: x IS NOT NULL), '; ') AS errors
        FROM (SELECT file, row_number, mode, coalesce(TRIM_FIRST, '') AS first, coalesce(TRIM_LAST, '') AS last,
                     trim(coalesce(CASE WHEN mode = 'create' THEN cells[3] ELSE cells[1] END, '')) AS email,
                     trim(coalesce(CASE WHEN mode = 'create' THEN cells[4] ELSE cells[3] END, '')) AS phone,
                     trim(coalesce(CASE WHEN mode = 'create' THEN cells[5] ELSE cells[2] END, '')) AS company,
                     list_filter(list_transform(string_split(coalesce(CASE WHEN mode = 'create' THEN cells[6] ELSE cells[4] END, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS names
              FROM import_rows) x""".replace("TRIM_FIRST", _TRIM.format(x="cells[1]")).replace("TRIM_LAST", _TRIM.format(x="cells[2]"))),
}


# F14 over the stored activity and the activity of the applied command batch (its payloads as activity_emit builds them)
_LABEL = "CASE {k} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIVITY_LABELS.items()) + " ELSE {k} END"
_SHOW = "CASE WHEN {v} IS NULL OR {v} = '' THEN '(empty)' ELSE {v} END"
_CHANGE_TEXT = ("nullif(array_to_string(list_transform(coalesce(json_keys(payload, '$.changes'), []), lambda k: "
                + _LABEL.format(k="k") + " || ': ' || "
                + _SHOW.format(v="json_extract_string(payload, '$.changes.\"' || k || '\".from')") + " || ' → ' || "
                + _SHOW.format(v="json_extract_string(payload, '$.changes.\"' || k || '\".to')") + "), '; '), '')")
ORACLE["activity_text"] = with_fixtures(f"""
    SELECT contact_id, type,
           CASE type WHEN 'CONTACT_CREATED' THEN 'Contact created' WHEN 'CONTACT_UPDATED' THEN 'Contact updated'
                     WHEN 'CONTACT_DELETED' THEN CASE WHEN bulk THEN 'Moved to trash (bulk)' ELSE 'Moved to trash' END
                     WHEN 'CONTACT_RESTORED' THEN 'Restored from trash'
                     WHEN 'TAG_ADDED' THEN CASE WHEN bulk THEN 'Tag added (bulk)' ELSE 'Tag added' END
                     WHEN 'TAG_REMOVED' THEN 'Tag removed' END AS title,
           CASE WHEN type IN ('TAG_ADDED', 'TAG_REMOVED') THEN json_extract_string(payload, '$.tag.name')
                WHEN type = 'CONTACT_UPDATED' THEN {_CHANGE_TEXT} END AS detail
    FROM (SELECT *, coalesce(CAST(json_extract(payload, '$.bulk') AS BOOLEAN), false) AS bulk FROM (
            SELECT contact_id, type, payload FROM contact_activity
            UNION ALL ({APPLIED_ACTIVITY_SQL})) a) x""", extra_ctes=_ACC + "," + _FOLD_CTES)
