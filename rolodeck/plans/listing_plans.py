"""Registered list / search / paging queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rolodeck.operators import listing as L
from rolodeck.operators import metrics as M
from rolodeck.operators import predicates as P
from rolodeck.plans.oracle_fixtures import with_fixtures
from rolodeck.sources.contacts import PUBLIC_COLUMNS, scan_contacts
from rolodeck.sources.fixtures import AS_OF, load_model, raw

OUT = ["account_id"] + [c for c, _ in PUBLIC_COLUMNS]
OUT_SQL = ", ".join(f"c.{c}" for c in OUT)
STALE = f"TIMESTAMP '{AS_OF - dt.timedelta(days=P.STALE_DAYS):%Y-%m-%d %H:%M:%S}'"

# Parameters of the registered list queries
SEARCH_TERM = "ring"
PHONE_TERM = "(555) 045"
WILDCARD_TERMS = ["t_", "%%", "g.r", "a\\b", "ring", "_ring"]
COMPANY = "brand#1"
CREATED_FROM, CREATED_TO = dt.datetime(2023, 6, 1), dt.datetime(2023, 12, 31, 23, 59, 59)
ANY_TAGS = ["urgent", "Low"]
COMBINED = L.ListQuery(q="re", tags=["URGENT", "high"], company="brand", created_from=dt.datetime(2020, 1, 1),
                       created_to=dt.datetime(2024, 1, 31), sort="name", order="asc", limit=25)
PAGE_CURSOR = L.encode_cursor("name", "asc", "ring blue", 2)
PAGE = L.ListQuery(sort="name", order="asc", limit=20, cursor=PAGE_CURSOR)
TRASH = L.ListQuery(status="deleted", limit=5)
TAG_PREFIX = "n"
QUICK = "ri"
NEWEST = 500


def _m(spark, sf):
    return load_model(spark, sf)


def _pub(df):
    return df.select(*OUT)


def q_scan_contacts(spark, sf):
    return scan_contacts(_m(spark, sf).contacts)


def q_tenant_scope(spark, sf):
    return _pub(P.for_account(_m(spark, sf).contacts, 1))


def q_status_filter(spark, sf):
    return _pub(P.with_status(_m(spark, sf).contacts, "deleted"))


def q_search_text(spark, sf):
    c = _m(spark, sf).contacts
    return _pub(c.filter(P.is_active() & P.search_predicate(SEARCH_TERM)))


def q_search_phone(spark, sf):
    c = _m(spark, sf).contacts
    return _pub(c.filter(P.is_active() & P.search_predicate(PHONE_TERM)))


def q_literal_wildcards(spark, sf):
    c = _m(spark, sf).contacts.filter(P.is_active())
    out = None
    for t in WILDCARD_TERMS:
        n = c.filter(P.search_predicate(t)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("term"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def q_company_contains(spark, sf):
    return _pub(_m(spark, sf).contacts.filter(P.is_active() & P.company_predicate(COMPANY)))


def q_created_between(spark, sf):
    return _pub(_m(spark, sf).contacts.filter(P.is_active() & P.created_between(CREATED_FROM, CREATED_TO)))


def _attention(which):
    def q(spark, sf):
        m = _m(spark, sf)
        return P.attention(m.contacts, m.contact_tags, which, AS_OF).select("account_id", "id")

    return q


def q_list_combined(spark, sf):
    m = _m(spark, sf)
    return L.keyset_page(m.contacts, m.tags, m.contact_tags, COMBINED, AS_OF).select(*OUT, "pos", "has_more", "next_cursor")


def q_list_total(spark, sf):
    m = _m(spark, sf)
    return L.list_total(m.contacts, m.tags, m.contact_tags, COMBINED, AS_OF)


def q_keyset_page(spark, sf):
    m = _m(spark, sf)
    return L.keyset_page(m.contacts, m.tags, m.contact_tags, PAGE, AS_OF).select(*OUT, "pos", "has_more", "next_cursor")


def q_trash_page(spark, sf):
    m = _m(spark, sf)
    return L.keyset_page(m.contacts, m.tags, m.contact_tags, TRASH, AS_OF).select(*OUT, "pos", "has_more", "next_cursor")


def q_point_lookup(spark, sf):
    m = _m(spark, sf)
    one = L.point_lookup(m.contacts, 0, 0)
    return L.with_tags(one, m.contact_tags, m.tags).select(
        *OUT, F.array_join(F.transform("tags", lambda t: t["name"]), ";").alias("tags")
    )


def _requested_ids(spark, sf):
    """A requested-id list from all orders: even ids, most of them unknown."""
    return raw(spark, sf, "orders").select((2 * F.col("o_orderkey")).alias("id"))


def q_id_in_list(spark, sf):
    return _pub(L.id_in_list(_m(spark, sf).contacts, _requested_ids(spark, sf)))


def q_tag_prefix(spark, sf):
    return L.tag_prefix(_m(spark, sf).tags, TAG_PREFIX)


def q_tags_any_of(spark, sf):
    m = _m(spark, sf)
    return _pub(L.with_any_tag(m.contacts.filter(P.is_active()), m.tags, m.contact_tags, ANY_TAGS))


def q_contact_tag_list(spark, sf):
    m = _m(spark, sf)
    return L.contact_tag_list(m.contact_tags, m.tags).select(
        "contact_id",
        F.array_join(F.transform("tags", lambda t: t["name"]), ";").alias("tags"),
        F.array_join(F.transform("tags", lambda t: t["id"].cast("string")), ";").alias("tag_ids"),
    )


def q_sort_contacts(spark, sf):
    return L.sort_contacts(_m(spark, sf).contacts, "name", "asc").select(*OUT, "pos")


def q_page_numbers(spark, sf):
    return L.page_numbers(_m(spark, sf).contacts, "createdAt", "desc", 25)


def q_page_cursors(spark, sf):
    return L.page_cursors(_m(spark, sf).contacts, "name", "asc", 25)


def q_import_history(spark, sf):
    return L.import_history(_m(spark, sf).import_jobs, 50).select("account_id", "id", "status", "created_at", "rank")


def q_random_sample(spark, sf):
    return L.random_sample(_m(spark, sf).contacts, 100, 42)


def q_newest_n(spark, sf):
    return L.newest_n(_m(spark, sf).contacts, NEWEST, per_account=False)


def q_quick_search_rank(spark, sf):
    return L.quick_search_rank(_m(spark, sf).contacts, QUICK)


def q_bounded_count(spark, sf):
    c = _m(spark, sf).contacts
    return M.bounded_count(P.with_status(P.for_account(c, 0), "active"), 10_000)


QUERIES = {
    "scan_contacts": q_scan_contacts,
    "tenant_scope": q_tenant_scope,
    "status_filter": q_status_filter,
    "search_text": q_search_text,
    "search_phone": q_search_phone,
    "literal_wildcards": q_literal_wildcards,
    "company_contains": q_company_contains,
    "created_between": q_created_between,
    "attention_no_contact_info": _attention("no_contact_info"),
    "attention_stale": _attention("stale"),
    "attention_untagged": _attention("untagged"),
    "attention_duplicate_phone": _attention("duplicate_phone"),
    "list_combined": q_list_combined,
    "list_total": q_list_total,
    "keyset_page": q_keyset_page,
    "trash_page": q_trash_page,
    "point_lookup": q_point_lookup,
    "id_in_list": q_id_in_list,
    "tag_prefix": q_tag_prefix,
    "tags_any_of": q_tags_any_of,
    "contact_tag_list": q_contact_tag_list,
    "sort_contacts": q_sort_contacts,
    "page_numbers": q_page_numbers,
    "page_cursors": q_page_cursors,
    "import_history": q_import_history,
    "random_sample": q_random_sample,
    "newest_n": q_newest_n,
    "quick_search_rank": q_quick_search_rank,
    "bounded_count": q_bounded_count,
}


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _search_sql(term: str) -> str:
    lower, phone = P.search_terms(term)
    cond = f"(coalesce(strpos(c.search_name, {_sql_str(lower)}) > 0 OR strpos(c.email, {_sql_str(lower)}) > 0, false)"
    if phone:
        cond += f" OR strpos(c.phone_digits, {_sql_str(phone)}) > 0"
    return cond + ")"


def _cursor_sql(sort_key_text: str, ordering: str) -> str:
    js = f"json_object('s', '{ordering}', 'v', {sort_key_text}, 'id', CAST(c.id AS VARCHAR))::VARCHAR"
    return f"rtrim(translate(to_base64(encode({js})), '+/', '-_'), '=')"


def _combined_where() -> str:
    q = COMBINED
    tags = ", ".join(_sql_str(t.lower()) for t in q.tags)
    return f"""c.deleted_at IS NULL AND {_search_sql(q.q)}
      AND strpos(c.company_lower, {_sql_str(q.company)}) > 0
      AND c.created_at >= TIMESTAMP '{q.created_from:%Y-%m-%d %H:%M:%S}' AND c.created_at <= TIMESTAMP '{q.created_to:%Y-%m-%d %H:%M:%S}'
      AND EXISTS (SELECT 1 FROM contact_tags ct JOIN tags t ON t.id = ct.tag_id
                  WHERE ct.contact_id = c.id AND lower(t.name) IN ({tags}))"""


def _page_sql(where: str, key: str, key_text: str, direction: str, limit: int, ordering: str) -> str:
    return f"""
SELECT {", ".join(OUT)}, pos, has_more,
       CASE WHEN has_more AND pos = {limit} THEN cur END AS next_cursor
FROM (
  SELECT {OUT_SQL},
         row_number() OVER (PARTITION BY c.account_id ORDER BY c.{key} {direction}, c.id {direction}) AS pos,
         count(*) OVER (PARTITION BY c.account_id) > {limit} AS has_more,
         {_cursor_sql(key_text, ordering)} AS cur
  FROM (SELECT * FROM contacts c WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY c.account_id ORDER BY c.{key} {direction}, c.id {direction}) <= {limit + 1}) c
) x WHERE pos <= {limit}"""


_TAGGED_NAME = """
SELECT ct.contact_id, string_agg(t.name, ';' ORDER BY lower(t.name), t.id) AS tags,
       string_agg(CAST(t.id AS VARCHAR), ';' ORDER BY lower(t.name), t.id) AS tag_ids
FROM contact_tags ct JOIN tags t ON t.id = ct.tag_id GROUP BY ct.contact_id"""

ORACLE = {
    "scan_contacts": with_fixtures("""
        SELECT account_id AS accountId, id, first_name AS firstName, last_name AS lastName, email, phone, company,
               version, created_at AS createdAt, updated_at AS updatedAt, deleted_at AS deletedAt FROM contacts"""),
    "tenant_scope": with_fixtures(f"SELECT {OUT_SQL} FROM contacts c WHERE c.account_id = 1"),
    "status_filter": with_fixtures(f"SELECT {OUT_SQL} FROM contacts c WHERE c.deleted_at IS NOT NULL"),
    "search_text": with_fixtures(f"SELECT {OUT_SQL} FROM contacts c WHERE c.deleted_at IS NULL AND {_search_sql(SEARCH_TERM)}"),
    "search_phone": with_fixtures(f"SELECT {OUT_SQL} FROM contacts c WHERE c.deleted_at IS NULL AND {_search_sql(PHONE_TERM)}"),
    "literal_wildcards": with_fixtures(" UNION ALL ".join(
        f"SELECT {_sql_str(t)} AS term, count(*) AS n FROM contacts c WHERE c.deleted_at IS NULL AND {_search_sql(t)}"
        for t in WILDCARD_TERMS)),
    "company_contains": with_fixtures(
        f"SELECT {OUT_SQL} FROM contacts c WHERE c.deleted_at IS NULL AND strpos(c.company_lower, {_sql_str(COMPANY)}) > 0"),
    "created_between": with_fixtures(f"""
        SELECT {OUT_SQL} FROM contacts c WHERE c.deleted_at IS NULL
          AND c.created_at >= TIMESTAMP '{CREATED_FROM:%Y-%m-%d %H:%M:%S}' AND c.created_at <= TIMESTAMP '{CREATED_TO:%Y-%m-%d %H:%M:%S}'"""),
    "attention_no_contact_info": with_fixtures(
        "SELECT account_id, id FROM contacts WHERE deleted_at IS NULL AND email IS NULL AND phone IS NULL"),
    "attention_stale": with_fixtures(f"SELECT account_id, id FROM contacts WHERE deleted_at IS NULL AND updated_at < {STALE}"),
    "attention_untagged": with_fixtures("""
        SELECT account_id, id FROM contacts c WHERE deleted_at IS NULL
          AND NOT EXISTS (SELECT 1 FROM contact_tags ct WHERE ct.contact_id = c.id)"""),
    "attention_duplicate_phone": with_fixtures("""
        SELECT account_id, id FROM contacts c WHERE c.deleted_at IS NULL AND c.phone_digits <> ''
          AND c.phone_digits IN (SELECT d.phone_digits FROM contacts d WHERE d.account_id = c.account_id
                                 AND d.deleted_at IS NULL AND d.phone_digits <> '' GROUP BY d.phone_digits HAVING count(*) > 1)"""),
    "list_combined": with_fixtures(_page_sql(_combined_where(), "name_sort", "c.name_sort", "ASC", COMBINED.limit, "name:asc")),
    "list_total": with_fixtures(f"""
        SELECT account_id, least(count(*), 10000)::BIGINT AS total, count(*) > 10000 AS total_capped
        FROM contacts c WHERE {_combined_where()} GROUP BY account_id"""),
    "keyset_page": with_fixtures(_page_sql(
        "c.deleted_at IS NULL AND c.name_sort >= 'ring blue' AND (c.name_sort > 'ring blue' OR c.id > 2)",
        "name_sort", "c.name_sort", "ASC", PAGE.limit, "name:asc")),
    "trash_page": with_fixtures(_page_sql(
        "c.deleted_at IS NOT NULL", "deleted_at", "strftime(c.deleted_at, '%Y-%m-%d %H:%M:%S.%f')", "DESC", TRASH.limit,
        "deletedAt:desc")),
    "point_lookup": with_fixtures(f"""
        SELECT {OUT_SQL}, coalesce(tl.tags, '') AS tags FROM contacts c LEFT JOIN tl ON tl.contact_id = c.id
        WHERE c.id = 0 AND c.account_id = 0""", extra_ctes=f"tl AS ({_TAGGED_NAME})"),
    "id_in_list": with_fixtures(f"""
        SELECT {OUT_SQL} FROM contacts c WHERE c.id IN (SELECT 2 * o_orderkey FROM orders)"""),
    "tag_prefix": with_fixtures(f"""
        SELECT account_id, id, name, row_number() OVER (PARTITION BY account_id ORDER BY lower(name), id) AS rank
        FROM tags WHERE starts_with(lower(name), {_sql_str(TAG_PREFIX)}) QUALIFY rank <= 200"""),
    "tags_any_of": with_fixtures(f"""
        SELECT {OUT_SQL} FROM contacts c WHERE c.deleted_at IS NULL AND EXISTS (
          SELECT 1 FROM contact_tags ct JOIN tags t ON t.id = ct.tag_id
          WHERE ct.contact_id = c.id AND lower(t.name) IN ({", ".join(_sql_str(t.lower()) for t in ANY_TAGS)}))"""),
    "contact_tag_list": with_fixtures(_TAGGED_NAME),
    "sort_contacts": with_fixtures(f"""
        SELECT {OUT_SQL}, row_number() OVER (PARTITION BY c.account_id ORDER BY c.name_sort, c.id) AS pos
        FROM contacts c WHERE c.deleted_at IS NULL"""),
    "page_numbers": with_fixtures("""
        SELECT account_id, id, pos, CAST(floor((pos - 1) / 25) AS BIGINT) AS page FROM (
          SELECT account_id, id, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, id DESC) AS pos
          FROM contacts WHERE deleted_at IS NULL) x"""),
    "page_cursors": with_fixtures(f"""
        SELECT account_id, CAST(pos / 25 - 1 AS BIGINT) AS page, cur AS cursor FROM (
          SELECT c.account_id, row_number() OVER (PARTITION BY c.account_id ORDER BY c.name_sort, c.id) AS pos,
                 count(*) OVER (PARTITION BY c.account_id) AS size, {_cursor_sql("c.name_sort", "name:asc")} AS cur
          FROM contacts c WHERE c.deleted_at IS NULL) x WHERE pos % 25 = 0 AND pos < size"""),
    "import_history": with_fixtures("""
        SELECT account_id, id, status, created_at,
               row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, id DESC) AS rank
        FROM import_jobs QUALIFY rank <= 50"""),
    "newest_n": with_fixtures(f"SELECT account_id, id, created_at FROM contacts ORDER BY created_at DESC, id DESC LIMIT {NEWEST}"),
    "random_sample": with_fixtures("SELECT id FROM contacts ORDER BY md5('42:' || id), id LIMIT 100"),
    "quick_search_rank": with_fixtures(f"""
        SELECT account_id, pos, match_rank, id, name FROM (
          SELECT account_id, id, first_name || ' ' || last_name AS name, match_rank,
                 row_number() OVER (PARTITION BY account_id ORDER BY match_rank, fetch_pos) AS pos
          FROM (
            SELECT c.*, row_number() OVER (PARTITION BY c.account_id ORDER BY c.name_sort, c.id) AS fetch_pos,
                   CASE WHEN starts_with(c.search_name, {_sql_str(QUICK)}) THEN 0
                        WHEN starts_with(lower(c.last_name), {_sql_str(QUICK)}) OR coalesce(starts_with(c.email, {_sql_str(QUICK)}), false) THEN 1
                        ELSE 2 END AS match_rank
            FROM contacts c WHERE c.deleted_at IS NULL AND {_search_sql(QUICK)}
          ) f WHERE fetch_pos <= 15
        ) r WHERE pos <= 6"""),
    "bounded_count": with_fixtures("""
        SELECT least(count(*), 10000)::BIGINT AS total, count(*) > 10000 AS total_capped
        FROM (SELECT 1 FROM contacts WHERE account_id = 0 AND deleted_at IS NULL LIMIT 10001) x"""),
}
