"""Registered metric queries (A-operators, W4, W5) and their DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rolodeck.operators import metrics as M
from rolodeck.operators import predicates as P
from rolodeck.plans.oracle_fixtures import with_fixtures
from rolodeck.sources.fixtures import AS_OF, load_model

RANGE = 30
_start, _prev, _first, _last = M.window_bounds(AS_OF, RANGE)
START = f"TIMESTAMP '{_start:%Y-%m-%d %H:%M:%S}'"
PREV = f"TIMESTAMP '{_prev:%Y-%m-%d %H:%M:%S}'"
STALE = f"TIMESTAMP '{AS_OF - dt.timedelta(days=P.STALE_DAYS):%Y-%m-%d %H:%M:%S}'"
FIRST_DAY = f"DATE '{_first:%Y-%m-%d}'"
LAST_DAY = f"DATE '{_last:%Y-%m-%d}'"


def q_quality_pack(spark, sf):
    m = load_model(spark, sf)
    return M.quality_pack(m.contacts, m.contact_tags, AS_OF, RANGE)


def q_created_by_day(spark, sf):
    return M.created_by_day(load_model(spark, sf).contacts, AS_OF, RANGE)


def q_edits_by_day(spark, sf):
    return M.edits_by_day(load_model(spark, sf).activity, AS_OF, RANGE)


def q_activity_by_type(spark, sf):
    return M.activity_by_type(load_model(spark, sf).activity, AS_OF, RANGE)


def q_top_tags(spark, sf):
    m = load_model(spark, sf)
    return M.top_tags(m.contacts, m.tags, m.contact_tags)


def q_tag_link_join(spark, sf):
    m = load_model(spark, sf)
    return M.tag_link_join(m.contacts, m.tags, m.contact_tags)


def q_duplicate_phone_groups(spark, sf):
    return M.duplicate_phone_groups(load_model(spark, sf).contacts)


def q_trash_count(spark, sf):
    return M.trash_count(load_model(spark, sf).contacts)


def q_import_rollup(spark, sf):
    return M.import_rollup(load_model(spark, sf).import_jobs, AS_OF, RANGE)


def q_metrics_ratios(spark, sf):
    m = load_model(spark, sf)
    return M.metrics_ratios(M.quality_pack(m.contacts, m.contact_tags, AS_OF, RANGE), M.import_rollup(m.import_jobs, AS_OF, RANGE))


def q_daily_series(spark, sf):
    m = load_model(spark, sf)
    return M.daily_series(m.contacts, m.activity, AS_OF, RANGE)


def q_trash_metrics(spark, sf):
    m = load_model(spark, sf)
    return M.trash_metrics(m.contacts, m.activity, AS_OF, RANGE)


def document(spark, sf):
    m = load_model(spark, sf)
    return M.metrics_document(m.contacts, m.tags, m.contact_tags, m.activity, m.import_jobs, AS_OF, RANGE)


def q_metrics_document(spark, sf):
    return flat_document(document(spark, sf))


def flat_document(doc):
    """The document's members as columns, its lists as text."""
    members = [F.col(f"{part}.{f.name}").alias(f"{part}_{f.name}") for part in ("contacts", "quality", "trash", "imports") for f in doc.schema[part].dataType.fields]
    lists = {part: F.array_join(F.transform(part, lambda x: F.concat_ws("=", *[x[f.name].cast("string") for f in doc.schema[part].dataType.elementType.fields])), ";") for part in ("tags", "daily", "activity")}
    return doc.select("account_id", "range", *members, *[c.alias(n) for n, c in lists.items()])


def q_attention_counts(spark, sf):
    m = load_model(spark, sf)
    return M.attention_counts(m.contacts, m.contact_tags, AS_OF)


def q_accounts_overview(spark, sf):
    return M.accounts_overview(load_model(spark, sf).contacts)


def q_saved_view_counts(spark, sf):
    m = load_model(spark, sf)
    return M.saved_view_counts(m.contacts, m.tags, m.contact_tags, AS_OF)


def q_active_trend(spark, sf):
    m = load_model(spark, sf)
    return M.active_trend(m.contacts, m.activity, AS_OF, RANGE)


def q_latest_activity_per_contact(spark, sf):
    return M.latest_activity_per_contact(load_model(spark, sf).activity, 20)


QUERIES = {
    "quality_pack": q_quality_pack,
    "created_by_day": q_created_by_day,
    "edits_by_day": q_edits_by_day,
    "activity_by_type": q_activity_by_type,
    "top_tags": q_top_tags,
    "tag_link_join": q_tag_link_join,
    "duplicate_phone_groups": q_duplicate_phone_groups,
    "trash_count": q_trash_count,
    "import_rollup": q_import_rollup,
    "metrics_ratios": q_metrics_ratios,
    "daily_series": q_daily_series,
    "trash_metrics": q_trash_metrics,
    "metrics_document": q_metrics_document,
    "attention_counts": q_attention_counts,
    "accounts_overview": q_accounts_overview,
    "saved_view_counts": q_saved_view_counts,
    "active_trend": q_active_trend,
    "latest_activity_per_contact": q_latest_activity_per_contact,
}

# Each active contact states the facts that hold for it; the measures are how often each fact is stated.
_QUALITY = f"""
SELECT account_id, count(CASE fact WHEN 'active' THEN 1 END) AS active, count(CASE fact WHEN 'new' THEN 1 END) AS new_in_range,
       count(CASE fact WHEN 'before' THEN 1 END) AS new_prev, count(CASE fact WHEN 'email' THEN 1 END) AS with_email,
       count(CASE fact WHEN 'phone' THEN 1 END) AS with_phone, count(CASE fact WHEN 'company' THEN 1 END) AS with_company,
       count(CASE fact WHEN 'unreachable' THEN 1 END) AS no_contact, count(CASE fact WHEN 'bare' THEN 1 END) AS untagged,
       count(CASE fact WHEN 'old' THEN 1 END) AS stale
FROM (
  SELECT live.account_id, unnest([
           'active', CASE WHEN live.created_at >= {START} THEN 'new' WHEN live.created_at >= {PREV} THEN 'before' END,
           CASE WHEN live.email IS NULL THEN NULL ELSE 'email' END, CASE WHEN live.phone IS NULL THEN NULL ELSE 'phone' END,
           CASE WHEN live.company IS NULL THEN NULL ELSE 'company' END, CASE WHEN coalesce(live.email, live.phone) IS NULL THEN 'unreachable' END,
           CASE WHEN worn.contact_id IS NULL THEN 'bare' END, CASE WHEN live.updated_at < {STALE} THEN 'old' END]) AS fact
  FROM (SELECT * FROM contacts WHERE deleted_at IS NULL) live
  LEFT JOIN (SELECT DISTINCT contact_id FROM contact_tags) worn ON worn.contact_id = live.id)
GROUP BY account_id
"""

# Every active contact knows how many share its number.
_DUP = """
SELECT account_id, count(DISTINCT phone_digits) AS groups, count(*) AS contacts
FROM (SELECT account_id, phone_digits, count(*) OVER (PARTITION BY account_id, phone_digits) AS sharing
      FROM contacts WHERE deleted_at IS NULL AND length(phone_digits) > 0)
WHERE sharing >= 2 GROUP BY account_id
"""

# One row per account and status, turned into one per account.
_ROLLUP = f"""
SELECT account_id, sum(n)::BIGINT AS jobs, coalesce(max(CASE status WHEN 'completed' THEN n END), 0) AS completed,
       coalesce(max(CASE status WHEN 'failed' THEN n END), 0) AS failed, coalesce(max(CASE status WHEN 'completed' THEN c END), 0)::BIGINT AS created,
       coalesce(max(CASE status WHEN 'completed' THEN u END), 0)::BIGINT AS updated, coalesce(max(CASE status WHEN 'completed' THEN s END), 0)::BIGINT AS unchanged,
       coalesce(max(CASE status WHEN 'completed' THEN e END), 0)::BIGINT AS rejected, coalesce(max(CASE status WHEN 'completed' THEN t END), 0)::BIGINT AS submitted
FROM (SELECT account_id, status, count(*) AS n, sum(created_count) AS c, sum(updated_count) AS u, sum(unchanged_count) AS s, sum(error_rows) AS e,
             sum(total_rows) AS t FROM import_jobs WHERE NOT created_at < {START} GROUP BY ALL)
GROUP BY account_id
"""

_SERIES = f"""
SELECT a.account_id, strftime(d.day, '%Y-%m-%d') AS date,
       coalesce(cr.n, 0)::BIGINT AS created, coalesce(ed.n, 0)::BIGINT AS edits
FROM (SELECT account_id FROM contacts UNION SELECT account_id FROM contact_activity) a
CROSS JOIN (SELECT unnest(generate_series({FIRST_DAY}, {LAST_DAY}, INTERVAL 1 DAY)) AS day) d
LEFT JOIN (SELECT account_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM contacts
           WHERE deleted_at IS NULL AND created_at >= {START} GROUP BY 1, 2) cr
  ON cr.account_id = a.account_id AND cr.day = d.day
LEFT JOIN (SELECT account_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM contact_activity
           WHERE type = 'CONTACT_UPDATED' AND created_at >= {START} GROUP BY 1, 2) ed
  ON ed.account_id = a.account_id AND ed.day = d.day
"""

_TOP_TAGS = """
SELECT tags.account_id, tags.id AS tag_id, tags.name, used.n,
       row_number() OVER (PARTITION BY tags.account_id ORDER BY used.n DESC, lower(tags.name), tags.id) AS rank
FROM tags, (SELECT tag_id, count(*) AS n FROM contact_tags
            WHERE contact_id NOT IN (SELECT id FROM contacts WHERE deleted_at IS NOT NULL) GROUP BY tag_id) used
WHERE used.tag_id = tags.id
QUALIFY rank <= {k}
"""

def _Z(x: str, name: str) -> str:  # noqa: N802
    return f'CAST(coalesce({x}, 0) AS BIGINT) AS "{name}"'


ORACLE = {
    "quality_pack": with_fixtures(_QUALITY),
    "created_by_day": with_fixtures(f"""
        SELECT account_id, strftime(created_at, '%Y-%m-%d') AS d, count(*) AS n FROM contacts
        WHERE deleted_at IS NULL AND created_at >= {START} GROUP BY 1, 2"""),
    "edits_by_day": with_fixtures(f"""
        SELECT account_id, strftime(created_at, '%Y-%m-%d') AS d, count(*) AS n FROM contact_activity
        WHERE type = 'CONTACT_UPDATED' AND created_at >= {START} GROUP BY 1, 2"""),
    "activity_by_type": with_fixtures(f"""
        SELECT account_id, type, count(*) AS n,
               row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, type) AS rank
        FROM contact_activity WHERE created_at >= {START} GROUP BY account_id, type"""),
    "top_tags": with_fixtures(_TOP_TAGS.format(k=10)),
    "tag_link_join": with_fixtures("""
        SELECT t.account_id, ct.tag_id, t.name, ct.contact_id
        FROM contact_tags ct JOIN tags t ON t.id = ct.tag_id
        JOIN contacts c ON c.id = ct.contact_id AND c.deleted_at IS NULL"""),
    "duplicate_phone_groups": with_fixtures(_DUP),
    "trash_count": with_fixtures("""
        SELECT account_id, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS n FROM contacts GROUP BY account_id"""),
    "import_rollup": with_fixtures(_ROLLUP),
    "metrics_ratios": with_fixtures(f"""
        SELECT q.account_id,
               CASE WHEN q.new_prev > 0 THEN floor((q.new_in_range - q.new_prev) / q.new_prev * 1000 + 0.5) / 10 END AS change_pct,
               q.active - q.no_contact AS reachable,
               CASE WHEN coalesce(i.submitted, 0) > 0
                    THEN floor((i.created + i.updated + i.unchanged) / i.submitted * 1000 + 0.5) / 10 END AS accept_rate,
               CASE WHEN q.active > 0 THEN floor(q.with_email / q.active * 1000 + 0.5) / 10 ELSE 0.0 END AS email_pct,
               CASE WHEN q.active > 0 THEN floor(q.with_phone / q.active * 1000 + 0.5) / 10 ELSE 0.0 END AS phone_pct,
               CASE WHEN q.active > 0 THEN floor(q.with_company / q.active * 1000 + 0.5) / 10 ELSE 0.0 END AS company_pct
        FROM q LEFT JOIN i ON i.account_id = q.account_id""",
        extra_ctes=f"q AS ({_QUALITY}), i AS ({_ROLLUP})"),
    "daily_series": with_fixtures(_SERIES),
    "trash_metrics": with_fixtures(f"""
        SELECT coalesce(c.account_id, e.account_id) AS account_id,
               coalesce(c.current, 0) AS current, coalesce(e.deleted, 0) AS deleted, coalesce(e.restored, 0) AS restored
        FROM (SELECT account_id, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS current FROM contacts GROUP BY 1) c
        FULL JOIN (SELECT account_id, count(*) FILTER (WHERE type = 'CONTACT_DELETED') AS deleted,
                          count(*) FILTER (WHERE type = 'CONTACT_RESTORED') AS restored
                   FROM contact_activity WHERE created_at >= {START} GROUP BY 1) e ON e.account_id = c.account_id"""),
    "metrics_document": with_fixtures(f"""
        SELECT a.account_id, CAST({RANGE} AS INTEGER) AS "range",
               {_Z("q.active", "contacts_active")}, {_Z("q.new_in_range", "contacts_newInRange")}, {_Z("q.new_prev", "contacts_newPrevRange")},
               CASE WHEN q.new_prev > 0 THEN floor((q.new_in_range - q.new_prev) / q.new_prev * 1000 + 0.5) / 10 END AS "contacts_changePct", {_Z("t.n", "contacts_inTrash")},
               {_Z("q.with_email", "quality_withEmail")}, {_Z("q.with_phone", "quality_withPhone")}, {_Z("q.with_company", "quality_withCompany")}, {_Z("q.no_contact", "quality_noContactInfo")},
               {_Z("q.active - q.no_contact", "quality_reachable")}, {_Z("q.untagged", "quality_untagged")}, {_Z("q.stale", "quality_stale")}, CAST(90 AS INTEGER) AS "quality_staleDays",
               {_Z("d.contacts", "quality_duplicatePhoneContacts")}, {_Z("d.groups", "quality_duplicatePhoneGroups")},
               {_Z("t.n", "trash_current")}, {_Z("e.deleted", "trash_deletedInRange")}, {_Z("e.restored", "trash_restoredInRange")},
               {_Z("i.jobs", "imports_jobs")}, {_Z("i.completed", "imports_completed")}, {_Z("i.failed", "imports_failed")}, {_Z("i.created", "imports_rowsCreated")},
               {_Z("i.updated", "imports_rowsUpdated")}, {_Z("i.rejected", "imports_rowsRejected")}, {_Z("i.submitted", "imports_rowsSubmitted")},
               CASE WHEN i.submitted > 0 THEN floor((i.created + i.updated + i.unchanged) / i.submitted * 1000 + 0.5) / 10 END AS "imports_acceptRate",
               coalesce(tt.x, '') AS tags, coalesce(s.x, '') AS daily, coalesce(ty.x, '') AS activity
        FROM (SELECT account_id FROM contacts UNION SELECT account_id FROM contact_activity UNION SELECT account_id FROM import_jobs) a
        LEFT JOIN q USING (account_id) LEFT JOIN d USING (account_id) LEFT JOIN i USING (account_id)
        LEFT JOIN (SELECT account_id, count(deleted_at) AS n FROM contacts GROUP BY 1) t USING (account_id)
        LEFT JOIN (SELECT account_id, count(CASE type WHEN 'CONTACT_DELETED' THEN 1 END) AS deleted, count(CASE type WHEN 'CONTACT_RESTORED' THEN 1 END) AS restored
                   FROM contact_activity WHERE created_at >= {START} GROUP BY 1) e USING (account_id)
        LEFT JOIN (SELECT account_id, string_agg(name || '=' || n, ';' ORDER BY rank) AS x FROM tt10 GROUP BY 1) tt USING (account_id)
        LEFT JOIN (SELECT account_id, string_agg(date || '=' || created || '=' || edits, ';' ORDER BY date) AS x FROM series GROUP BY 1) s USING (account_id)
        LEFT JOIN (SELECT account_id, string_agg(type || '=' || n, ';' ORDER BY n DESC, type) AS x
                   FROM (SELECT account_id, type, count(*) AS n FROM contact_activity WHERE created_at >= {START} GROUP BY 1, 2) GROUP BY 1) ty USING (account_id)""",
        extra_ctes=f"q AS ({_QUALITY}), d AS ({_DUP}), i AS ({_ROLLUP}), tt10 AS ({_TOP_TAGS.format(k=10)}), series AS ({_SERIES})"),
    "attention_counts": with_fixtures("""
        SELECT account_id, 'no_contact_info' AS filter, no_contact AS n FROM q
        UNION ALL SELECT account_id, 'untagged', untagged FROM q
        UNION ALL SELECT account_id, 'stale', stale FROM q
        UNION ALL SELECT q.account_id, 'duplicate_phone', coalesce(d.contacts, 0)::BIGINT FROM q LEFT JOIN d ON d.account_id = q.account_id""",
        extra_ctes=f"q AS ({_QUALITY}), d AS ({_DUP})"),
    "accounts_overview": with_fixtures("SELECT account_id, count(*) AS n FROM contacts GROUP BY account_id"),
    "saved_view_counts": with_fixtures("""
        SELECT account_id, 'All' AS view, active AS n FROM q
        UNION ALL SELECT account_id, 'Untagged', untagged FROM q
        UNION ALL SELECT account_id, 'No contact info', no_contact FROM q
        UNION ALL SELECT account_id, name, n FROM tt""",
        extra_ctes=f"q AS ({_QUALITY}), tt AS ({_TOP_TAGS.format(k=3)})"),
    "active_trend": with_fixtures("""
        SELECT s.account_id, s.date,
               a.active_now - coalesce(sum(s.created) OVER (PARTITION BY s.account_id ORDER BY s.date
                                       ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS active
        FROM s JOIN (SELECT account_id, count(*) FILTER (WHERE deleted_at IS NULL) AS active_now FROM contacts GROUP BY 1) a
          ON a.account_id = s.account_id""",
        extra_ctes=f"s AS ({_SERIES})"),
    "latest_activity_per_contact": with_fixtures("""
        SELECT contact_id, rank, id, type, payload, created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY created_at DESC, id DESC) AS rank
          FROM contact_activity) x WHERE rank <= 20"""),
}
