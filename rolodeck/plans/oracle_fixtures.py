"""DuckDB SQL for the derived contact model (FIXTURES.md §1).

Each oracle query is ``WITH <these CTEs> SELECT ...`` over the driver's
pre-registered raw views. This is the independent SQL twin of
``rolodeck.sources.fixtures``; it is only used for cross-checking.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2024-01-31 12:00:00'"

FIXTURE_CTES = r"""
ord_span AS (
  SELECT o_custkey, min_by(o_orderdate, o_orderkey) AS first_order, max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey
),
contacts_base AS (
  SELECT c.c_custkey AS id,
         CAST(c.c_nationkey % 2 AS INTEGER) AS account_id,
         split_part(p.p_name, ' ', 1) AS first_name,
         split_part(p.p_name, ' ', 2) AS last_name,
         CASE WHEN c.c_custkey % 13 = 3 THEN NULL
              ELSE lower(split_part(p.p_name, ' ', 1) || '.' || split_part(p.p_name, ' ', 2) || '.' ||
                         CAST(c.c_custkey AS VARCHAR) || '@' || c.c_mktsegment || '.test') END AS email,
         CASE WHEN c.c_custkey % 7 = 3 THEN NULL
              WHEN c.c_custkey % 2 = 0 THEN '+1 (555) ' || substr(lpad(CAST(CAST(floor(abs(c.c_acctbal)) AS BIGINT) AS VARCHAR), 5, '0'), 1, 3)
                   || '-' || substr(lpad(CAST(CAST(floor(abs(c.c_acctbal)) AS BIGINT) AS VARCHAR), 5, '0'), 4, 2) || '00'
              ELSE '1-555-' || substr(lpad(CAST(CAST(floor(abs(c.c_acctbal)) AS BIGINT) AS VARCHAR), 5, '0'), 1, 3)
                   || '.' || substr(lpad(CAST(CAST(floor(abs(c.c_acctbal)) AS BIGINT) AS VARCHAR), 5, '0'), 4, 2) || '00' END AS phone,
         CASE WHEN c.c_custkey % 10 = 4 THEN NULL ELSE p.p_brand || ' ' || c.c_mktsegment END AS company,
         CAST(1 + c.c_custkey % 3 AS INTEGER) AS version,
         o.first_order + INTERVAL 8218 DAY AS created_at,
         o.last_order + INTERVAL 8218 DAY AS updated_at,
         CASE WHEN c.c_custkey % 50 = 7 THEN o.last_order + INTERVAL 8218 DAY END AS deleted_at
  FROM customer c JOIN part p ON p.p_partkey = c.c_custkey JOIN ord_span o ON o.o_custkey = c.c_custkey
),
contacts AS (
  SELECT *,
         lower(last_name) || ' ' || lower(first_name) AS name_sort,
         lower(first_name) || ' ' || lower(last_name) AS search_name,
         regexp_replace(coalesce(phone, ''), '\D', '', 'g') AS phone_digits,
         lower(coalesce(company, '')) AS company_lower
  FROM contacts_base
),
tags AS (
  SELECT CAST(c.account_id * 10 + CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS id,
         c.account_id,
         substr(o.o_orderpriority, 3) AS name,
         min(o.o_orderdate) + INTERVAL 8218 DAY AS created_at
  FROM orders o JOIN contacts c ON o.o_custkey = c.id
  GROUP BY c.account_id, o.o_orderpriority
),
contact_tags AS (
  SELECT c.id AS contact_id,
         CAST(c.account_id * 10 + CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS tag_id,
         min(o.o_orderdate) + INTERVAL 8218 DAY AS created_at
  FROM orders o JOIN contacts c ON o.o_custkey = c.id
  WHERE c.id % 8 <> 5
  GROUP BY c.id, c.account_id, o.o_orderpriority
),
contact_activity AS (
  SELECT e.event_id AS id, c.account_id, e.user_id AS contact_id,
         CASE WHEN e.event_type = 'signup' THEN 'CONTACT_CREATED'
              WHEN e.event_type = 'click' THEN 'CONTACT_UPDATED'
              WHEN e.event_type = 'error' THEN 'CONTACT_DELETED'
              WHEN e.event_type = 'view' THEN 'TAG_ADDED'
              WHEN e.event_type = 'purchase' AND e.event_id % 2 = 0 THEN 'CONTACT_RESTORED'
              WHEN e.event_type = 'purchase' THEN 'TAG_REMOVED' END AS type,
         e.props AS payload, e.ts AS created_at
  FROM events e JOIN contacts c ON e.user_id = c.id
),
import_jobs AS (
  SELECT s_suppkey AS id,
         CAST(s_nationkey % 2 AS INTEGER) AS account_id,
         CASE WHEN s_suppkey % 3 = 0 THEN 'update' ELSE 'create' END AS mode,
         lower(replace(s_name, '#', '-')) || '.csv' AS filename,
         CASE WHEN s_suppkey % 5 = 0 THEN 'failed' WHEN s_suppkey % 5 = 1 THEN 'ready' ELSE 'completed' END AS status,
         CAST(100 + s_suppkey % 400 AS INTEGER) AS total_rows,
         CAST(100 + s_suppkey % 400 - s_suppkey % 11 AS INTEGER) AS valid_rows,
         CAST(s_suppkey % 11 AS INTEGER) AS error_rows,
         CAST(CASE WHEN s_suppkey % 5 NOT IN (0, 1) THEN 100 + s_suppkey % 400 ELSE 0 END AS INTEGER) AS processed_rows,
         CAST(CASE WHEN s_suppkey % 3 <> 0 THEN 80 ELSE 0 END AS INTEGER) AS created_count,
         CAST(CASE WHEN s_suppkey % 3 = 0 THEN 60 ELSE 0 END AS INTEGER) AS updated_count,
         CAST(s_suppkey % 7 AS INTEGER) AS unchanged_count,
         TIMESTAMP '2024-01-31 12:00:00' - to_days(CAST(s_suppkey % 60 AS INTEGER)) AS created_at,
         CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2024-01-31 12:00:00' - to_days(CAST(s_suppkey % 60 AS INTEGER))
              + to_milliseconds(CAST((100 + s_suppkey % 400) * 20 AS BIGINT)) END AS validated_at,
         CASE WHEN s_suppkey % 5 NOT IN (0, 1) THEN TIMESTAMP '2024-01-31 12:00:00' - to_days(CAST(s_suppkey % 60 AS INTEGER))
              + to_milliseconds(CAST((100 + s_suppkey % 400) * 50 AS BIGINT)) END AS finished_at
  FROM supplier
),
request_log AS (
  SELECT event_id AS request_id, event_type AS scenario,
         CAST(1 << CAST(user_id % 5 AS INTEGER) AS INTEGER) AS clients,
         CAST(CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 97 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status,
         value AS latency_ms, ts AS started_at
  FROM events
)
"""


def with_fixtures(body: str, extra_ctes: str = "") -> str:
    """Prefix a query body with the fixture CTEs (and optional extra CTEs)."""
    ctes = FIXTURE_CTES.strip()
    if extra_ctes:
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"
