"""Registered load-result rollups (L1–L6) and their DuckDB oracles."""

from __future__ import annotations

from rolodeck.operators import loadstats as LS
from rolodeck.plans.oracle_fixtures import with_fixtures
from rolodeck.sources.fixtures import load_model, request_log

# Parameter: the scenario that expects 404 answers (a lookup of ids that may be gone)
EXPECTED_4XX = {"view": [404]}


def q_step_digest(spark, sf):
    return LS.step_digest(request_log(spark, sf))


def q_step_verdict(spark, sf):
    log = request_log(spark, sf)
    return LS.step_verdict(LS.step_digest(log), log, EXPECTED_4XX)


def q_ramp_summary(spark, sf):
    log = request_log(spark, sf)
    return LS.ramp_summary(LS.step_verdict(LS.step_digest(log), log, EXPECTED_4XX))


def q_nearest_rank(spark, sf):
    return LS.nearest_rank(request_log(spark, sf), ["scenario"], "latency_ms", {"p90": 0.9, "p99": 0.99})


def q_tenant_isolation_audit(spark, sf):
    m = load_model(spark, sf)
    return LS.tenant_isolation_audit(m.contacts, m.tags, m.contact_tags, m.activity)


def q_import_throughput(spark, sf):
    return LS.import_throughput(load_model(spark, sf).import_jobs)


QUERIES = {
    "step_digest": q_step_digest,
    "step_verdict": q_step_verdict,
    "ramp_summary": q_ramp_summary,
    "nearest_rank": q_nearest_rank,
    "tenant_isolation_audit": q_tenant_isolation_audit,
    "import_throughput": q_import_throughput,
}


def _nr(p: float) -> str:
    return f"max(latency_ms) FILTER (WHERE pos = least(n - 1, CAST(floor(n * {p}) AS BIGINT)) + 1)"


_DIGEST = f"""
SELECT scenario, clients,
       CAST(floor(count(*) / greatest((epoch_us(max(started_at)) - epoch_us(min(started_at))) / 1e6, 1.0) + 0.5) AS BIGINT) AS rps,
       {_nr(0.5)} AS p50, {_nr(0.975)} AS p97_5, {_nr(0.99)} AS p99, max(latency_ms) AS max, count(*) AS total,
       count(*) FILTER (WHERE status >= 200 AND status < 300) AS ok,
       count(*) FILTER (WHERE status >= 400 AND status < 500) AS s4xx,
       count(*) FILTER (WHERE status >= 500) AS s5xx
FROM (SELECT *, row_number() OVER (PARTITION BY scenario, clients ORDER BY latency_ms) AS pos,
             count(*) OVER (PARTITION BY scenario, clients) AS n FROM request_log) r
GROUP BY scenario, clients
"""

_VERDICT = f"""
SELECT d.*,
       CASE WHEN (d.s5xx + u.u4) / greatest(d.total, 1) > 0.005
              THEN CAST(floor((d.s5xx + u.u4) / greatest(d.total, 1) * 1000 + 0.5) / 10 AS VARCHAR) || '% of requests failed ('
                   || CAST(d.s5xx AS VARCHAR) || ' server errors, 0 timeouts or connection errors, ' || CAST(u.u4 AS VARCHAR) || ' unexpected 4xx)'
            WHEN d.p99 > 2000 THEN 'p99 latency ' || CAST(d.p99 AS VARCHAR) || ' ms exceeds 2000 ms' END AS break
FROM ({_DIGEST}) d
JOIN (SELECT scenario, clients,
             count(*) FILTER (WHERE status >= 400 AND status < 500 AND NOT (scenario = 'view' AND status IN (404))) AS u4
      FROM request_log GROUP BY scenario, clients) u
  ON u.scenario = d.scenario AND u.clients = d.clients
"""

ORACLE = {
    "step_digest": with_fixtures(_DIGEST),
    "step_verdict": with_fixtures(_VERDICT),
    "ramp_summary": with_fixtures(f"""
        SELECT scenario, max(max_rps) AS max_rps,
               min(clients) FILTER (WHERE rps >= max_rps * 0.95) AS knee,
               max(clients) FILTER (WHERE break IS NULL AND p99 <= 500) AS comfortable,
               arg_max(rps, clients) FILTER (WHERE break IS NULL AND p99 <= 500) AS comfortable_rps,
               min(fb) AS break_at
        FROM (SELECT *, max(rps) OVER (PARTITION BY scenario) AS max_rps FROM (
                SELECT *, min(CASE WHEN break IS NOT NULL THEN clients END) OVER (PARTITION BY scenario) AS fb FROM v) x
              WHERE fb IS NULL OR clients <= fb) y
        GROUP BY scenario""", extra_ctes=f"v AS ({_VERDICT})"),
    "nearest_rank": with_fixtures(f"""
        SELECT scenario, {_nr(0.9)} AS p90, {_nr(0.99)} AS p99
        FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY latency_ms) AS pos,
                     count(*) OVER (PARTITION BY scenario) AS n FROM request_log) r GROUP BY scenario"""),
    "tenant_isolation_audit": with_fixtures("""
        SELECT 'link_crosses_accounts' AS "check", count(*) FILTER (WHERE c.account_id <> t.account_id) AS violations
        FROM contact_tags ct JOIN contacts c ON c.id = ct.contact_id JOIN tags t ON t.id = ct.tag_id
        UNION ALL
        SELECT 'activity_crosses_accounts', count(*) FILTER (WHERE a.account_id <> c.account_id)
        FROM contact_activity a JOIN contacts c ON c.id = a.contact_id
        UNION ALL
        SELECT 'email_in_several_accounts', count(*) FILTER (WHERE na > 1)
        FROM (SELECT email, count(DISTINCT account_id) AS na FROM contacts WHERE email IS NOT NULL GROUP BY email) e"""),
    "import_throughput": with_fixtures("""
        SELECT mode, count(*) AS jobs, sum(total_rows)::BIGINT AS rows,
               CAST(floor(sum(total_rows) / (sum(epoch_us(validated_at) - epoch_us(created_at)) / 1e6) + 0.5) AS BIGINT) AS validate_rps,
               CAST(floor(sum(total_rows) / (sum(epoch_us(finished_at) - epoch_us(validated_at)) / 1e6) + 0.5) AS BIGINT) AS import_rps
        FROM import_jobs WHERE status = 'completed' GROUP BY mode"""),
}
