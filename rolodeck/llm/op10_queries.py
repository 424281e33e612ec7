"""Query and oracle of operator 10 (revisit resolution)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolodeck.llm.revisits import captures, resolve_revisits
from rolodeck.llm.staging import table


def op10_revisit_resolution(spark, sf_dir):
    """Every record of the crawl that ``captures`` derives from the pages, resolved; headers as sorted 'name: value' lines."""
    found = resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select("record_id", "url_key", "outcome", "refers_to", lines.alias("header_lines"), F.md5("payload").alias("payload_md5"), F.octet_length("payload").cast("long").alias("n_bytes"))


ORACLE_10 = r"""
WITH p AS (SELECT page_id AS p, 86400 + page_id * 100 AS s, url, coalesce(html, '') AS h FROM pages),
asked AS (SELECT *, regexp_replace(regexp_replace(url, '^https?://', 'HTTPS://'), '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=again' AS again FROM p),
resp AS (SELECT 'first-' || p AS id, p, url, s AS t, h AS body, 'first' AS name FROM p
         UNION ALL SELECT 'second-' || p, p, url, s + 40, h || '<!-- changed -->', 'second' FROM p WHERE p % 4 = 0),
rev AS (SELECT 'early-' || p AS id, p, again AS url, s + 20 AS t, h AS body, 'first' AS mod, 'early' AS name FROM asked WHERE p % 3 <> 0
        UNION ALL SELECT 'late-' || p, p, again, s + 60, CASE WHEN p % 4 = 0 THEN h || '<!-- changed -->' ELSE h END, CASE WHEN p % 4 = 0 THEN 'second' ELSE 'first' END, 'late' FROM asked
        UNION ALL SELECT 'before-' || p, p, again, s - 30, h, 'first', 'before' FROM asked WHERE p % 11 = 0),
resp_k AS (SELECT *, CASE WHEN p % 7 = 0 THEN NULL ELSE '"' || md5(body) || '"' END AS tag, 'mod ' || p || name AS lm FROM resp),
rev_k AS (SELECT *, CASE WHEN p % 5 = 0 THEN '"foreign"' WHEN p % 7 = 0 THEN NULL ELSE 'W/"' || md5(body) || '"' END AS tag, 'mod ' || p || mod AS lm FROM rev),
urls AS (SELECT DISTINCT url FROM resp UNION SELECT DISTINCT url FROM rev),
parts AS (SELECT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) AS rest FROM urls),
keys AS (SELECT url, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
                list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid)(=|$)'))) AS q FROM parts),
k AS (SELECT url, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM keys),
a AS (SELECT r.*, k.url_key FROM resp_k r JOIN k USING (url)),
v AS (SELECT r.*, k.url_key FROM rev_k r JOIN k USING (url)),
hit AS (SELECT v.id, max_by(a.id, (a.t, a.id)) AS ref FROM v JOIN a ON a.url_key = v.url_key AND a.t < v.t GROUP BY v.id),
j AS (SELECT v.*, hit.ref, a.tag AS atag, a.lm AS alm, a.body AS abody, a.t AS at,
             CASE WHEN hit.ref IS NULL THEN 'no_earlier_response'
                  WHEN coalesce(regexp_replace(v.tag, '^W/', '') = a.tag, v.lm = a.lm) THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
      FROM v LEFT JOIN hit USING (id) LEFT JOIN a ON a.id = hit.ref),
lines AS (SELECT id, url_key, outcome, CASE WHEN outcome = 'resolved' THEN ref END AS refers_to, CASE WHEN outcome = 'resolved' THEN abody END AS body,
                 list_filter(['cache-control: max-age=60', 'content-length: ' || CASE WHEN outcome = 'resolved' THEN strlen(abody) ELSE 0 END,
                              CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' END, 'date: day ' || t // 86400,
                              'etag: ' || coalesce(tag, CASE WHEN outcome = 'resolved' THEN atag END), 'last-modified: ' || lm,
                              CASE WHEN outcome <> 'resolved' THEN 'x-seen: ' || name END], lambda x: x IS NOT NULL) AS hs FROM j
          UNION ALL
          SELECT id, url_key, 'full', NULL, body, list_filter(['content-length: ' || strlen(body), 'content-type: text/html', 'date: day ' || t // 86400, 'etag: ' || tag, 'last-modified: ' || lm], lambda x: x IS NOT NULL) FROM a)
SELECT id AS record_id, url_key, outcome, refers_to, array_to_string(list_sort(hs), chr(10)) AS header_lines, md5(body) AS payload_md5, CAST(strlen(body) AS BIGINT) AS n_bytes FROM lines
"""

QUERIES = {"op10_revisit_resolution": op10_revisit_resolution}
ORACLE = {"op10_revisit_resolution": ORACLE_10}
