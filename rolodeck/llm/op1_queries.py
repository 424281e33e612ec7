"""Query and oracle of operator 1 (URL filters)."""

from __future__ import annotations

from rolodeck.llm.staging import table
from rolodeck.llm.url_redirects import judged, page_edges


def op1_url_redirects(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judged(pages.select("page_id", "url"), page_edges(pages.select("url", "html")))


#: Own rules by a join with the list, aliases by a recursive walk over the edges in the pages' markup.
ORACLE_1 = r"""
WITH RECURSIVE rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS t
         FROM pages WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|refresh')),
links AS (SELECT url AS a, trim(replace(CASE WHEN regexp_matches(t, '(?i)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                 ELSE regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''>]*)', 1) END, '&amp;', '&')) AS l FROM tags
          WHERE regexp_matches(t, '(?i)^<link\b.*\brel\s*=\s*["'']?canonical\b') OR regexp_matches(t, '(?i)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b')),
full_links AS (SELECT a, CASE WHEN contains(l, '://') THEN l WHEN l LIKE '//%' THEN regexp_extract(a, '^(.*?:)//', 1) || l
                              WHEN l LIKE '/%' THEN regexp_extract(a, '^(.*?://[^/?#]*)', 1) || l END AS b FROM links WHERE l <> ''),
keyed AS (SELECT lower(regexp_extract(a, '^(.*?://[^/?#]*)', 1)) || regexp_extract(a, '://[^/?#]*([^#]*)', 1) AS a,
                 lower(regexp_extract(b, '^(.*?://[^/?#]*)', 1)) || regexp_extract(b, '://[^/?#]*([^#]*)', 1) AS b FROM full_links WHERE b IS NOT NULL),
edges AS (SELECT a, b FROM keyed WHERE a <> b UNION SELECT b, a FROM keyed WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
urls AS (SELECT DISTINCT b AS k FROM reach),
fit AS (SELECT k, rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC) AS n FROM urls, rules
        WHERE ('.' || regexp_extract(k, '://([^/?#]*)', 1)) LIKE ('%.' || split_part(rule, '/', 1))
          AND starts_with(regexp_extract(k, '://[^/?#]*([^?#]*)', 1), substr(rule, instr(rule, '/')))),
said AS (SELECT reach.a AS k, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS passed FROM reach JOIN fit ON fit.k = reach.b AND n = 1 GROUP BY 1),
p AS (SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
             lower(regexp_extract(url, '^(.*?://[^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS k FROM pages),
own AS (SELECT r, rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC) AS n FROM p, rules
        WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, instr(rule, '/'))))
SELECT page_id, host, path, own.rule AS rule, coalesce(own.verdict, said.passed, 'allow') AS verdict
FROM p LEFT JOIN own ON own.r = p.r AND own.n = 1 LEFT JOIN said ON said.k = p.k
"""

QUERIES = {"op1_url_redirects": op1_url_redirects}
ORACLE = {"op1_url_redirects": ORACLE_1}
