"""Query and oracle of operator 3 (quality rules)."""

from __future__ import annotations

from rolodeck.llm.host_quality import quality
from rolodeck.llm.staging import table

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_host_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(*COLUMNS)


#: Windows are unnested and grouped here, not hashed; rows stand for themselves (doc_id need not be unique).
DOCS_CTE = r"""
d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS s
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM win WHERE (r, s) IN (SELECT (r, s) FROM win GROUP BY r, s HAVING count(*) > 1)),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(5) AS g(k) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(DISTINCT l) AS u
       FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(ln.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(ln.n - ln.u, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
             100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines FROM m),
h AS (SELECT source, rule, count(*) AS n, sum(failed) AS failed FROM (
        SELECT source, 'short' AS rule, CAST(short AS INT) AS failed FROM f UNION ALL
        SELECT source, 'repeats', CAST(repeats AS INT) FROM f UNION ALL
        SELECT source, 'symbols', CAST(symbols AS INT) FROM f UNION ALL
        SELECT source, 'lines', CAST(lines AS INT) FROM f) WHERE source IS NOT NULL GROUP BY source, rule),
p AS (SELECT rule, sum(failed) / sum(n) AS q, greatest(sum(failed * failed / n) / sum(n) - (sum(failed) / sum(n)) ** 2
             - (sum(failed) / sum(n)) * (1 - sum(failed) / sum(n)) * count(*) / sum(n), 1e-6) AS v FROM h GROUP BY rule),
bad AS (SELECT DISTINCT source FROM h JOIN p USING (rule)
        WHERE (failed + q * greatest(q * (1 - q) / v - 1, 1)) / (n + greatest(q * (1 - q) / v - 1, 1)) > 0.5),
verdict AS (SELECT f.*, short OR repeats AS base_failed,
                   NOT (short OR repeats) AND (f.source IS NULL OR f.source NOT IN (SELECT source FROM bad)) AS kept FROM f)
"""

QUERIES = {"op3_host_quality": op3_host_quality}
ORACLE = {"op3_host_quality": f"WITH {DOCS_CTE} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"}
