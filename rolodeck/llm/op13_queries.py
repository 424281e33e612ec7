"""Query and oracle of operator 13 (licence scans)."""

from __future__ import annotations

from rolodeck.llm import licence_index as L
from rolodeck.llm.staging import table

COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op13_licence_index(spark, sf_dir):
    return L.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def _values(rows) -> str:
    quoted = ("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)
    return ", ".join(quoted)


WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Words are rows here; templates are tokenised by SQL from their notices.
ORACLE_13 = rf"""
WITH t AS (SELECT t, label, {WORDS.format("notice")} AS ws FROM (VALUES {_values((i, l, n) for i, (l, n, _) in enumerate(L.TEMPLATES))}) v(t, label, notice)),
k AS (SELECT t, string_split(key, ' ') AS ks FROM (VALUES {_values((i, k) for i, (_, _, ks) in enumerate(L.TEMPLATES) for k in ks)}) v(t, key)),
ph AS (SELECT string_split(phrase, ' ') AS ks, label FROM (VALUES {_values(L.PHRASES)}) v(phrase, label)),
tw AS (SELECT t, unnest(ws) AS w, unnest(range(len(ws))) AS q FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
voc AS (SELECT w FROM tw UNION SELECT unnest(ks) FROM k UNION SELECT unnest(ks) FROM ph),
dw AS (SELECT r, w, i FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d) JOIN voc USING (w)),
n AS (SELECT count(*) AS n FROM d),
wt AS (SELECT w, CAST(greatest(1, round(100 * ln((n + 1) / (coalesce(f, 0) + 1)))) AS BIGINT) AS g FROM voc CROSS JOIN n LEFT JOIN (SELECT w, count(DISTINCT r) AS f FROM dw GROUP BY w) USING (w)),
tg AS (SELECT t, w, g, sum(g) AS s FROM tw JOIN wt USING (w) GROUP BY t, w, g),
ix AS (SELECT t, w FROM (SELECT t, w, coalesce(sum(s) OVER (PARTITION BY t ORDER BY g DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(s) OVER (PARTITION BY t) AS whole FROM tg)
       WHERE 100 * before < {L.INDEXED} * whole),
post AS (SELECT t, w, q, g FROM tw JOIN ix USING (t, w) JOIN wt USING (w)),
tot AS (SELECT t, sum(g) AS whole FROM post GROUP BY t),
st AS (SELECT r, t, q, g, i - q AS s FROM dw JOIN post USING (w)),
al AS (SELECT *, sum(gap) OVER (PARTITION BY r, t ORDER BY s, q ROWS UNBOUNDED PRECEDING) AS a
       FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY r, t ORDER BY s, q) <= {L.SLACK} THEN 0 ELSE 1 END AS gap FROM st)),
sp AS (SELECT r, t, a, min(s) AS low, max(s) AS last FROM al GROUP BY r, t, a),
mt AS (SELECT r, t, a, sum(g) AS m FROM (SELECT DISTINCT r, t, a, q, g FROM al) GROUP BY r, t, a),
cand AS (SELECT r, t, a, m / whole AS score, greatest(low, 0) AS low, last + len(t.ws) AS high FROM sp JOIN mt USING (r, t, a) JOIN tot USING (t) JOIN t USING (t) WHERE 100 * m >= {L.ENOUGH} * whole),
good AS (SELECT r, t, score FROM cand c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.t = c.t AND NOT EXISTS (
           SELECT 1 FROM d, range(c.low, c.high - len(k.ks) + 1) AS g(i) WHERE d.r = c.r AND d.ws[g.i + 1 : g.i + len(k.ks)] = k.ks))),
lab AS (SELECT r, label, score FROM good JOIN t USING (t)),
bs AS (SELECT d.r, ph.label, dw.i FROM ph JOIN dw ON dw.w = ph.ks[1] JOIN d ON d.r = dw.r AND d.ws[dw.i + 1 : dw.i + len(ph.ks)] = ph.ks),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bs GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM bs UNION SELECT r, label FROM lab) GROUP BY r),
sc AS (SELECT r, max(score) AS score FROM lab GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN sc USING (r)
"""

QUERIES = {"op13_licence_index": op13_licence_index}
ORACLE = {"op13_licence_index": ORACLE_13}
