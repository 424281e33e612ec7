"""Query and oracle of operator 12 (conversation prefix trie)."""

from __future__ import annotations

from rolodeck.llm.staging import table
from rolodeck.llm.turn_trie import conversation_trie


def op12_turn_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: Prefixes are lists of digests here, and every node hands its figures to each of its prefixes. DuckDB has no crc32, so it is
#: taken from its polynomial: a table of 256 bytes, then a step per digit of the id.
ORACLE_12 = r"""
WITH RECURSIVE bits(b, i, x) AS (SELECT b, 0, b FROM range(256) g(b) UNION ALL SELECT b, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE i < 8),
t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks FROM t GROUP BY conv_id),
crc(conv_id, s, i, x) AS (SELECT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM o UNION ALL
       SELECT conv_id, s, crc.i + 1, xor(crc.x >> 8, bits.x) FROM crc JOIN bits ON bits.i = 8 AND bits.b = xor(crc.x & 255, CAST(ascii(s[crc.i + 1]) AS BIGINT)) WHERE crc.i < length(s)),
h AS (SELECT o.conv_id, ks, xor(x, 4294967295) % 4 AS h FROM o JOIN crc ON crc.conv_id = o.conv_id AND crc.i = length(crc.s)),
p AS (SELECT h.conv_id, list_concat(coalesce(b.ks, [])[1 : h], h.ks[h + 1 :]) AS ks FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
words AS (SELECT DISTINCT k, w FROM t),
m AS (SELECT conv_id, d, ks[1 : d] AS pre, d = len(ks) AS ends FROM (SELECT conv_id, ks, unnest(range(0, len(ks) + 1)) AS d FROM p)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS e FROM m GROUP BY pre, d),
c AS (SELECT pre[1 : d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(w, 0) AS s FROM n LEFT JOIN c USING (pre) LEFT JOIN words ON words.k = pre[d]),
up AS (SELECT pre[1 : a] AS pre, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(s) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1)
SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, par.conv_id AS parent_conv_id, CAST(own.n_convs AS BIGINT) AS n_convs, CAST(own.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(own.e) AS ends_sha256
FROM own JOIN up USING (pre) LEFT JOIN n par ON own.d > 0 AND par.d = own.d - 1 AND par.pre = own.pre[1 : own.d - 1]
"""

QUERIES = {"op12_turn_trie": op12_turn_trie}
ORACLE = {"op12_turn_trie": ORACLE_12}
