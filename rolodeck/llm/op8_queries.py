"""Query and oracle of operator 8 (embedding near-duplicates)."""

from __future__ import annotations

from rolodeck.llm.hnsw_links import embedding_links
from rolodeck.llm.staging import table


def op8_hnsw_links(spark, sf_dir):
    return embedding_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: All pairs of a label, and the least id that they reach.
ORACLE_8 = r"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(r.c, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(r.c, e.vec_id)) AS kept
FROM e LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id
"""

QUERIES = {"op8_hnsw_links": op8_hnsw_links}
ORACLE = {"op8_hnsw_links": ORACLE_8}
