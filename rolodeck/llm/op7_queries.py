"""Query of operator 7 (SimHash near-duplicates); fingerprints and components are beyond SQL, see tests/llm."""

from __future__ import annotations

from rolodeck.llm.anchor_simhash import simhash_components
from rolodeck.llm.staging import table


def op7_simhash_anchors(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_simhash_anchors": op7_simhash_anchors}
ORACLE: dict[str, str] = {}
