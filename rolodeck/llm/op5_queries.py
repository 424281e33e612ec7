"""Query of operator 5 (mixing); the schedule is a simulation beyond plain SQL, see tests/llm."""

from __future__ import annotations

from rolodeck.llm.pfair_mix import mixed
from rolodeck.llm.staging import table


def op5_pfair_mix(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


QUERIES = {"op5_pfair_mix": op5_pfair_mix}
ORACLE: dict[str, str] = {}
