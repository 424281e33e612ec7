"""Query of operator 9 (HTML extraction); parsing is beyond SQL, see tests/llm."""

from __future__ import annotations

from rolodeck.llm.staging import table
from rolodeck.llm.style_tree import extract


def op9_style_tree(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op9_style_tree": op9_style_tree}
ORACLE: dict[str, str] = {}
