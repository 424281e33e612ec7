"""Query of operator 2 (token counts); the vocabulary's merges are beyond SQL, see tests/llm."""

from __future__ import annotations

import public_tokenizers

from rolodeck.llm.staging import table
from rolodeck.llm.token_counts import token_counts

VOCABULARY = "byte_bpe_50k.json"


def op2_token_counts(spark, sf_dir, path=None):
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), path or public_tokenizers.path(VOCABULARY))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
