"""Query of operator 11 (cross-tokenizer alignment); the tokenizers are beyond SQL, see tests/llm."""

from __future__ import annotations

import public_tokenizers

from rolodeck.llm.diagonal_align import alignments
from rolodeck.llm.staging import table


def op11_diagonal_align(spark, sf_dir):
    path = public_tokenizers.path
    return alignments(table(spark, sf_dir, "documents").select("doc_id", "text"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


QUERIES = {"op11_diagonal_align": op11_diagonal_align}
ORACLE: dict[str, str] = {}
