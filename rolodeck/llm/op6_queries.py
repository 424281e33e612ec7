"""Query of operator 6 (byte-level BPE); merges are beyond SQL, see tests/llm."""

from __future__ import annotations

import public_tokenizers

from rolodeck.llm.scan_bpe import digests
from rolodeck.llm.staging import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op6_scan_bpe(spark, sf_dir, path=None):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, path or public_tokenizers.path(RANKS)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op6_scan_bpe": op6_scan_bpe}
ORACLE: dict[str, str] = {}
