"""Operator 2, token counts without ids.

A tokenizer merges each pre-token by itself, so a text has as many tokens as
its pre-tokens have pieces. Documents are taken in blocks of bounded length. A
block deals its distinct pre-tokens over buckets by their hash; a row carries
one bucket's pre-tokens of a block, sorted and packed, with the frequencies of
each in the block's documents. Where a bucket's rows meet, each distinct
pre-token is counted once and joined to the frequencies of all blocks; the
products are summed per document and meet again by block.

A frequent pre-token is one entry per block, however many documents have it,
so no bucket is hot; ids are never made. Packing keeps the one large shuffle
at a few bytes per distinct pre-token and document.

Defined cases: a null text counts as empty (no tokens); a text of any length
is split whole, in exact parts; strings of the vocabulary's special tokens are
one token each, wherever they stand; repeated rows get a row each; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rolodeck.llm.scan_bpe import AT_ONCE, parts_of, split_parts

LIMIT = 512
#: Characters of a block; pre-tokens counted at once, and remembered by a bucket.
BLOCK_CHARS, COUNTED, REMEMBERED = 1 << 23, 1 << 14, 1 << 20


@lru_cache(4)
def _tools(path: str):
    """The pattern of special tokens (None without), and a tokenizer that takes each string as one pre-token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    split, added = config["pre_tokenizer"], config["added_tokens"]
    if config["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("only byte-level vocabularies with the usual splitting, without normalizer, and with plain special tokens")
    special = sorted((t["content"] for t in added), key=len, reverse=True)
    whole = config | {"pre_tokenizer": split | {"use_regex": False}, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None}
    return re.compile("|".join(map(re.escape, special))) if special else None, Tokenizer.from_str(json.dumps(whole))


def _packed(words: list[bytes], counts: np.ndarray, rows: np.ndarray, times: np.ndarray) -> bytes:
    text = b"".join(words)
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    head = np.array([len(words), len(text), len(rows)], np.int64)
    return zlib.compress(b"".join((head.tobytes(), lengths.tobytes(), text, counts.astype(np.int32).tobytes(), rows.astype(np.int32).tobytes(), times.astype(np.int32).tobytes())), 1)


def _unpacked(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    n, size, pairs = np.frombuffer(data, np.int64, 3).tolist()
    ends = np.cumsum(np.frombuffer(data, np.int32, n, 24)).tolist()
    at = 24 + 4 * n
    words = [data[at + a : at + b] for a, b in zip([0, *ends[:-1]], ends)] if n else []
    counts = np.frombuffer(data, np.int32, n, at + size)
    rows = np.frombuffer(data, np.int32, pairs, at + size + 4 * n)
    return words, counts, rows, np.frombuffer(data, np.int32, pairs, at + size + 4 * n + 4 * pairs)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per block: a row for each bucket with its packed words, and one with the documents' ids, bytes and special tokens."""
    special = _tools(path)[0]
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids: list = []
    heads: list[tuple[int, int]] = []  # bytes, special tokens
    words: dict[str, int] = {}
    seen: list[tuple[np.ndarray, np.ndarray]] = []  # words and documents
    parts: list[str] = []
    owners: list[int] = []
    block = held = waiting = 0

    def scan() -> None:
        if parts:
            pieces, n = split_parts(parts)
            seen.append((np.array([words.setdefault(p, len(words)) for p in pieces], np.int64), np.repeat(np.array(owners, np.int64), n)))
            parts.clear()
            owners.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        scan()
        texts = [w.encode() for w in words]
        bucket = np.fromiter((zlib.crc32(t) % buckets for t in texts), np.int64, len(texts))
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n = len(heads)
        key, times = np.unique(np.concatenate([rank[w] * n + d for w, d in seen] or [np.empty(0, np.int64)]), return_counts=True)
        word, row = np.divmod(key, max(n, 1))
        counts = np.bincount(word, minlength=len(order))
        of = np.concatenate(([0], np.cumsum(counts)))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        data = [_packed([texts[i] for i in order[a:b]], counts[a:b], row[of[a] : of[b]], times[of[a] : of[b]]) for a, b in zip(cuts[full], cuts[full + 1])]
        rows = {"block": [first + block] * (len(full) + 1), "bucket": [*full.tolist(), block % buckets], "data": [*data, None]}
        for name, column in zip(("doc_ids", "n_bytes", "specials"), (list(ids), [b for b, _ in heads], [s for _, s in heads])):
            rows[name] = [*[None] * len(full), column]
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            plain = special.split(text) if special else [text]
            for part in (x for p in plain for x in parts_of(p)):
                if waiting + len(part) > AT_ONCE:
                    scan()
                    waiting = 0
                parts.append(part)
                owners.append(len(heads))
                waiting += len(part) + 1
            ids.append(doc_id)
            heads.append((len(text.encode()), len(plain) - 1))
            held += len(text) + 1
            if held >= BLOCK_CHARS:
                yield from flush()
                block, held, waiting = block + 1, 0, 0
                for x in (ids, heads, words, seen):
                    x.clear()
    if heads:
        yield from flush()


def _joined(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per row of a bucket, its documents' tokens from its words; each distinct word of the bucket is counted once."""
    counter = _tools(path)[1]
    pieces: dict[bytes, int] = {}
    for batch in batches:
        rows, sums = [], []
        for data in batch.column("data").to_pylist():
            if data is None:
                rows.append(None)
                sums.append(None)
                continue
            words, counts, row, times = _unpacked(data)
            if len(pieces) + len(words) > REMEMBERED:
                pieces.clear()  # bounds the memory; what comes again is counted again
            new = [w for w in words if w not in pieces]
            for at in range(0, len(new), COUNTED):
                some = new[at : at + COUNTED]
                pieces.update(zip(some, (len(e.ids) for e in counter.encode_batch_fast([w.decode() for w in some], add_special_tokens=False))))
            each = np.fromiter(map(pieces.__getitem__, words), np.int64, len(words))
            tokens = np.bincount(row, weights=np.repeat(each, counts) * times).astype(np.int64)
            present = np.flatnonzero(tokens)
            rows.append(present)
            sums.append(tokens[present])
        columns = {"block": batch.column("block"), "rows": rows, "sums": sums, **{c: batch.column(c) for c in ("doc_ids", "n_bytes", "specials")}}
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if isinstance(columns[f.name], list) else columns[f.name] for f in schema], schema=schema)


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """A block's documents with the tokens of all buckets."""
    head = group[group["doc_ids"].notna()].iloc[0]
    total = np.array(head["specials"], np.int64)
    for rows, sums in zip(group["rows"], group["sums"]):
        if rows is not None:
            total[rows] += sums
    return pd.DataFrame({"doc_id": pd.Series(list(head["doc_ids"]), dtype=object), "n_bytes": head["n_bytes"], "n_tokens": total})


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, longs = docs.schema["doc_id"].dataType, T.ArrayType(T.LongType())
    heads = [T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_bytes", longs), T.StructField("specials", longs)]
    packed = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("data", T.BinaryType()), *heads])
    counted = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(T.IntegerType())), T.StructField("sums", longs), *heads])
    arrow = {s: to_arrow_schema(s) for s in (packed, counted)}
    from_blocks, from_buckets = arrow[packed], arrow[counted]
    rows = docs.mapInArrow(lambda it: _blocks(it, path, buckets, from_blocks), packed).repartition(buckets, "bucket")
    sums = rows.mapInArrow(lambda it: _joined(it, path, from_buckets), counted)
    out = sums.groupBy("block").applyInPandas(_summed, T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
