"""Operator 2 against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from rolodeck.llm import token_counts as C
from rolodeck.llm.scan_bpe import split_parts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"abst re vld''  \n\t19!?-é中", " ", "'s", "'ll", "  ", "\r\n", "<|endoftext|>", "<|endoftext|", "\U0001f600", " the", "tokenize"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(spark, library, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    want = []
    for r in rows:
        text = r[1] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((r[0], len(text.encode()), n, n > 512))
    got = C.token_counts(df, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_random_texts(spark, library):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randrange(80)))) for i in range(1500)]
    check(spark, library, rows)


def test_defined_cases(spark, library):
    rows = [(1, None, 1), (1, None, 1), (2, "", 2), (None, "some text here", 3), (4, " word" * 600, 4), (5, "<|endoftext|>" * 3 + " a", 5), (5, "<|endoftext|>" * 3 + " a", 5), (6, "x" * 5000, 6)]
    check(spark, library, rows, "doc_id long, text string, n_tokens int")
    assert C.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_blocks_and_buckets(library, monkeypatch):
    # many small blocks, with words that all of them share
    monkeypatch.setattr(C, "BLOCK_CHARS", 200)
    rng = random.Random(9)
    texts = ["the same words " + "".join(rng.choices(PARTS, k=30)) for _ in range(60)]
    schema = to_arrow_schema(StructType.fromDDL("block long, bucket int, data binary, doc_ids array<long>, n_bytes array<long>, specials array<long>"))
    out = list(C._blocks(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})]), PATH, 7, schema))
    assert len(out) > 10
    special, counter = C._tools(PATH)
    total = 0
    for r in (r for b in out for r in b.to_pylist()):
        if r["data"] is None:
            total += sum(r["specials"])
        else:
            words, counts, rows, times = C._unpacked(r["data"])
            assert words == sorted(words) and counts.sum() == len(rows) == len(times) and {C.zlib.crc32(w) % 7 for w in words} == {r["bucket"]}
            of = np.repeat(np.arange(len(words)), counts)
            total += sum(int(t) * len(counter.encode(words[w].decode(), add_special_tokens=False).ids) for w, t in zip(of, times))
    assert total == sum(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert sorted(i for b in out for r in b.to_pylist() if r["data"] is None for i in r["doc_ids"]) == list(range(60))


def test_splits_equal_the_library(library):
    rng = random.Random(10)
    points = [*range(0x3100), *range(0xA000, 0xA800), *rng.sample(range(0x3100, 0x110000), 20_000)]
    text = "".join(p + chr(c) for c in points if not 0xD800 <= c < 0xE000 for p in "a1! ")
    (pieces, n), want = split_parts([text]), library.pre_tokenizer.pre_tokenize_str(text)
    assert n.tolist() == [len(pieces)] and [len(p) for p in pieces] == [b - a for _, (a, b) in want]
