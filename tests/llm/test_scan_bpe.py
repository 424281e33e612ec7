"""Operator 6 against the tokenizer library, code point by code point and over random texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from rolodeck.llm import scan_bpe as S

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = [*"abst remvld''  \n\t19!?-é中\x1c\x85", " ", "　", "'s", "'re", "'ll", "'t ", " '", "''", "  ", "\r\n", "<|endoftext|>", "\U0001f600", "é", "Ᲊ", "\U00010d40"]


def test_random_texts(library):
    rng = random.Random(1)
    texts = ["", None, "'", "''s", "'s's", "'rex", "!'s", "a  b", "a \n b", "\n\n", "x" * 3000, "'" * 50] + ["".join(rng.choices(PARTS, k=rng.randrange(60))) for _ in range(8000)]
    ids, offsets = S.encode_batch(texts, PATH)
    assert ids.to_pylist() == [library.encode_ordinary(t or "") for t in texts]
    assert S.decode_batch(ids, offsets, PATH).to_pylist() == [(t or "").encode() for t in texts]


def test_classes_equal_the_library():
    # ranks that join a probe byte with any next one: two characters are one token only within a piece
    ranks = {bytes([i]): i for i in range(256)}
    for p in b"a1!":
        for x in range(256):
            ranks.setdefault(bytes([p, x]), len(ranks))
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    points = [c for c in [*range(0x3100), *range(0xA000, 0xA800), *rng.sample(range(0x3100, 0x110000), 20_000), *[x for r in (*S.LETTERS_16, *S.NUMBERS_16) for x in r]] if not 0xD800 <= c < 0xE000]
    kinds = S.classes()
    for c in points:
        joined = [probe.encode_ordinary(p + chr(c))[0] >= 256 for p in "a1!"]
        want = S.LETTER if joined[0] else S.NUMBER if joined[1] else S.OTHER if joined[2] else S.SPACE if c == 0x20 else S.BLANK
        assert kinds[c] == want, hex(c)


def test_states_equal_a_walk():
    rng = np.random.default_rng(4)
    table = S.transitions()
    for n in (1, 5, 64, 65, 5000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        state, walk = S.FREE, []
        for s in symbols:
            walk.append(state)
            state = table[int(s) * S.STATES + int(state)]
        assert S.states_before(symbols).tolist() == walk


def test_long_texts_in_parts(library, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices(PARTS, k=3000)) + " and on it goes 'til the end " * 400
    monkeypatch.setattr(S, "AT_ONCE", 500)
    assert len(S.parts_of(text, 500)) > 10
    ids, offsets = S.encode_batch([text, "b", text], PATH)
    assert ids.to_pylist() == [library.encode_ordinary(t) for t in (text, "b", text)]
    assert S.decode_batch(ids, offsets, PATH).to_pylist() == [t.encode() for t in (text, "b", text)]


def test_merges_of_long_pieces(library):
    rng = random.Random(5)
    ranks = S.load_ranks(PATH)[0]
    for n in (1, 2, 17, 300, 4000):
        piece = "".join(rng.choices("abcdeinst", k=n))
        assert list(S.merged(piece.encode(), ranks)) == library.encode_ordinary(piece)


def test_columns(spark, library):
    df = spark.createDataFrame([(1, "Hello, it's 7 o'clock\n", "x"), (None, None, None), (2, "", "y"), (2, "", "y")], "doc_id long, text string, n_tokens string")
    out = S.encode(df, PATH)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "offsets"]
    got = S.digests(df, PATH).collect()
    for r, t in zip(got, [df_row["text"] or "" for df_row in df.collect()]):
        ids = library.encode_ordinary(t)
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert S.digests(spark.createDataFrame([], df.schema), PATH).collect() == []


def test_slices_hold_every_row_once():
    sizes = [0, 5, 3, 40, 0, 1, 1, 1, 9, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([None if k == 4 else "x" * n for k, n in enumerate(sizes)])], ["k", "t"])
    got = list(S.slices(batch, "t", 8))
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(10))
    assert len(got) > 2 and all(sum(len(t or "") for t in b.column(1).to_pylist()[:-1]) < 8 for b in got)
    assert [b.num_rows for b in S.slices(batch.slice(0, 0), "t")] == [0]


def test_decoding_keeps_nulls_and_slices():
    ids, offsets = S.encode_batch(["a b", None, "long words here", ""], PATH)
    with_null = [pa.array([None if k == 2 else x for k, x in enumerate(c.to_pylist())], c.type) for c in (ids, offsets)]
    assert S.decode_batch(*with_null, PATH).to_pylist() == [b"a b", b"", None, b""]
    assert S.decode_batch(ids.slice(1, 2), offsets.slice(1, 2), PATH).to_pylist() == [b"", b"long words here"]
