"""Alignment by diagonal runs against a token-by-token walk and dictionaries of counts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rolodeck.llm.diagonal_align import _byte_level, _byte_of, aligned, alignments

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONGS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 400), max_size=200), st.sets(st.integers(1, 400), max_size=200), st.integers(2, 40))
def test_common_ends_of_any_arrays(x, y, lane):
    a, b = np.array(sorted(x | {401})), np.array(sorted(y | {401}))
    both = set(a.tolist()) & set(b.tolist())
    ca, cb = aligned(a, b, lane)
    assert set(a[ca].tolist()) == both and set(b[cb].tolist()) == both


def test_long_runs_and_one_empty():
    a = np.arange(1, 100_001) * 3
    b = np.concatenate((a[:50_000], [150_001], a[50_000:]))
    ca, cb = aligned(a, b)
    assert ca.all() and cb.sum() == len(a) and not cb[50_000]
    assert [len(m) for m in aligned(a[:0], a[:0])] == [0, 0]


def _plain(docs):
    """The contract, one document and one pair at a time."""
    tok, sp = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tok.encode_special_tokens = True
    byte = _byte_of()
    found = []
    for doc_id, text in docs:
        want = b" " + (text or "").encode()
        ids_a, ids_b = tok.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        parts_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(parts_a) != want or b"".join(parts_b) != want:
            found.append((doc_id, [], [], [], []))
            continue
        spans = []
        for parts in (parts_a, parts_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        groups, links, i, j = [], [], 0, 0
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            x, y = [], []
            while i < len(ids_a) and spans[0][i][1] <= cut:
                x.append(i)
                i += 1
            while j < len(ids_b) and spans[1][j][1] <= cut:
                y.append(j)
                j += 1
            groups.append((x, y))
            links += [(ids_a[p], ids_b[q]) for p in x for q in y if max(spans[0][p][0], spans[1][q][0]) < min(spans[0][p][1], spans[1][q][1])]
        found.append((doc_id, ids_a, ids_b, [([ids_a[p] for p in x], [ids_b[q] for q in y]) for x, y in groups], links))
    docs_of = Counter(pair for *_, links in found for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in docs_of.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, ids_a, ids_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sums = sum(docs_of[p] == best[p[0]] for p in links), sum(docs_of[p] for p in links)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), *sums, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", *LONGS, "groups_sha256").collect()), key=str)


ODD = ["", None, " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> <s> </s> <unk> <0x0A>", "naïve ▁ café \U0001f600\U0001f468‍\U0001f469", "ﬁ ① ½ é", "\x00\x01", "x" * 3000, "中文字 " * 50, "The cat sat. The cat sat."]


def test_odd_texts_repeats_nulls_and_clashing_names(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "The cat sat."), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block long, pairs string").repartition(3)
    got = _rows(alignments(df, *PATHS))
    assert got == _plain(docs)
    zero = [r for r in got if r[0] in (0, 1)]
    assert all(r[1:] == (0,) * 6 + ("",) for r in zero) and len(zero) == 2
    empty = alignments(df.where("false"), *PATHS)
    assert empty.columns == ["doc_id", *LONGS, "groups_sha256"] and empty.count() == 0


def test_ranks_give_the_ids_of_the_file_for_every_code_point():
    encode = _byte_level(PATHS[0])[0]
    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 17):
        texts = [f"x{chr(c)}y1 {chr(c)} z{chr(c)}" for c in points[at : at + (1 << 17)]]
        assert encode(texts) == [e.ids for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("block, once", [(1 << 22, 1 << 19), (20_000, 7_000)])
def test_documents_in_blocks_of_any_size(spark, monkeypatch, block, once):
    import rolodeck.llm.diagonal_align as D

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in df.collect()]
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    monkeypatch.setattr(D, "AT_ONCE", once)
    schema = D._block_type(df.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})
    made = list(D._blocks(iter([batch]), *PATHS, arrow))
    assert (len(made) > 3) == (block < 1 << 22)
    want = {(r[0]): r for r in _plain(docs)}
    for b in made:
        for r in b.to_pylist():
            for k, d in enumerate(r["doc_ids"]):
                assert (r["n_a"][k], r["n_b"][k], r["n_groups"][k], r["n_links"][k], r["digests"][k]) == (*want[d][1:5], want[d][7])


def test_query_against_the_plain_walk(spark):
    from rolodeck.llm.op11_queries import op11_diagonal_align

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert _rows(op11_diagonal_align(spark, "/root/testdata/sf0.001")) == _plain(docs)
