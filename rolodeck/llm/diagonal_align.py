"""Operator 11, cross-tokenizer alignment by diagonal run skipping.

A text is encoded by two tokenizers; the byte offsets at which their tokens
end are two rising arrays. Where both have an end, the text is cut into
groups. Along a stretch of one-to-one groups the index of the one array is
that of the other plus a constant shift (a diagonal), so the stretch is jumped
by exponential probing: a window of 1, 2, 4, ... ends is compared at the
current shift until one differs. The irregular group there is resolved locally
(the array with the lesser end moves on until both ends are equal), which
gives the next shift. Long arrays are worked off as many lanes at once, each
between two common ends, so a step is one array operation for all lanes.

A link is a token of each tokenizer whose byte ranges overlap. How many
documents hold a pair of ids linked is counted corpus-wide: documents are
taken in blocks of bounded length; a block has each of its distinct pairs once
with its number of documents, so the shuffle sees a row per block and pair,
however often the pair occurs. Counts go back to the blocks by a join on the
pair, and a block sums them over its documents' links.

Defined cases: a null or empty text, or one that either tokenizer does not
give back byte by byte, has no tokens: zeros and ''. A text of any length is
aligned whole. Repeated rows get a row each and count as documents of their
own; a null doc_id is kept. Other columns are not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rolodeck.llm.staging import Staged

#: Characters of a block and of what is encoded at once; ends of a lane.
BLOCK_CHARS, AT_ONCE, LANE = 1 << 22, 1 << 19, 128


class Vocabulary:
    """The bytes of each id, and its decimal digits with each separator."""

    def __init__(self, pieces: list[bytes]):
        self.bytes = pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.width = len(str(max(len(pieces) - 1, 0))) + 1

    def spelled(self, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(a row of characters per id and separator, their number)."""
        texts = [b"%d%c" % (i, s) for i in range(len(self.bytes)) for s in separators]
        rows = np.frombuffer(b"".join(t.ljust(self.width) for t in texts), np.uint8).reshape(len(texts), self.width)
        return rows, np.array([len(t) for t in texts], np.int64)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where printable, else 256, 257, ... in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Fixed value: how byte-level vocabularies split a text before they merge.
SPLITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _by_ranks(config: dict, pieces: list[bytes]):
    """An encoder by ranks that gives a file's ids, or None: merges must be in the order of their ids, with nothing but the usual splitting before."""
    model, split = config["model"], config["pre_tokenizer"]
    usual = split and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not config["normalizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    merged = (model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"])
    if not (usual and plain and all(i == at for at, i in enumerate(merged, 256)) and len(model["vocab"]) == 256 + len(model["merges"])):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=SPLITS, mergeable_ranks={pieces[i]: i for i in model["vocab"].values()}, special_tokens={}).encode_ordinary


@lru_cache(2)
def _byte_level(path: str):
    """(encode list of texts, Vocabulary) of a byte-level .json; encodes a space and the text.

    By ranks where the file allows (twice as fast; the tests hold each code point against the file's own library).
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    tok.no_truncation()
    tok.no_padding()
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    added = {t["id"]: t["content"].encode() for t in config["added_tokens"]}
    byte = _byte_of()
    size = max([*tok.get_vocab().values(), *added], default=-1) + 1
    pieces = [added[i] if i in added else bytes(byte[c] for c in tok.id_to_token(i) or "") for i in range(size)]
    one = _by_ranks(config, pieces)

    def encode(texts: list[str]) -> list[list[int]]:
        if one:
            return [one(" " + t) for t in texts]
        return [e.ids for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return encode, Vocabulary(pieces)


@lru_cache(2)
def _pieces(path: str):
    """(encode list of texts, Vocabulary) of a .model; it adds the space itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        pieces.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode())
    return (lambda texts: sp.encode(texts, num_threads=1)), Vocabulary(pieces)


def _lanes(a: np.ndarray, b: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """First index of each lane in ``a`` and in ``b``, and the lengths at the end; lanes start after a common end."""
    at = np.arange(lane - 1, len(a) - 1, lane)
    moving = np.arange(len(at))
    while moving.size:
        at[moving] += (apart := b[np.searchsorted(b, a[at[moving]])] != a[at[moving]])
        moving = moving[apart]
    at = np.unique(at)
    at = at[at < len(a) - 1]
    return np.concatenate(([0], at + 1, [len(a)])), np.concatenate(([0], np.searchsorted(b, a[at]) + 1, [len(b)]))


def aligned(a: np.ndarray, b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Which ends of ``a`` and of ``b`` are common ends. Both rise strictly and end on the same value."""
    common_a, common_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if not len(a):
        return common_a, common_b
    from_a, from_b = _lanes(a, b, lane)
    i, stop_a, stop_b = from_a[:-1].copy(), from_a[1:], from_b[1:]
    shift, width = from_b[:-1] - i, np.ones(len(i), np.int64)
    live = np.arange(len(i))
    while live.size:
        x, s = i[live], shift[live]
        w = np.minimum(width[live], np.minimum(stop_a[live] - x, stop_b[live] - x - s))
        ends = np.cumsum(w)
        place = np.arange(ends[-1])
        at = np.repeat(x - ends + w, w) + place
        to = at + np.repeat(s, w)
        differs = np.append(np.flatnonzero(a[at] != b[to]), ends[-1])
        first = np.minimum(differs[np.searchsorted(differs, ends - w)], ends)  # where the run of a lane breaks off
        run = place < np.repeat(first, w)
        common_a[at[run]] = True
        common_b[to[run]] = True
        whole = first == ends
        x = x + first - ends + w
        width[live] = np.where(whole, 2 * width[live], 1)
        y = x + s
        unlike = np.flatnonzero(~whole)
        while unlike.size:  # irregular groups: the lesser end moves on
            here, there = a[x[unlike]], b[y[unlike]]
            x[unlike] += here < there
            y[unlike] += there < here
            unlike = unlike[here != there]
        met = ~whole
        common_a[x[met]] = True
        common_b[y[met]] = True
        i[live] = x + met
        shift[live] = y - x
        live = live[i[live] < stop_a[live]]
    return common_a, common_b


def _spelled_groups(ids: tuple, common: tuple, tables: tuple, per_doc: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as text; ``per_doc``: its tokens of both kinds."""
    (ids_a, ids_b), (common_a, common_b) = ids, common
    group_a = np.cumsum(common_a) - common_a
    group_b = np.cumsum(common_b) - common_b
    first_b = np.concatenate(([0], np.flatnonzero(common_b) + 1))
    last_a = np.flatnonzero(common_a) + 1
    n = len(ids_a) + len(ids_b)
    rows_a, long_a, rows_b, long_b = tables
    width = max(rows_a.shape[1], rows_b.shape[1])
    rows, long = np.empty((n, width), np.uint8), np.empty(n, np.int64)
    for place, which, table, lengths in (
        (np.arange(len(ids_a)) + first_b[group_a], 2 * ids_a + common_a, rows_a, long_a),
        (np.arange(len(ids_b)) + last_a[group_b], 2 * ids_b + common_b, rows_b, long_b),
    ):
        rows[place, : table.shape[1]] = table[which]
        long[place] = lengths[which]
    text = rows[np.arange(width) < long[:, None]].tobytes()
    stops = np.concatenate(([0], np.cumsum(long)))[np.concatenate(([0], np.cumsum(per_doc)))].tolist()
    return [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(stops, stops[1:])]


def _linked(texts: list[str], path_a: str, path_b: str, tables: tuple) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of some texts: (n_a, n_b, n_groups, n_links) each, digests, sorted distinct (text << bits | pair) and how often each is linked."""
    (encode_a, va), (encode_b, vb) = _byte_level(path_a), _pieces(path_b)
    ids = []
    for text, x, y in zip(texts, encode_a(texts), encode_b(texts)):
        want = b" " + text.encode()
        good = text != "" and b"".join(map(va.bytes.__getitem__, x)) == want and b"".join(map(vb.bytes.__getitem__, y)) == want
        ids.append((x, y) if good else ((), ()))
    n_a, n_b = (np.array([len(t[k]) for t in ids], np.int64) for k in (0, 1))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(t[k] for t in ids), np.int64, n.sum()) for k, n in ((0, n_a), (1, n_b)))
    a, b = np.cumsum(va.sizes[ids_a]), np.cumsum(vb.sizes[ids_b])
    common = common_a, common_b = aligned(a, b)
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    inner = np.flatnonzero(~common_b)
    # each stretch between neighbouring ends of either kind is the overlap of one token of each
    link_a = np.concatenate((np.arange(len(a)), np.searchsorted(a, b[inner])))
    link_b = np.concatenate((np.searchsorted(b, a), inner))
    keys, times = np.unique((doc_a[link_a] << _bits(va, vb)) | (ids_a[link_a] * len(vb.bytes) + ids_b[link_b]), return_counts=True)
    counts = np.stack((n_a, n_b, np.bincount(doc_a[common_a], minlength=len(texts)), np.bincount(doc_a[link_a], minlength=len(texts))))
    return counts, _spelled_groups((ids_a, ids_b), common, tables, n_a + n_b), keys, times


def _bits(va: Vocabulary, vb: Vocabulary) -> int:
    bits = (len(va.bytes) * len(vb.bytes)).bit_length()
    if bits + BLOCK_CHARS.bit_length() > 62:
        raise ValueError("vocabularies too large for pairs of ids in 64 bits")
    return bits


_LONGS = T.ArrayType(T.LongType())


def _block_type(doc_id: T.DataType) -> T.StructType:
    fields = [("block", T.LongType()), ("doc_ids", T.ArrayType(doc_id)), *[(c, _LONGS) for c in ("n_a", "n_b", "n_groups", "n_links")], ("digests", T.ArrayType(T.StringType())), ("pairs", _LONGS), ("n_docs", T.ArrayType(T.IntegerType())), ("entries", _LONGS), ("links", T.BinaryType())]
    return T.StructType([T.StructField(*f) for f in fields])


def _blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per block: its documents, its distinct pairs with their documents, and each document's pairs (place and times, packed)."""
    va, vb = _byte_level(path_a)[1], _pieces(path_b)[1]
    tables = (*va.spelled(b",|"), *vb.spelled(b",;"))
    bits = _bits(va, vb)
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids: list = []
    texts: list[str] = []
    parts: list[tuple] = []
    waiting = held = block = before = 0

    def scan() -> None:
        nonlocal waiting, before
        if texts:
            counts, digests, keys, times = _linked(texts, path_a, path_b, tables)
            parts.append((counts, digests, keys + (before << bits), times))
            before += len(texts)
            texts.clear()
        waiting = 0

    def flush() -> pa.RecordBatch:
        scan()
        counts = np.concatenate([p[0] for p in parts], axis=1)
        keys, times = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        pairs, place = np.unique(keys & ((1 << bits) - 1), return_inverse=True)
        row = {
            "block": first + block, "doc_ids": list(ids), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts)), "digests": [d for p in parts for d in p[1]],
            "pairs": pairs, "n_docs": np.bincount(place, minlength=len(pairs)).astype(np.int32), "entries": np.bincount(keys >> bits, minlength=len(ids)),
            "links": np.stack((place, times)).astype(np.int32).tobytes(),
        }
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc_id)
            texts.append(text or "")
            waiting += len(texts[-1]) + 1
            held += len(texts[-1]) + 1
            if waiting >= AT_ONCE:
                scan()
            if held >= BLOCK_CHARS:
                yield flush()
                block, held, before = block + 1, 0, 0
                ids.clear()
                parts.clear()
    if ids:
        yield flush()


def _summed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per document from a block and the corpus-wide counts of its pairs (twice the count, plus one if it is its A id's highest)."""
    for batch in batches:
        for row in range(batch.num_rows):
            col = {n: batch.column(n)[row] for n in batch.schema.names}
            marks = col["marks"].values.to_numpy(zero_copy_only=False) if col["marks"].is_valid else np.empty(0, np.int64)
            place, times = np.frombuffer(col["links"].as_py(), np.int32).reshape(2, -1)
            doc = np.repeat(np.arange(len(col["doc_ids"])), col["entries"].values.to_numpy(zero_copy_only=False))
            sums = []
            for per_link in (marks & 1, marks >> 1):
                total = np.zeros(len(col["doc_ids"]), np.int64)
                np.add.at(total, doc, per_link[place] * times)
                sums.append(total)
            out = {"doc_id": col["doc_ids"].values, **{n: col[n].values for n in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": col["digests"].values}
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)


def blocks(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Aligned documents by block; ``pairs`` are A id x size of B + B id, ascending."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = _block_type(docs.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)
    return docs.mapInArrow(lambda it: _blocks(it, path_a, path_b, arrow), schema)


def pair_counts(aligned_blocks: DataFrame, size_b: int) -> DataFrame:
    """(pair, a_id, b_id, n_docs, best): documents that hold a pair linked; best: none of its A id has more.

    An A id has at most ``size_b`` pairs, which bounds the window.
    """
    each = aligned_blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select("p.pairs", "p.n_docs")
    total = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("n_docs"))
    ids = total.select("pair", F.expr(f"pair div {size_b}").alias("a_id"), F.expr(f"pair % {size_b}").alias("b_id"), "n_docs")
    return ids.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a_id")))


def alignments(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs``."""
    made = Staged(blocks(docs, path_a, path_b, doc_id, text), "aligned").df
    counts = pair_counts(made, len(_pieces(path_b)[1].bytes)).select("pair", (2 * F.col("n_docs") + F.col("best").cast("int")).alias("mark"))
    known = made.select("block", F.explode("pairs").alias("pair")).join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "mark"))).alias("m"))
    whole = made.join(known.select("block", F.col("m.mark").alias("marks")), "block", "left")
    schema = T.StructType([T.StructField("doc_id", made.schema["doc_ids"].dataType.elementType), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)
    wanted = ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "entries", "links", "marks")
    return whole.select(*wanted).mapInArrow(lambda it: _summed(it, arrow), schema)
