"""Operator 6, byte-level BPE by vectorised pre-tokenisation.

The texts of a batch become one array of code point classes. The only part of
the splitting pattern that is not local is whether an apostrophe begins a
piece, which a six-state automaton decides; its transition functions compose
associatively, so they are scanned in blocks: every block's function at once,
a prefix scan over the blocks, then the states inside all blocks at once. From
class, neighbour and state the piece boundaries follow without a regular
expression. The slices go through a cache of merged pairs; every id keeps the
byte offset of its token, by which decoding places the bytes.

Defined cases: null and empty texts have no ids; a text of any length is
encoded whole (a long one in exact parts, so memory follows the part); a batch
is worked off in slices of whole rows, so memory follows the slice; repeated
rows and clashing column names are no matter, as columns are added to a
selection the caller names.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTER, NUMBER, OTHER, SPACE, BLANK, SHORT, LONG, END = range(8)
#: White space of the Unicode standard (the space itself apart).
WHITE_SPACE = (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16.0 added, which the interpreter's tables (15.1) lack.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Stands between texts; no code point.
BETWEEN = 0x110000

#: States: what the character before leaves open.
FREE, RUN, AFTER_SPACE, ONE_LEFT, TWO_LEFT, CUT = range(6)
STATES = 8  # a row of the table has room for eight

#: Characters of a block of the scan; characters handled at once; pieces that a worker remembers, and their greatest length.
BLOCK, AT_ONCE, REMEMBERED, LONGEST = 64, 1 << 18, 1 << 18, 64


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point, and of BETWEEN."""
    out = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(BETWEEN)), np.uint8, BETWEEN)
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[list(WHITE_SPACE)] = BLANK
    out[0x20] = SPACE
    return np.append(out, np.uint8(END))


@lru_cache(1)
def transitions() -> np.ndarray:
    """State after a symbol, at [symbol * STATES + state before]."""
    out = np.zeros((8, STATES), np.uint8)
    out[[LETTER, NUMBER, BLANK, END]] = FREE
    out[SPACE] = AFTER_SPACE
    out[[OTHER, SHORT, LONG]] = RUN
    for s in (FREE, CUT):  # here an apostrophe begins a piece
        out[SHORT, s], out[LONG, s] = ONE_LEFT, TWO_LEFT
    out[LETTER, ONE_LEFT], out[LETTER, TWO_LEFT] = CUT, ONE_LEFT
    return out.ravel()


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked scan of transition functions."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    columns = np.full(blocks * BLOCK, END, np.uint8)
    columns[:n] = symbols
    columns = np.ascontiguousarray(columns.reshape(blocks, BLOCK).T).astype(np.intp) * STATES
    table = transitions()
    function = np.tile(np.arange(6, dtype=np.uint8), (blocks, 1))
    for column in columns:
        function = table[column[:, None] + function]
    step = 1
    while step < blocks:  # prefix scan: each function after all before it
        function = np.concatenate((function[:step], np.take_along_axis(function[step:], function[:-step].astype(np.intp), 1)))
        step *= 2
    state = np.concatenate(([FREE], function[:-1, FREE])).astype(np.uint8)
    out = np.empty((BLOCK, blocks), np.uint8)
    for k, column in enumerate(columns):
        out[k] = state
        state = table[column + state]
    return out.T.ravel()[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """True where a piece begins, and at BETWEEN. points: code points of texts, each followed by BETWEEN."""
    kind = classes()[points]
    after = np.append(points[1:], BETWEEN)
    after2 = np.append(after[1:], BETWEEN)
    quote = points == ord("'")
    symbols = kind.copy()
    symbols[quote & np.isin(after, [ord(c) for c in "stmd"])] = SHORT
    two = np.zeros(len(points), bool)
    for a, b in ("re", "ve", "ll"):
        two |= (after == ord(a)) & (after2 == ord(b))
    symbols[quote & two] = LONG
    state = states_before(symbols)
    before = np.concatenate(([END], kind[:-1])).astype(np.uint8)
    white = (kind == SPACE) | (kind == BLANK)
    after_white = (before == SPACE) | (before == BLANK)
    next_kind = np.append(kind[1:], np.uint8(END))
    last_white = (next_kind != SPACE) & (next_kind != BLANK) & (next_kind != END)
    inside = (state == ONE_LEFT) | (state == TWO_LEFT) | (state == AFTER_SPACE)
    word = ~inside & ~((before == kind) & (state == FREE))  # letters, numbers: unless the same run goes on
    mark = ~inside & (state != RUN)
    return np.where(white, ~after_white | last_white, np.where(kind == OTHER, mark, word)) | (kind == END)


@lru_cache(4)
def load_ranks(path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Ranks by bytes; all tokens' bytes in a row, and where each id's begin (an id without a token has none)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for t, r in ranks.items():
        tokens[r] = t
    return ranks, np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens])))


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a piece: the pair of lowest rank is merged first, the leftmost of equals."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if (n := len(piece)) <= LONGEST:
        return _merged_short(piece, ranks)
    after, before, parts = list(range(1, n + 1)), list(range(-1, n - 1)), [piece[i : i + 1] for i in range(n)]
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    end = dict.fromkeys(range(n))  # first byte of each part that stands
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if i not in end or after[i] != j or j not in end or after[j] != stop:
            continue  # one of the two has been merged since
        parts[i] += parts[j]
        del end[j]
        after[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(parts[i] + parts[stop])) is not None:
                heapq.heappush(heap, (r, i, stop, after[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (r, h, i, stop))
    return tuple(ranks[parts[i]] for i in end)


def _merged_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for a short piece, where a look over all pairs costs less than a heap."""
    none, get = len(ranks) + (1 << 32), ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return tuple([ranks[p] for p in parts])


_seen: dict[str, dict[str, tuple[int, ...]]] = {}


def _ids_of(pieces: list[str], path: str) -> list[tuple[int, ...]]:
    ranks, seen, out = load_ranks(path)[0], _seen.setdefault(path, {}), []
    for p in pieces:
        if (ids := seen.get(p)) is None:
            ids = merged(p.encode(), ranks)
            if len(p) <= LONGEST:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[p] = ids
        out.append(ids)
    return out


def parts_of(text: str, most: int = AT_ONCE) -> list[str]:
    """A long text in parts that split alike: cut only before a space between two ASCII letters, where a piece always begins."""
    out, at = [], 0
    while len(text) - at > most:
        cut = at + most
        while (cut := text.find(" ", cut)) > 0 and not (text[cut - 1].isascii() and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isascii() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def split_parts(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts in a row, and the number of pieces of each."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[stops] = BETWEEN
    starts = np.flatnonzero(boundaries(points))
    ends = np.append(starts[1:], len(points))
    real = points[starts] != BETWEEN
    starts, ends = starts[real], ends[real]
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())], np.diff(np.searchsorted(starts, stops), prepend=0)


def encode_parts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and the number of ids of each."""
    pieces, n = split_parts(texts)
    index: dict[str, int] = {}
    order = np.array([index.setdefault(p, len(index)) for p in pieces], np.intp)
    merged_ids = _ids_of(list(index), path)
    lengths = np.fromiter(map(len, merged_ids), np.int64, len(merged_ids))
    flat = np.fromiter(chain.from_iterable(merged_ids), np.int32, int(lengths.sum()))
    counts = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    total = np.cumsum(counts)
    ids = flat[np.repeat(first - (total - counts), counts) + np.arange(counts.sum())]
    upto = np.concatenate(([0], total))[np.cumsum(n)]
    return ids, np.diff(upto, prepend=0)


def encode_batch(texts: list[str | None], path: str) -> tuple[pa.ListArray, pa.ListArray]:
    """ids and byte offsets of each text."""
    ids, sizes = [], np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owners: list[int] = []

    def flush():
        if parts:
            got, n = encode_parts(parts, path)
            ids.append(got)
            np.add.at(sizes, owners, n)
            parts.clear()
            owners.clear()

    held = 0
    for k, text in enumerate(texts):
        for part in parts_of(text or ""):
            if held + len(part) > AT_ONCE:
                flush()
                held = 0
            held += len(part) + 1
            parts.append(part)
            owners.append(k)
    flush()
    flat = np.concatenate([*ids, np.empty(0, np.int32)])
    spans = np.concatenate(([0], np.cumsum(sizes)))
    begins = load_ranks(path)[2]
    ends = np.concatenate(([0], np.cumsum(begins[flat + 1] - begins[flat])))
    offsets = ends[:-1] - np.repeat(ends[spans[:-1]], sizes)
    of = pa.array(spans.astype(np.int32))
    return pa.ListArray.from_arrays(of, pa.array(flat.astype(np.int32))), pa.ListArray.from_arrays(of, pa.array(offsets.astype(np.int64)))


def decode_batch(ids: pa.ListArray, offsets: pa.ListArray, path: str) -> pa.Array:
    """The bytes of each row's ids, every token's placed at its offset; null for null."""
    _, blob, begins = load_ranks(path)
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, at = ids.flatten().to_numpy(zero_copy_only=False), offsets.flatten().to_numpy(zero_copy_only=False)
    last = (np.cumsum(lengths) - 1)[lengths > 0]
    row_bytes = np.zeros(len(lengths), np.int64)
    row_bytes[lengths > 0] = at[last] + begins[flat[last] + 1] - begins[flat[last]]
    bounds = np.concatenate(([0], np.cumsum(row_bytes)))
    to = at + np.repeat(bounds[:-1], lengths)
    text = np.empty(bounds[-1], np.uint8)
    for k in range(0, len(flat), AT_ONCE):
        first = begins[flat[k : k + AT_ONCE]]
        n = begins[flat[k : k + AT_ONCE] + 1] - first
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text[np.repeat(to[k : k + AT_ONCE], n) + within] = blob[np.repeat(first, n) + within]
    out = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text)])
    return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.binary())) if ids.null_count else out


def slices(batch: pa.RecordBatch, by: str, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows whose texts or lists in column ``by`` begin within the same ``most`` bytes or elements."""
    c = batch.column(batch.schema.get_field_index(by))
    size = pc.list_value_length(c) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length(c)
    sizes = pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)


def _added(df: DataFrame, inputs: list[str], outputs: list[tuple[str, T.DataType]], work, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``df``, without what is dropped, with columns that ``work`` makes of the inputs' arrays, slice by slice."""
    kept = [f for f in df.schema.fields if f.name not in dropped]
    at = [k for k, f in enumerate(df.schema.fields) if f.name not in dropped]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, inputs[0]):
                columns = [b.column(b.schema.get_field_index(c)) for c in inputs]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in at], *work(*columns)], [*[f.name for f in kept], *[n for n, _ in outputs]])

    schema = T.StructType(list(kept))
    for name, kind in outputs:
        schema = schema.add(name, kind)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """``df`` with the ids of ``text`` under the ranks at ``path`` and the byte offset of each id's token."""
    return _added(df, [text], [(ids, T.ArrayType(T.IntegerType())), (offsets, T.ArrayType(T.LongType()))], lambda t: encode_batch(t.to_pylist(), path))


def decode(df: DataFrame, path: str, ids: str = "ids", offsets: str = "offsets", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for."""
    return _added(df, [ids, offsets], [(out, T.BinaryType())], lambda i, o: (decode_batch(i, o, path),))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of ``text`` and the bytes that they decode to instead of it: one pass, so no ids travel to be decoded."""
    def work(texts):
        got, offsets = encode_batch(texts.to_pylist(), path)
        return got, decode_batch(got, offsets, path)

    return _added(df, [text], [(ids, T.ArrayType(T.IntegerType())), (decoded, T.BinaryType())], work, dropped=(text,))


def digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, n_tokens, ids_sha256, decoded_sha256 and the ids, after encoding and decoding."""
    coded = round_trip(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep), path)
    return coded.select(
        "doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids",
    )
