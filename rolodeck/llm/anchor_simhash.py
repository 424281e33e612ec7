"""Operator 7, SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints are linked at ``max_bits`` (4) or fewer differing bits.
The 64 bits are cut into three segments; four differing bits leave at least
one segment with at most one. In each segment the anchors are the words of a
covering code of radius 1: a Hamming [15, 11] code on the first 15 bits, every
value on the rest. A fingerprint is at home at its nearest anchor (distance
<= 1) and is copied to every anchor within covering radius plus threshold
(distance <= 2, about 14 anchors of 2**17 a segment), so the home of either of
two linked fingerprints holds a copy of the other. Fingerprints are compared
per anchor, homes against all, which finds every link exactly.

Equal fingerprints are one node, so copies cost nothing. A bucket hands on a
spanning forest of its links, never all pairs. An anchor with more than
``BUCKET`` rows is split into chunks, and each two chunks meet in a bucket of
their own, so no task holds an unbounded bucket.

Defined cases: a text without words (null, empty or blank) has fingerprint
zero and links like any other; repeated rows each get their row; a null doc_id
belongs to its component but never names it; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolodeck.llm.components import connected_components
from rolodeck.llm.staging import Staged, staged

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: (first bit, width) of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Bits of a segment under the Hamming code, whose covering radius is 1; the others are free.
CODED, RADIUS = 15, 1
#: Most rows of a bucket, and most comparisons made at once.
BUCKET, AT_ONCE = 1 << 16, 1 << 21


def simhash64(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed long: bit set where over half of the shingles' XXH64 have it."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z, and blanks \x20 and \x09-\x0D, only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - size, 0)
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    first, stop = starts[: last + 1].tolist(), (ends[size - 1 :] if len(words) >= size else ends[-1:]).tolist()
    for at in range(0, last + 1, 1 << 15):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 15)], stop[at : at + (1 << 15)])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last + 1, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash64(t) for t in texts], dtype="int64")


def _masks(width: int, reach: int) -> list[np.ndarray]:
    """By syndrome of the coded bits: what turns a segment into each anchor within ``reach``, the nearest first."""
    def flips(positions, most):
        return [(sum(1 << p for p in c), k) for k in range(most + 1) for c in combinations(positions, k)]

    by: list[list[tuple[int, int]]] = [[] for _ in range(CODED + 1)]
    for coded, k in flips(range(CODED), reach):
        syndrome = 0
        for p in range(CODED):
            if coded >> p & 1:
                syndrome ^= p + 1
        by[syndrome] += [(k + j, coded | free) for free, j in flips(range(CODED, width), reach - k)]
    return [np.array([m for _, m in sorted(x)], np.int64) for x in by]


def _syndromes() -> np.ndarray:
    values, out = np.arange(1 << CODED), np.zeros(1 << CODED, np.int64)
    for p in range(CODED):
        out ^= np.where(values >> p & 1, p + 1, 0)
    return out


def anchored(batches: Iterator[pa.RecordBatch], max_bits: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """(anchor, fp, home) of each fingerprint, for every anchor within reach."""
    syndromes = _syndromes()
    masks = [_masks(width, RADIUS + max_bits // len(SEGMENTS)) for _, width in SEGMENTS]
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 1 << 14):
            part = fps[at : at + (1 << 14)]
            anchors, copies, home = [], [], []
            for k, (first, width) in enumerate(SEGMENTS):
                segment = part.view(np.uint64) >> np.uint64(first) & np.uint64((1 << width) - 1)
                segment = segment.astype(np.int64)
                syndrome = syndromes[segment & ((1 << CODED) - 1)]
                for s, m in enumerate(masks[k]):
                    own = syndrome == s
                    if own.any():
                        anchors.append((segment[own][:, None] ^ m | k << 32).ravel())
                        copies.append(np.repeat(part[own], len(m)))
                        home.append(np.tile(np.arange(len(m)) == 0, own.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (anchors, copies, home)], ["anchor", "fp", "home"])


def _apart(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the bits of the absolute value


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links (a, b), as links of each node to its least one."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        after = label.copy()
        np.minimum.at(after, a, label[b])
        np.minimum.at(after, b, label[a])
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for all links within one large bucket: what is reached leaves the rest, so a dense bucket is near linear."""
    found, to = [], []
    while len(fps):
        root, fps, front = fps[0], fps[1:], [fps[0]]
        while front and len(fps):
            near = _apart(fps, front.pop()) <= max_bits
            if near.any():
                reached, fps = fps[near], fps[~near]
                front += list(reached)
                found.append(reached)
                to.append(np.full(len(reached), root))
    return (np.concatenate(found), np.concatenate(to)) if found else (fps[:0], fps[:0])


def _linked(fps: np.ndarray, home: np.ndarray, starts: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star links of whole buckets; starts: where each begins, and the end."""
    sizes = np.diff(starts)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    work = np.bincount(bucket, weights=home, minlength=len(sizes)) * sizes
    for k in np.flatnonzero(work > AT_ONCE):
        yield _forest(fps[starts[k] : starts[k + 1]], max_bits)
    homes = np.flatnonzero(home & (work <= AT_ONCE)[bucket] & (sizes > 1)[bucket])
    others = sizes[bucket[homes]]
    upto = np.cumsum(others)
    at = 0
    while at < len(homes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        n = others[at:end]
        one = np.repeat(homes[at:end], n)
        two = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[bucket[homes[at:end]]], n)
        apart = _apart(fps[one], fps[two])
        near = (apart <= max_bits) & (apart > 0)
        if near.any():
            yield _stars(fps[one[near]], fps[two[near]])
        at = end


def compared(batches: Iterator[pa.RecordBatch], max_bits: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within each bucket of rows (anchor, part, fp, home), which come bucket by bucket."""
    def out(key, fps, home):
        if len(fps):
            starts = np.concatenate(([0], np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)) + 1, [len(fps)]))
            for a, b in _linked(fps, home, starts, max_bits):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    columns = ("anchor", "part", "fp", "home")
    held = None
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(new[0]):
            continue
        rows = [np.concatenate(x) for x in zip(held, new)] if held else new
        whole = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(whole[-1]) + 1 if len(whole) else 0  # the last bucket may go on in the next batch
        yield from out((rows[0][:cut], rows[1][:cut]), rows[2][:cut], rows[3][:cut])
        held = [x[cut:].copy() for x in rows]
    if held:
        yield from out((held[0], held[1]), held[2], held[3])


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that have the same components as all links within ``max_bits``."""
    copies = fps.mapInArrow(lambda it: anchored(it, max_bits), "anchor long, fp long, home boolean")
    crowded = copies.groupBy("anchor").count().where(F.col("count") > bucket).select("anchor", F.ceil(F.col("count") / bucket).cast("int").alias("chunks"))
    # written first, so that its size is known before it is joined
    rows = copies.join(staged(crowded, "crowded"), "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(own, k) * F.col("chunks") + F.greatest(own, k))
    rows = rows.select("anchor", "fp", "home", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(meets)).alias("part"))
    buckets = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part").select("anchor", "part", "fp", "home")
    return buckets.mapInArrow(lambda it: compared(it, max_bits), "a long, b long").distinct()


def near_duplicates(prints: DataFrame, doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component, component_id) of each fingerprint: a fingerprint that stands for its component, and the least
    doc_id that its links reach. prints: (doc_id, fp), written."""
    nodes = Staged(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "fingerprints")
    parts = connected_components(fingerprint_links(nodes.df.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    member = staged(nodes.df.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "members")
    # written by itself, so that a component with most of the fingerprints is broadcast to or split, not aggregated and joined in one task
    least = staged(member.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    return member.join(least, "component").select("fp", "component", "component_id")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``."""
    prints = staged(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "simhash")
    classes = staged(near_duplicates(prints, max_bits=max_bits), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the least doc_id (nulls last), of repeated rows any one.

    The documents are written once with a row number and their fingerprint; classes and survivors are found
    on the two narrow columns.
    """
    rows = staged(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp"))
        .withColumn("row", F.monotonically_increasing_id()), "simhash-docs",
    )
    classes = staged(near_duplicates(rows.select("doc_id", "fp"), max_bits=max_bits), "classes")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    best = rows.select("row", "doc_id", "fp").join(classes, "fp").groupBy("component").agg(F.min(first).alias("first"))
    removed = rows.select("row").join(staged(best.select("first.row"), "survivors"), "row", "left_anti")
    # written first: its size is then known, and the documents are shuffled only if it is above the session's threshold
    return rows.join(staged(removed, "removed"), "row", "left_anti").select("doc.*")
