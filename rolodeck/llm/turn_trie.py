"""Operator 12, the prefix trie of conversations, from ternary search trees per range shard.

Distinct turns (role and text) get numbers, in the order of their SHA-256, and
a conversation is a path of numbers. Equal paths become one row; paths are cut
into ranges of their order (shards), so the paths below a node lie in one shard
or in neighbouring ones. A shard builds a ternary search tree, inserting the
median path first, then the medians of the halves, which keeps it balanced,
and walks it with a stack; sums then run from the last node back to the
first, children before parents.

A node that continues in a neighbouring shard (a prefix of its last path, or of
the first path of the next) is a boundary node. A shard knows of its
neighbours only how long a prefix it shares with them: the first of the
shards that hold a node counts it as its parent's child and takes the node's
words off the savings once, so all figures of boundary nodes are sums of the
shards' parts. There are at most two paths of boundary nodes per shard; they
are merged by the digest of their prefix and joined to their children, which
learn the smallest member of their parent.

How skew is met: a turn that very many conversations hold is one row of the
dictionary, joined by a skew-split join; equal conversations are counted
before they are shuffled (map-side), and the list of a node's own members,
which a digest is taken of, is dealt by range, packed into bounded strings and
only then hashed in order, a string at a time.

Defined cases: rows without conv_id belong to no conversation and are left
out; a null turn comes first, a null role or text is empty; equal turn numbers
are ordered by the SHA-256 of role and text; repeated rows are turns of their
own. Other columns are not looked at. A conversation is held as one row of
numbers. No conversations give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rolodeck.llm.staging import staged

#: Paths of a shard, about; members of a packed string; every how many ids another conversation lends its first turns.
SHARD_PATHS, PACKED, STEP = 1 << 15, 1 << 15, 20
BLANK = r"[\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): numbers and words of the turns, after the first turns of conversation c - c % 20 replaced c's own.

    The first h turns, h = crc32(decimal c) % 4; path is an array of (id, words).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.size(F.array_remove(F.split(text, BLANK), ""))
    turns = staged(conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), words.alias("words")), "turns")
    distinct = turns.select("digest").distinct()
    numbered = staged(distinct.sort("digest").select("digest", F.monotonically_increasing_id().alias("id")), "dictionary")
    encoded = staged(turns.join(numbered, "digest").select("conv_id", "turn", "id", "words"), "encoded")
    entry = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.col("id"), F.col("words"))
    own = encoded.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    own = staged(own.select("conv_id", F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("all")), "own")
    heads = own.where(F.col("conv_id") % STEP == 0).select(F.col("conv_id").alias("head"), F.slice("all", 1, 3).alias("lent"))
    c = own.select("conv_id", "all", (F.col("conv_id") - F.col("conv_id") % STEP).alias("head"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int").alias("h"))
    lent = F.slice(F.coalesce("lent", F.array().cast(own.schema["all"].dataType)), F.lit(1), F.col("h"))
    rest = F.when(F.size("all") > F.col("h"), F.slice("all", F.col("h") + 1, F.greatest(F.size("all"), F.lit(1)))).otherwise(F.slice("all", 1, 0))
    return c.join(heads, "head", "left").select("conv_id", F.concat(lent, rest).alias("path"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each leaf's strings in order; a leaf's rows follow each other."""
    leaf, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for at, packed in zip(batch.column("leaf").to_pylist(), batch.column("packed").to_pylist()):
            if at != leaf:
                if state:
                    done.append((leaf, state.hexdigest()))
                leaf, state = at, hashlib.sha256(packed.encode())
            else:
                state.update(b"," + packed.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in ((0, pa.int64()), (1, pa.string()))], names=["leaf", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([state.hexdigest()])], names=["leaf", "ends"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring members of a leaf as one string of at most PACKED ids."""
    leaf, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["leaf", "first", "packed"])

    for batch in batches:
        rows = []
        for at, conv in zip(batch.column("leaf").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (at != leaf or len(ids) >= PACKED):
                rows.append(row())
                ids = []
            leaf = at
            ids.append(conv)
        if rows:
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
    if ids:
        yield row()


def member_digests(members: DataFrame) -> DataFrame:
    """(leaf, ends): SHA-256 of the decimal conv_ids of each leaf, ascending and joined by commas."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = members.select("leaf", "conv_id").repartitionByRange(n, "leaf", "conv_id").sortWithinPartitions("leaf", "conv_id")
    packed = ranges.mapInArrow(_packed, "leaf long, first long, packed string")
    return packed.repartition(n, "leaf").sortWithinPartitions("leaf", "first").mapInArrow(_hashed, "leaf long, ends string")


def paths_of(conversations: DataFrame) -> DataFrame:
    """(leaf, ids, words, n, least, ends): each distinct path with the conversations that are it; leaf rises with the path."""
    whole = staged(conversations.select("conv_id", F.col("path.id").alias("ids"), F.col("path.words").alias("words")), "rebuilt")
    equal = whole.groupBy("ids").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    ordered = staged(equal.sort("ids").withColumn("leaf", F.monotonically_increasing_id()), "paths")
    members = whole.join(ordered.select("ids", "leaf"), "ids").select("leaf", "conv_id")
    return ordered.join(staged(member_digests(members), "ends"), "leaf")


def _shared(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays of numbers, -1 if there are not two."""
    n = F.least(F.size(a), F.size(b))
    apart = F.array_position(F.transform(F.arrays_zip(F.slice(a, F.lit(1), n).alias("x"), F.slice(b, F.lit(1), n).alias("y")), lambda p: p["x"] == p["y"]), False)
    return F.when(a.isNull() | b.isNull(), -1).when(apart > 0, apart - 1).otherwise(n).cast("int")


def sharded(paths: DataFrame, shard_paths: int) -> DataFrame:
    """``paths`` with its shard and the lengths that the shard shares with the one before (``head``) and after (``tail``)."""
    n = max(1, -(-paths.count() // shard_paths))
    dealt = staged(paths.repartitionByRange(n, "leaf").withColumn("shard", F.spark_partition_id()), "sharded")
    ends = dealt.groupBy("shard").agg(F.min_by("ids", "leaf").alias("first"), F.max_by("ids", "leaf").alias("last"))
    by_shard = Window.orderBy("shard")  # two paths a shard
    before, after = F.lag("last").over(by_shard), F.lead("first").over(by_shard)
    borders = ends.withColumn("before", before).withColumn("after", after).select("shard", _shared(F.col("before"), F.col("first")).alias("head"), _shared(F.col("last"), F.col("after")).alias("tail"))
    return dealt.join(staged(borders, "borders"), "shard")


def _medians(n: int) -> Iterator[int]:
    """0 .. n-1, the median first, then the medians of the halves."""
    waiting = [(0, n)]
    while waiting:
        low, high = waiting.pop()
        if low < high:
            mid = (low + high) // 2
            yield mid
            waiting += [(mid + 1, high), (low, mid)]


class Tree:
    """A ternary search tree of paths; node 0 is the root of the trie, every other one a turn after its parent."""

    def __init__(self):
        self.turn, self.words, self.end = [None], [0], [-1]
        self.less, self.more, self.below = [-1], [-1], [-1]

    def _new(self, turn: int, words: int) -> int:
        self.turn.append(turn)
        self.words.append(words)
        for links in (self.end, self.less, self.more, self.below):
            links.append(-1)
        return len(self.turn) - 1

    def insert(self, ids: list[int], words: list[int], path: int) -> None:
        node = 0
        for turn, n in zip(ids, words):
            links, at, here = self.below, node, self.below[node]
            while here >= 0 and self.turn[here] != turn:
                links, at = (self.less if turn < self.turn[here] else self.more), here
                here = links[at]
            if here < 0:
                here = links[at] = self._new(turn, n)
            node = here
        self.end[node] = path

    def walk(self) -> tuple[list[int], list[int]]:
        """(nodes, parent of each): parents before children, siblings in the order of their turns."""
        order, parents = [0], [-1]
        waiting = [(self.below[0], 0, False)]
        while waiting:
            node, parent, seen = waiting.pop()
            if node < 0:
                continue
            if seen:
                order.append(node)
                parents.append(parent)
                waiting.append((self.below[node], node, False))
            else:
                waiting += [(self.more[node], parent, False), (node, parent, True), (self.less[node], parent, False)]
        return order, parents


def _prefix_keys(ids: list[int], longest: int) -> list[bytes]:
    """A digest of each prefix up to that length, from the empty one on."""
    state, keys = hashlib.sha256(), []
    for d in range(longest + 1):
        keys.append(d.to_bytes(8, "big") + state.digest()[:24])
        if d < longest:
            state.update(ids[d].to_bytes(8, "big", signed=True))
    return keys


def shard_nodes(ids: list[list[int]], words: list[list[int]], n: list[int], least: list[int], ends: list[str], head: int, tail: int) -> dict[str, list]:
    """The nodes of one shard's distinct, sorted paths; those shared with a neighbour carry a key and are parts of a sum."""
    tree = Tree()
    for path in _medians(len(ids)):
        tree.insert(ids[path], words[path], path)
    order, parents = tree.walk()
    number = {node: i for i, node in enumerate(order)}
    parent = [number[p] if p >= 0 else -1 for p in parents]
    end = [tree.end[node] for node in order]
    depth = [0] * len(order)
    convs = [n[e] if e >= 0 else 0 for e in end]
    member = [least[e] if e >= 0 else None for e in end]
    children, leaves, saved = [0] * len(order), [0] * len(order), [0] * len(order)
    key: list[bytes | None] = [None] * len(order)
    owned = [True] * len(order)
    inner = [False] * len(order)  # has a turn after it, here or in the next shard
    of = {}
    for i, node in enumerate(order[1:], 1):
        of[parent[i], tree.turn[node]] = i
        depth[i] = depth[parent[i]] + 1
        inner[parent[i]] = True
    for path, longest, before in ((ids[0], head, True), (ids[-1], tail, False)):
        at = 0
        for d, k in enumerate(_prefix_keys(path, longest)):
            if d:
                at = of[at, path[d - 1]]
            key[at] = k
            if before:
                owned[at] = False
    if tail == len(ids[-1]):
        at = 0
        for turn in ids[-1]:
            at = of[at, turn]
        inner[at] = True
    for i in range(len(order) - 1, -1, -1):
        w = tree.words[order[i]]
        saved[i] += convs[i] * w - (w if owned[i] else 0)
        if not inner[i]:
            leaves[i] += 1
        p = parent[i]
        if p >= 0:
            convs[p] += convs[i]
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            children[p] += owned[i]
            if member[p] is None or (member[i] is not None and member[i] < member[p]):
                member[p] = member[i]
    return {
        "conv_id": member, "depth": depth, "parent_conv_id": [member[p] if p >= 0 and key[p] is None else None for p in parent], "n_convs": convs, "n_children": children, "n_leaves": leaves,
        "saved_tokens": saved, "ends_sha256": [ends[e] if e >= 0 else None for e in end], "key": key, "parent_key": [key[p] if p >= 0 else None for p in parent],
    }


def _trees(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard; the rows of a shard follow each other, sorted."""
    shard, rows = None, []

    def nodes() -> pa.RecordBatch:
        columns = [[r[k] for r in rows] for k in range(5)]
        made = shard_nodes(*columns, rows[0][5], rows[0][6])
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "words", "n", "least", "ends", "head", "tail"))):
            if at != shard and rows:
                yield nodes()
                rows = []
            shard = at
            rows.append(row)
    if rows:
        yield nodes()


def trie(paths: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """The nodes of all paths of ``paths_of``."""
    spark = paths.sparkSession
    schema = T.StructType.fromDDL(_NODE)
    arrow = to_arrow_schema(schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sharded(paths, shard_paths).repartition(n, "shard").sortWithinPartitions("shard", "leaf")
    parts = staged(dealt.select("shard", "ids", "words", "n", "least", "ends", "head", "tail").mapInArrow(lambda it: _trees(it, arrow), schema), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.where("key IS NOT NULL").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.first("parent_key").alias("parent_key"))
    boundary = staged(merged, "boundary")  # two paths a shard at most
    own = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    within = parts.where("key IS NULL")
    ready = within.where("parent_key IS NULL").select(*own, "parent_conv_id")
    parents = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    hung = within.select(*own, "parent_key").unionByName(boundary.where("parent_key IS NOT NULL").select(*own, "parent_key")).where("parent_key IS NOT NULL").join(parents, "parent_key").select(*own, "parent_conv_id")
    root = boundary.where("parent_key IS NULL").select(*own, F.lit(None).cast("long").alias("parent_conv_id"))
    nodes = ready.unionByName(hung).unionByName(root)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row per node."""
    return trie(paths_of(rebuilt(conversations)), shard_paths)
