"""The prefix trie against a dictionary of prefixes and against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from rolodeck.llm.op12_queries import ORACLE_12, op12_turn_trie
from rolodeck.llm.turn_trie import Tree, _medians, conversation_trie, shard_nodes

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def _plain(rows):
    """The contract with a dictionary from each prefix to its members."""
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * n
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p] if p in children else 0, leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=str)


def _random(seed, n, words=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b c", "", None, "x\ty z"][:words])) for c in range(n) for t in range(r.randrange(1, 6))]


@pytest.mark.parametrize("shard", [1, 2, 7, 1000])
def test_any_cut_into_shards(spark, shard):
    rows = _random(shard, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _rows(conversation_trie(df, shard)) == _plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (1, None, "u", "x"), (1, 0, None, None), (1, 2, "u", "y"), (1, 2, "u", "y"), (1, 2, "u", "x"), (20, 5, "", ""), (21, 1, "u", "long " * 20000), (-3, 1, "u", "q"),
            (40, 1, "a", "b"), (41, 1, "ab", ""), (43, 1, "1:", "x"), (10**15 + 3, 7, "u", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _plain(rows)
    assert _rows(conversation_trie(df)) == want
    clash = df.selectExpr("*", "1 AS id", "2 AS path", "3 AS key", "4 AS leaf", "5 AS `a.b`")
    assert _rows(conversation_trie(clash, 2)) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted((tuple(r) for r in con.sql(ORACLE_12).fetchall()), key=str) == want
    empty = conversation_trie(df.where("false"))
    assert empty.columns == list(COLUMNS) and empty.count() == 0


def test_one_conversation_told_by_very_many(spark):
    rows = [(c, t, "u", "same words here") for c in range(3000) for t in range(4)] + [(c, 0, "u", f"own {c}") for c in range(3000, 3100)]
    assert _rows(conversation_trie(spark.createDataFrame(rows, SCHEMA), 10)) == _plain(rows)


def test_packed_members_hash_as_one_list(spark, monkeypatch):
    import rolodeck.llm.turn_trie as M

    rows = [{"leaf": leaf, "conv_id": c} for leaf in (1, 2) for c in range(leaf, 500 * leaf, 3)]
    import pyarrow as pa

    monkeypatch.setattr(M, "PACKED", 7)
    packed = list(M._packed(iter(pa.Table.from_pylist(rows).to_batches(max_chunksize=11))))
    found = {leaf: ends for b in M._hashed(iter(packed)) for leaf, ends in zip(*b.to_pydict().values())}
    assert found == {leaf: hashlib.sha256(",".join(str(c) for c in range(leaf, 500 * leaf, 3)).encode()).hexdigest() for leaf in (1, 2)}
    assert sum(b.num_rows for b in packed) > 60


def test_the_tree_is_balanced_and_walked_in_order():
    n = 1023
    tree = Tree()
    for k in _medians(n):
        tree.insert([k], [1], k)
    depth = {tree.below[0]: 1}
    for node in range(1, n + 1):  # links lead to later nodes
        for links in (tree.less, tree.more):
            if links[node] >= 0:
                depth[links[node]] = depth[node] + 1
    order, parents = tree.walk()
    assert max(depth.values()) == 10 and [tree.turn[k] for k in order[1:]] == list(range(n)) and set(parents[1:]) == {0}


def test_a_shard_by_itself_counts_what_neighbours_share():
    made = shard_nodes([[1, 2], [1, 3]], [[5, 1], [5, 1]], [2, 1], [4, 3], ["e", "f"], 1, -1)
    root, one, two, three = (dict(zip(made, r)) for r in zip(*made.values()))
    assert (root["key"] is None, one["key"] is None, two["key"]) == (False, False, None)
    assert one["n_convs"] == 3 and one["saved_tokens"] == 3 * 5 + 1 and root["n_children"] == 0 and one["n_children"] == 2
    assert two["parent_key"] == three["parent_key"] == one["key"] and two["parent_conv_id"] is None


def test_query_against_the_plain_trie_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = _rows(op12_turn_trie(spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    assert got == _plain(rows) == sorted((tuple(r) for r in con.sql(ORACLE_12).fetchall()), key=str)
