"""Operator 8 against all pairs, in one shard and in several."""

import duckdb
import numpy as np
import pytest

from rolodeck.llm import hnsw_links as H
from rolodeck.llm.op8_queries import ORACLE_8, op8_hnsw_links

SF01 = "/root/testdata/sf0.01"

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, least=0.98):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, front = {i}, [i]
        while front:
            for j in links[front.pop()] - seen:
                seen.add(j)
                front.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), least_id, rows[i][0] is not None and rows[i][0] == least_id))
    return sorted(map(str, out))


def vectors(seed, n, dim=16, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    out = [b + rng.normal(size=dim) * rng.choice([0, 0.03, 0.08, 0.4]) for b in base[rng.integers(0, len(base), n)]]
    return [(int(i), [float(np.float32(x)) for x in v], int(i % labels)) for i, v in enumerate(out)]


ODD = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] + [1.0] * 15, 0), (9004, [None] + [1.0] * 15, 0), (9005, [float("inf")] + [1.0] * 15, 0), (9006, [], 0),
       (9007, [1.0] * 16, None), (9008, [1.0] * 16, 0), (9008, [1.0] * 16, 0), (None, [1.0] * 16, 0), (9009, [1.0] * 8, 0), (9010, [2.0] * 16, 0), (9011, [2.0] * 16, 1), (None, [3.0, -1.0] * 8, 1)]


@pytest.mark.parametrize("shard", [1 << 16, 60])
def test_links_and_components(spark, shard):
    rows = vectors(1, 500) + ODD
    got = H.embedding_links(spark.createDataFrame(rows, SCHEMA), shard=shard)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows)


def test_recall_of_a_graph():
    # large enough that the beams, not the exact scan, answer
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1500, 32))
    v = np.concatenate((base, base + rng.normal(size=base.shape) * 0.02, base[:1] + rng.normal(size=(600, 32)) * 0.01)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph, order = H.Graph.build(v)
    assert sorted(order) == list(range(len(v))) and np.array_equal(graph.vectors, v[order])
    a, b = graph.within(graph.vectors, 0.98)
    want = set(zip(*np.nonzero(graph.vectors @ graph.vectors.T >= 0.98)))
    got = set(zip(a.tolist(), b.tolist()))
    assert got <= {(int(x), int(y)) for x, y in want} and len(got) > 0.99 * len(want)
    near = np.argsort(-(graph.vectors[:200] @ graph.vectors.T), axis=1)[:, :10]
    ids, _ = graph.search(graph.vectors[:200], 64)
    assert np.mean([len(set(x) & set(y)) / 10 for x, y in zip(near.tolist(), ids[:, :10].tolist())]) > 0.9


def test_rare_links_are_not_passed_unseen():
    rng = np.random.default_rng(3)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph, _ = H.Graph.build(unit(rng.normal(size=(3000, 24))))
    for links in graph.links:
        links[:] = -1  # a graph that finds nothing
    queries = unit(rng.normal(size=(512, 24)))
    queries[[5, 300]] = graph.vectors[[2000, 2500]]
    asked, found = graph.within(queries, 0.99)
    assert sorted(zip(asked.tolist(), found.tolist())) == [(5, 2000), (300, 2500)]
    assert graph.audit[0] == 0  # no beam passed
    asked, found = graph.within(graph.vectors, 0.99)
    assert len(asked) == 3000 and (np.sort(asked) == np.arange(3000)).all()


@pytest.mark.parametrize("n", [40, 700, 3000])
def test_the_graph_answers_at_every_size(n, monkeypatch):
    rng = np.random.default_rng(n)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    base = unit(rng.normal(size=(n // 2, 32)))
    graph, _ = H.Graph.build(unit(np.concatenate((base, base + rng.normal(size=base.shape) * 0.01))))
    searched, search = [], H.Graph.search
    monkeypatch.setattr(H.Graph, "search", lambda self, queries, beam: searched.append(len(queries)) or search(self, queries, beam))
    asked, found = graph.within(graph.vectors, 0.98)
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero(graph.vectors @ graph.vectors.T >= 0.98))}
    got = set(zip(asked.tolist(), found.tolist()))
    beam, sought, hit = graph.audit
    assert beam and hit >= H.RECALL * sought and sought >= min(n, H.AUDIT)
    assert sum(searched) >= n + min(n, H.AUDIT)  # each node asks the graph, and so does each probe
    assert len(want) >= 2 * n - 2 and got <= want and len(got) >= 0.99 * len(want)


def test_more_links_than_a_beam_holds():
    rng = np.random.default_rng(5)
    v = np.concatenate((np.ones((400, 16)) + rng.normal(size=(400, 16)) * 0.01, rng.normal(size=(800, 16))))
    graph, _ = H.Graph.build((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32))
    asked, found = graph.within(graph.vectors, 0.98)
    assert sorted(zip(asked.tolist(), found.tolist())) == sorted(map(tuple, np.argwhere(graph.vectors @ graph.vectors.T >= 0.98).tolist()))


def test_query_against_its_sql_on_all_vectors_and_copies_beside_them(spark, tmp_path):
    # the table holds no link of its own, so each vector gets a copy turned by a few degrees, and some a second one
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(1)
    beside = lambda v, by: [float(np.float32(x)) for x in np.array(v) + rng.normal(size=len(v)) * by * np.linalg.norm(v) / np.sqrt(len(v))]
    good = [(i, v, lab) for i, v, lab in rows if v]
    rows += [(i + 1_000_000, beside(v, 0.1), lab) for i, v, lab in good] + [(i + 2_000_000, beside(v, 0.15), lab) for i, v, lab in good[::3]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in op8_hnsw_links(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(got) == sorted(con.execute(ORACLE_8).fetchall())
    assert sum(n for _, n, _, _ in got) > len(good)
    audits = H.audited(spark.read.parquet(str(tmp_path / "embeddings.parquet")), shard=100).collect()
    assert all(a.beam and a.found >= H.RECALL * a.sought > 0 for a in audits) and {a.high for a in audits} == {0, 1}


def test_empty(spark):
    assert H.embedding_links(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in H.embedding_links(spark.createDataFrame([(4, None, 1)], SCHEMA)).collect()] == [(4, 0, 4, True)]
