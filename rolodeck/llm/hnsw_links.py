"""Operator 8, embedding near-duplicates by navigable small-world graphs.

Vectors are compared within their label. Equal vectors are one node with a
count. A label's nodes are dealt over shards of at most about ``SHARD``; each
shard gets a hierarchical navigable small-world graph, and each shard's nodes
query every shard of the label by its graph, whatever the shard's size. The
beam doubles until it finds ``RECALL`` of the links of an audit: an exact scan
for a sample, up to ``AUDIT`` of the queries and as many probes, which are nodes
turned to just within the threshold, so that there are links to look for where
the queries have none. With a thousand links sought and at most 5 missed, 95 of
100 audits are right that the search of such links misses below 1.1 %; a link
between two nodes of a label is looked for from both ends. Queries whose beam
is full of links widen on their own, up to an exact scan when the beam would
look at as many nodes as the shard holds; a shard is scanned as a whole only if
no beam passes its audit. What is found is verified by cosine in double precision.
``audited`` reports each audit's beam, links sought and links found.

A task of two shards looks both ways and counts the links of both sides, so
pairs never leave it: it hands on counts per node and star links for the
components. Graphs are a few MB each and travel as one row.

Defined cases: a null label, and a vector that is null, empty, zero or has a
null or non-finite component, links with nothing; vectors of different length
have no cosine; repeated rows are vectors of their own with their id; a null
vec_id never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolodeck.llm.anchor_simhash import _stars
from rolodeck.llm.components import connected_components
from rolodeck.llm.staging import staged

COSINE = 0.98
SHARD = 1 << 16
#: Neighbours a node keeps above the ground level (twice as many there), beam while building.
DEGREE, BUILD_BEAM = 12, 32
#: First beam of a query; queries handled at once; queries, and probes, of an audit; one query in how many it takes at most; share of its links that must be found.
BEAM, BATCH, AUDIT, SHARE, RECALL = 32, 256, 1_024, 16, 0.995
#: Expansions per query and step.
STEP = 3
#: What single precision may lose of a cosine before it is verified.
SLACK = 1e-4


def _dots(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """(b, e): each row's e vectors with the row's own."""
    return (many @ one[:, :, None])[:, :, 0]


def _select(vectors: np.ndarray, centers: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """For each center the up to ``most`` of its candidates (-1: none) that are nearer to it than to one chosen before, nearest first."""
    valid = ids >= 0
    v = vectors[np.maximum(ids, 0)]
    sims = np.where(valid, _dots(v, centers), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims, v = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    among = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), int)
    for c in range(ids.shape[1]):
        covered = ((among[:, c, :c] > sims[:, c, None]) & chosen[:, :c]).any(1)
        chosen[:, c] = (ids[:, c] >= 0) & ~covered & (count < most)
        count += chosen[:, c]
    # what room is left goes to the nearest of the others
    spare = (ids >= 0) & ~chosen
    fill = spare & (np.cumsum(spare, 1) <= (most - count)[:, None])
    taken = chosen | fill
    first = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(taken, first, 1), np.take_along_axis(ids, first, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the nodes (-1: none) and similarities of its beam, from the entry nodes (b, e), best first."""
    b = len(queries)
    ids = np.full((b, beam), -1)
    sims = np.full((b, beam), -np.inf, np.float32)
    e = entries.shape[1]
    width = min(e, beam)
    ids[:, :width] = entries[:, :width]
    sims[:, :width] = np.where(ids[:, :width] >= 0, _dots(vectors[np.maximum(entries[:, :width], 0)], queries), -np.inf)
    expanded = ids < 0
    seen = np.zeros((b, len(vectors) + 1), bool)
    seen[np.arange(b)[:, None], entries] = True
    active = np.arange(b)
    while len(active):
        waiting = np.where(expanded[active], -np.inf, sims[active])
        k = min(STEP, beam)
        best = np.argpartition(-waiting, k - 1, axis=1)[:, :k] if beam > k else np.tile(np.arange(beam), (len(active), 1))
        real = np.take_along_axis(waiting, best, 1) > -np.inf
        going = real.any(1)
        active, best, real = active[going], best[going], real[going]
        if not len(active):
            break
        rows = active[:, None]
        nodes = np.where(real, ids[rows, best], -1)
        expanded[rows, best] = True
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows, near]] = -1
        seen[rows, near] = True
        seen[:, -1] = False  # -1 stands for none
        got = np.where(near >= 0, _dots(vectors[near], queries[active]), -np.inf)
        all_ids, all_sims = np.concatenate((ids[active], near), 1), np.concatenate((sims[active], got), 1)
        all_done = np.concatenate((expanded[active], near < 0), 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], expanded[active] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


class Graph:
    """A small-world graph over unit vectors; links[level] is (n, degree), -1 where there is none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 42) -> tuple[Graph, np.ndarray]:
        """The graph, and the order in which it holds the vectors (higher levels first)."""
        n = len(vectors)
        heights = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
        order = np.argsort(-heights, kind="stable")
        vectors, heights = np.ascontiguousarray(vectors[order]), heights[order]
        graph = cls(vectors, [np.full((n, DEGREE * (2 if level == 0 else 1)), -1) for level in range(heights[0] + 1 if n else 1)])
        done = min(n, 1)
        while done < n:
            stop = min(n, done + min(done, BATCH))
            graph._insert(done, stop, heights)
            done = stop
        return graph, order

    def _insert(self, first: int, stop: int, heights: np.ndarray) -> None:
        new = np.arange(first, stop)
        entries = np.zeros((len(new), 1), int)
        for level in range(len(self.links) - 1, -1, -1):
            joins = heights[new] >= level
            links = self.links[level]
            if not joins.all():  # those of lower levels only descend
                entries[~joins, :1] = _search(self.vectors, links, self.vectors[new[~joins]], entries[~joins][:, :1], 1)[0]
            if not joins.any():
                continue
            own = new[joins]
            ids, _ = _search(self.vectors, links, self.vectors[own], entries[joins], BUILD_BEAM)
            if entries.shape[1] < BUILD_BEAM:
                entries = np.pad(entries, ((0, 0), (0, BUILD_BEAM - entries.shape[1])), constant_values=-1)
            entries[joins] = ids
            among = self.vectors[own] @ self.vectors[own].T  # of those that come together, the ones before
            among[np.triu_indices(len(own))] = -np.inf
            k = min(DEGREE, len(own))
            peers = np.argpartition(-among, k - 1, axis=1)[:, :k]
            peers = np.where(np.isfinite(np.take_along_axis(among, peers, 1)), own[peers], -1)
            links[own] = _select(self.vectors, self.vectors[own], np.concatenate((ids, peers), 1), links.shape[1])
            self._back(level, own)

    def _back(self, level: int, own: np.ndarray) -> None:
        """Links back to the new nodes; a node with too many chooses anew."""
        links = self.links[level]
        to, new = links[own].ravel(), np.repeat(own, links.shape[1])
        to, new = to[to >= 0], new[to >= 0]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, begin, count = np.unique(to, return_index=True, return_counts=True)
        for at in range(0, len(nodes), BATCH):
            some, many = nodes[at : at + BATCH], count[at : at + BATCH]
            extra = np.full((len(some), many.max()), -1)
            row = np.repeat(np.arange(len(some)), many)
            extra[row, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] = new[begin[at] : begin[at] + many.sum()]
            both = np.concatenate((links[some], extra), 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            links[some] = _select(self.vectors, self.vectors[some], both, links.shape[1])

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.zeros((len(queries), 1), int)
        for links in self.links[:0:-1]:
            entries = _search(self.vectors, links, queries, entries, 1)[0]
        return _search(self.vectors, self.links[0], queries, entries, beam)

    def _probes(self, least: float) -> np.ndarray:
        """Up to ``AUDIT`` nodes, each turned to the angle at which it still links, into a direction of its own."""
        rng = np.random.default_rng(11)
        nodes = self.vectors[rng.permutation(len(self.vectors))[:AUDIT]].astype(np.float64)
        aside = rng.normal(size=nodes.shape)
        aside -= (aside * nodes).sum(1, keepdims=True) * nodes
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        least = min(1.0, least)
        turned = least * nodes + np.sqrt(1 - least * least) * aside / np.maximum(length, 1e-9)
        return np.where(length > 1e-9, turned, nodes).astype(np.float32)  # one dimension has no other direction

    def within(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the pairs found with at least that similarity; ``audit`` is then (beam, links sought, links found), beam 0: scanned."""
        n, size = len(queries), len(self.vectors)
        asked, found = [np.empty(0, int)], [np.empty(0, int)]

        def keep(of, rows, nodes):
            asked.append(of[rows])
            found.append(nodes)

        def scanned(of):
            for at in range(0, len(of), BATCH):
                keep(of[at : at + BATCH], *np.nonzero(queries[of[at : at + BATCH]] @ self.vectors.T >= least))

        def wide(beam):  # it would look at as many nodes as there are
            return 2 * DEGREE * beam >= size

        if not size or not n:
            self.audit = (BEAM, 0, 0)
            return asked[0], found[0]
        order = np.random.default_rng(7).permutation(n)
        sample = np.concatenate((self._probes(least + SLACK), queries[order[: min(AUDIT, -(-n // SHARE))]]))
        parts = [sample[at : at + BATCH] for at in range(0, len(sample), BATCH)]
        truth = [(part @ self.vectors.T >= least).sum(1) for part in parts]
        beam = BEAM
        while True:
            # a query with more links than the beam holds widens on its own below
            pairs = [(np.minimum(true, beam), (self.search(part, beam)[1] >= least).sum(1)) for part, true in zip(parts, truth)]
            sought, got = (int(sum(x)) for x in zip(*[(true.sum(), np.minimum(near, true).sum()) for true, near in pairs]))
            self.audit = (beam, sought, got)
            if got >= RECALL * sought:
                break
            beam *= 2
            if wide(beam):  # no beam passes: all of the shard
                self.audit = (0, sought, sought)
                scanned(order)
                return np.concatenate(asked), np.concatenate(found)
        for at in range(0, n, BATCH):
            open_, width = order[at : at + BATCH], beam
            while len(open_):
                ids, sims = self.search(queries[open_], width)
                near = sims >= least
                full = near.all(1) & (width < size)
                rows, slots = np.nonzero(near & ~full[:, None])
                keep(open_, rows, ids[rows, slots])
                open_, width = open_[full], 2 * width
                if wide(width):  # what links with more than a beam
                    scanned(open_)
                    break
        return np.concatenate(asked), np.concatenate(found)


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _built(group: pd.DataFrame) -> pd.DataFrame:
    """One row: the shard's vectors in graph order, their nodes and counts, and the links."""
    given = np.stack(group["embedding"].to_numpy())
    exact = given.astype(np.float64)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    graph, order = Graph.build(unit.astype(np.float32))
    levels = {f"links{k}": x.astype(np.int32) for k, x in enumerate(graph.links)}
    data = _packed(nodes=group["node"].to_numpy()[order], copies=group["copies"].to_numpy()[order], exact=given[order], **levels)
    return pd.DataFrame({"label": group["label"].iloc[:1], "dim": group["dim"].iloc[:1], "shard": group["shard"].iloc[:1], "shards": group["shards"].iloc[:1], "graph": [data]})


class _Shard:
    def __init__(self, data: bytes):
        got = np.load(io.BytesIO(data))
        self.nodes, self.copies = got["nodes"], got["copies"]
        self.exact = got["exact"].astype(np.float64)
        self.norms = np.sqrt((self.exact * self.exact).sum(1))
        unit = (self.exact / self.norms[:, None]).astype(np.float32)
        self.graph = Graph(unit, [got[f"links{k}"].astype(int) for k in range(sum(k.startswith("links") for k in got.files))])


def _verified(one: _Shard, two: _Shard, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        out[at : at + len(i)] = np.einsum("nd,nd->n", one.exact[i], two.exact[j]) / (one.norms[i] * two.norms[j]) >= least
    return out


_LINKED = "a long, b long, n long, audit struct<low: int, high: int, beam: int, sought: long, found: long>"


def _matched(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of two shards (or one with itself): (a, null, n) links of node a, (a, b, null) star links, and a row with only an audit per search."""
    shards = [_Shard(g) for g in group.sort_values("shard")["graph"]]
    one, two = shards[0], shards[-1]
    low, high = int(group["shard"].min()), int(group["shard"].max())
    a, b = two.graph.within(one.graph.vectors, least - SLACK)
    audits = [(low, high, *two.graph.audit)]
    if one is two:
        a, b = np.minimum(a, b), np.maximum(a, b)
        a, b = a[a != b], b[a != b]
    else:
        d, c = one.graph.within(two.graph.vectors, least - SLACK)
        audits.append((high, low, *one.graph.audit))
        a, b = np.concatenate((a, c)), np.concatenate((b, d))
    pairs = np.unique(a * len(two.nodes) + b)
    a, b = np.divmod(pairs, len(two.nodes))
    good = _verified(one, two, a, b, least)
    a, b = a[good], b[good]
    nodes = np.concatenate((one.nodes[a], two.nodes[b]))
    linked, where = np.unique(nodes, return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate((two.copies[b], one.copies[a])), minlength=len(linked)).astype(np.int64)
    u, v = _stars(one.nodes[a], two.nodes[b])
    nothing = [None] * len(audits)
    return pd.DataFrame({
        "a": pd.array([*linked, *u, *nothing], "Int64"), "b": pd.array([None] * len(linked) + [*v, *nothing], "Int64"),
        "n": pd.array([*counts, *[None] * len(u), *nothing], "Int64"),
        "audit": [None] * (len(linked) + len(u)) + [dict(zip(("low", "high", "beam", "sought", "found"), x)) for x in audits],
    })


def _nodes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their number and whether they can link, and the nodes of those that can."""
    e = F.col("embedding")
    finite = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = staged(
        vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
        .withColumn("usable", F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "vectors",
    )
    usable = rows.where("usable").withColumn("dim", F.size("embedding"))
    # equal vectors of a label are one node, named by its first row
    return rows, staged(usable.groupBy("label", "dim", "embedding").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "vector-nodes")


def _found(nodes: DataFrame, least: float, shard: int) -> DataFrame:
    """What each two shards of a label find in each other (``_matched``), with the label."""
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = nodes.drop("least").join(staged(sizes, "label-sizes"), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    of = f"label {dict(nodes.dtypes)['label']}, dim int"
    graphs = staged(dealt.groupBy("label", "dim", "shard", "shards").applyInPandas(_built, f"{of}, shard int, shards int, graph binary"), "graphs")
    meets = graphs.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    meets = meets.groupBy("label", "dim", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"))
    return staged(meets.applyInPandas(lambda g: _matched(g, least).assign(label=g["label"].iloc[0], dim=g["dim"].iloc[0]), f"{of}, {_LINKED}"), "vector-links")


def audited(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(label, dim, low, high, beam, sought, found): for each shard (high) that a shard (low) was looked up in, the beam
    that passed the audit (0: none, so it was scanned), the links that the audit sought and those of them that were found."""
    return _found(_nodes(vectors, vec_id, embedding, label)[1], least, shard).where("audit IS NOT NULL").select("label", "dim", "audit.*")


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``."""
    rows, nodes = _nodes(vectors, vec_id, embedding, label)
    usable = rows.where("usable")
    found = _found(nodes, least, shard)
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    member = nodes.select("node", "copies", "least", "label", "dim", "embedding").join(counts, "node", "left").join(parts, "node", "left")
    member = staged(member.withColumn("component", F.coalesce("component", "node")), "vector-members")
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    known = member.join(named, "component").select("label", "dim", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = usable.withColumn("dim", F.size("embedding")).join(known, ["label", "dim", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
