"""Connected components of a link table by alternating large and small stars.

Each round joins every node to the least node of its neighbourhood: the large
star hands larger neighbours to it, the small star the smaller ones, until
every node hangs directly on the least node of its component. The least
neighbours (grouped minima, map-side combined) are written before the links are
joined to them, so they are a side of known size: broadcast below the session's
threshold, and beyond it a join whose link side AQE splits, as no aggregate by
the same key shares its stage. A node with a third of all links is no hot task.
Stars are written to the shared folder, which cuts the lineage; what a round
wrote is dropped by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolodeck.llm.staging import Staged


def _state(links: DataFrame) -> tuple:
    # of a set of pairs, as one row: equal states are equal sets up to a 64-bit hash
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(h.cast("decimal(38,0)"))).first())


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(links: DataFrame) -> Staged:
    """(u, m): the least neighbour of each node, written."""
    return Staged(links.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(links: DataFrame, least: DataFrame) -> DataFrame:
    least = least.select("u", F.least("u", "m").alias("m"))
    return _both_ways(links).where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, least: DataFrame) -> DataFrame:
    others = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _round(links: DataFrame) -> Staged:
    least = _least(_both_ways(links))
    large = Staged(_large_star(links, least.df), "large-stars")
    least.drop()
    least = _least(large.df)
    small = Staged(_small_star(large.df, least.df), "links")
    least.drop()
    large.drop()
    return small


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``; component is the least node that links reach.

    Node columns are of any ordered type. Links may be repeated, in either direction; a link with a null end or
    from a node to itself is none. No links give an empty table.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = Staged(links, "links")
    state = _state(now.df)
    while state[0]:
        after = _round(now.df)
        now.drop()
        now, was, state = after, state, _state(after.df)
        if state == was:
            break
    stars = now.df
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
