"""Operator 5, mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of ``block`` documents. With weight
w out of W, block i (from 1) of a source is released at slot floor((i-1)W/w)
and due at slot ceil(iW/w); of the released blocks the one with the earliest
deadline is next. At every slot each source has then had its share to within
less than one block.

The schedule repeats after W slots, so one period is laid out on the driver
(W and the number of sources are bounded parameters) and the documents only
look their slot up. When a source has no block left, its weight passes to the
others and a new phase begins; every document is placed exactly once. A row's
rank within its source comes from a range partition on (source, doc_id, row),
so a source with a third of all rows is spread over many tasks.

Defined cases: a null source, and any source without a weight, is of the pool
``other``; null doc_ids come first in their source; repeated rows take places
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolodeck.llm.staging import staged

BLOCK = 32
#: Bounds of the parameters, and so of the schedule that is broadcast.
MOST_WEIGHT, MOST_SOURCES = 10_000, 100
#: Target weights of the test tables' sources; ``OTHER`` is what any other source gets.
WEIGHTS = {"src0": 10, **{f"src{k}": 4 for k in range(1, 20)}}
OTHER = 14


def period(weights: list[int]) -> list[int]:
    """The source (its index) of each of sum(weights) slots, by earliest deadline of the released blocks."""
    total = sum(weights)
    waiting = [(0, k, 1) for k in range(len(weights))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * total // weights[k]), k, i))
        _, k, i = heapq.heappop(ready)
        slots.append(k)
        if i < weights[k]:
            heapq.heappush(waiting, (i * total // weights[k], k, i + 1))
    return slots


def phases(blocks: list[int], weights: list[int]) -> list[dict]:
    """Per phase and source with blocks left: its blocks [first, last), slots of a period, and the phase's first slot."""
    done, out, base, number = [0] * len(blocks), [], 0, 0
    while live := [k for k in range(len(blocks)) if done[k] < blocks[k]]:
        shared = gcd(*[weights[k] for k in live])
        share = {k: weights[k] // shared for k in live}
        total = sum(share.values())
        own: dict[int, list[int]] = {k: [] for k in live}
        for slot, j in enumerate(period([share[k] for k in live])):
            own[live[j]].append(slot)
        # the phase ends with the last block of the source that runs out first
        length = min((blocks[k] - done[k] - 1) // share[k] * total + own[k][(blocks[k] - done[k] - 1) % share[k]] + 1 for k in live)
        for k in live:
            n = length // total * share[k] + sum(s < length % total for s in own[k])
            out.append({"pool": k, "phase": number, "first": done[k], "last": done[k] + n, "base": base, "period": total, "slots": own[k]})
            done[k] += n
        base, number = base + length, number + 1
    return out


def slot_of(plan: list[dict], pool: int, block: int) -> int:
    p = next(p for p in plan if p["pool"] == pool and p["first"] <= block < p["last"])
    turns, at = divmod(block - p["first"], len(p["slots"]))
    return p["base"] + turns * p["period"] + p["slots"][at]


def _places(rows: DataFrame, weights: dict[str, int], other: int, block: int) -> DataFrame:
    """``rows`` (source, doc_id, ...) with phase, slot and position (0, 1, ... of all rows, without gaps)."""
    spark = rows.sparkSession
    if min([*weights.values(), other]) < 1 or sum(weights.values()) + other > MOST_WEIGHT or len(weights) + 1 > MOST_SOURCES:
        raise ValueError(f"weights must be at least 1, at most {MOST_WEIGHT} together, of at most {MOST_SOURCES - 1} sources")
    names = list(weights)
    index = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)]) if names else None
    pool = F.coalesce(F.try_element_at(index, F.col("source")), F.lit(len(names))) if names else F.lit(0)
    order = ("pool", "doc_id", "row")
    # range boundaries are sampled anew by each run, so the dealt rows are written before they are read twice
    dealt = staged(
        rows.withColumn("pool", F.when(F.col("source").isNull(), F.lit(len(names))).otherwise(pool)).withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "mix",
    )
    counted = dealt.groupBy("pool", "part").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("pool").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each pool and partition that it has rows in: at most partitions + pools
    parts = staged(counted.select("pool", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_at")).alias("shift"), "n"), "mix-parts")
    totals = {r["pool"]: r["n"] for r in parts.groupBy("pool").agg(F.sum("n").alias("n")).collect()}  # at most MOST_SOURCES rows
    sizes = [totals.get(k, 0) for k in range(len(names) + 1)]
    plan = phases([-(-n // block) for n in sizes], [*weights.values(), other])
    kind = "pool int, phase int, first long, last long, base long, period long, slots array<int>"
    # the schedule is bounded by MOST_WEIGHT slots a phase and one phase a source
    schedule = F.broadcast(spark.createDataFrame([tuple(p.values()) for p in plan], kind).withColumnRenamed("pool", "of"))
    ranked = dealt.join(parts.select("pool", "part", "shift"), ["pool", "part"]).withColumn("rank", F.col("at") + F.col("shift"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block))
    placed = ranked.join(schedule, (F.col("pool") == F.col("of")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")))
    into, share = F.col("block") - F.col("first"), F.size("slots")
    placed = placed.withColumn("slot", F.col("base") + F.floor(into / share) * F.col("period") + F.get("slots", F.pmod(into, share)))
    # only a source's last block can be short: later slots begin that much earlier
    short = [(slot_of(plan, k, -(-n // block) - 1), -n % block) for k, n in enumerate(sizes) if n % block]
    missing = sum((F.when(F.col("slot") > s, F.lit(m)).otherwise(0) for s, m in short), F.lit(0).cast("long"))
    return placed.withColumn("position", F.col("slot") * block + F.pmod("rank", F.lit(block)) - missing)


def mixed(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = OTHER, block: int = BLOCK, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, phase, slot, position), a row for each row of ``docs``: where it stands in the mixture."""
    placed = _places(docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id")), weights, other, block)
    return placed.select("doc_id", "source", "phase", "slot", "position")


def in_mixed_order(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = OTHER, block: int = BLOCK, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, columns as given, in the order of the mixture over and within the partitions."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    placed = _places(docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), whole), weights, other, block)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("position", "doc").repartitionByRange(n, "position").sortWithinPartitions("position").select("doc.*")
