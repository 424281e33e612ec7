"""Distributed positions within a group (row_number without a hot task).

``row_number() OVER (PARTITION BY account ORDER BY k)`` sends a whole
account to one task; with one tenant holding a third of all rows that task
is the job. Here the rows are range-partitioned on (group, order keys), so
a large group is split across many partitions by sampled boundaries. Each
row's position is then its offset inside its partition plus the number of
rows of the same group in earlier partitions, taken from a small table of
per-(partition, group) counts (at most #partitions + #groups rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolodeck.session import checkpoint_dir


def _sort_cols(partition_cols: list[str], order_cols: list[Column]) -> list[Column]:
    return [F.col(c).asc() for c in partition_cols] + list(order_cols)


def position_within(df: DataFrame, partition_cols: list[str], order_cols: list[Column],
                    out: str = "pos", num_partitions: int | None = None,
                    with_group_size: str | None = None, weight: str | None = None) -> DataFrame:
    """Adds ``out`` = 1-based position of each row inside its group under
    ``order_cols`` (which must make the order total, e.g. end with the id).

    Optionally adds ``with_group_size`` = the size of the row's group. With
    ``weight`` (a column of counts) a row stands for that many equal ones:
    ``out`` is the position of its last one, and a group's size their sum.
    """
    keys = _sort_cols(partition_cols, order_cols)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The rows and the count table below must see the same partition of every
    # row. Range boundaries come from a sample, and each branch of a plan that
    # re-runs the range exchange samples anew, so the partitioned rows are
    # checkpointed (shared checkpoint folder) and both branches read them.
    checkpoint_dir(spark)
    ordered = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        # increases by one per row inside a partition, in the sorted order
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
    )
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    stats = ordered.groupBy("_pid", *partition_cols).agg(F.min("_mid").alias("_first"), rows.alias("_cnt"))
    before = Window.partitionBy(*partition_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_offset", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if with_group_size:
        stats = stats.withColumn(with_group_size, F.sum("_cnt").over(Window.partitionBy(*partition_cols)))
    stat_cols = ["_pid", *partition_cols, "_first", "_offset"] + ([with_group_size] if with_group_size else [])
    # ``stats`` is small but its size is not proven; AQE turns this into a
    # broadcast join only after measuring it at run time.
    joined = ordered.join(stats.select(*stat_cols), ["_pid", *partition_cols])
    here = F.sum(weight).over(Window.partitionBy("_pid", *partition_cols).orderBy("_mid")) if weight else F.col("_mid") - F.col("_first") + 1
    return joined.withColumn(out, F.col("_offset") + here).drop(
        "_pid", "_mid", "_first", "_offset"
    )


def position_by_key(df: DataFrame, key: str, partition_cols: list[str], order_cols: list[Column], order_needs: list[str],
                    out: str = "pos", at_most: int | None = None) -> DataFrame:
    """``position_within`` for wide rows with a unique, non-null ``key``: only the key, the group and the columns that
    ``order_cols`` read (``order_needs``) are dealt by range, sorted and checkpointed; the rows are joined to their
    positions. ``at_most`` keeps the first so many rows of a group, before the join."""
    narrow = position_within(df.select(*dict.fromkeys([key, *partition_cols, *order_needs])), partition_cols, order_cols, out=out)
    if at_most is not None:
        narrow = narrow.filter(F.col(out) <= at_most)
    return df.join(narrow.select(key, out), key)


# Spark plans ``row_number() <= n`` with a pre-shuffle group limit only up to
# this n (spark.sql.optimizer.windowGroupLimitThreshold, default 1000).
GROUP_LIMIT_MAX = 1000


def top_n_per_group(df: DataFrame, partition_cols: list[str], order_cols: list[Column], n: int,
                    out: str = "rank", key: str | None = None, order_needs: list[str] | None = None) -> DataFrame:
    """First ``n`` rows of every group (``order_cols`` must make the order total).

    For n up to 1,000, ``row_number() <= n`` is planned with a group limit on
    both sides of the shuffle, so at most ``n`` rows per group leave each map
    task whatever the group size. Above that Spark applies no pre-shuffle
    limit and would sort a whole group in one task, so the distributed
    ranking is used instead, of the keys alone where the rows have a unique
    ``key`` and ``order_needs`` names the columns that the order reads.
    """
    if n > GROUP_LIMIT_MAX and key:
        return position_by_key(df, key, partition_cols, order_cols, order_needs or [], out=out, at_most=n)
    if n > GROUP_LIMIT_MAX:
        return position_within(df, partition_cols, order_cols, out=out).filter(F.col(out) <= n)
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
