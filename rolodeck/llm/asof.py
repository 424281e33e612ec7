"""As-of lookups without a hot task: the latest earlier value of a key.

``last(value) OVER (PARTITION BY key ORDER BY ...)`` sends a key to one task.
Here rows are range-partitioned on (key, order), so a key with a third of all
rows is spread over partitions; a window stays within a partition, and what a
partition's rows of a key must know from the partitions before comes from a
table with a row for each partition and key that goes over its border.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolodeck.llm.staging import staged


def latest_earlier(rows: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out`` = the last non-null ``value`` of the rows of the same key before it in ``order``.

    ``order`` must be total within a key. Rows with a null key part find nothing. Send narrow rows: they are
    written once, as range boundaries are sampled anew by each run.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = F.lit(True)
    for k in key:
        known &= F.col(k).isNotNull()
    dealt = staged(rows.repartitionByRange(n, *key, *order).withColumn("_part", F.spark_partition_id()), "asof")
    before = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumn("_here", F.last(value, ignorenulls=True).over(before))
    tails = dealt.where(known).groupBy("_part", *key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_tail"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("_carried", F.last("_tail", ignorenulls=True).over(earlier)).where("_carried IS NOT NULL").drop("_tail")
    found = here.join(staged(carried, "asof-carried"), ["_part", *key], "left")
    return found.withColumn(out, F.when(known, F.coalesce("_here", "_carried"))).drop("_part", "_here", "_carried")
