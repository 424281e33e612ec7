"""Distributed positions equal a plain window, also when one group dominates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rolodeck.operators.ranking import position_by_key, position_within, top_n_per_group


def _data(spark):
    # account 0 holds ~2/3 of the rows; many ties on the sort key
    return spark.range(0, 3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, 2).otherwise(0).alias("account_id"),
        (F.col("id") % 5).alias("k"),
    )


def test_positions_match_window_under_skew(spark):
    df = _data(spark)
    got = position_within(df, ["account_id"], [F.col("k").desc(), F.col("id").asc()], out="pos", num_partitions=16,
                          with_group_size="n")
    w = Window.partitionBy("account_id").orderBy(F.col("k").desc(), F.col("id").asc())
    want = df.withColumn("pos_w", F.row_number().over(w)).withColumn("n_w", F.count(F.lit(1)).over(Window.partitionBy("account_id")))
    j = got.join(want, ["id", "account_id"])
    assert j.count() == 3000
    assert j.filter((F.col("pos") != F.col("pos_w")) | (F.col("n") != F.col("n_w"))).count() == 0
    # the hot account really was spread over several partitions
    parts = df.repartitionByRange(16, "account_id", F.col("k").desc(), "id").filter(F.col("account_id") == 0) \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 4


def test_top_n_per_group(spark):
    df = _data(spark)
    top = top_n_per_group(df, ["account_id"], [F.col("id").desc()], 3, out="rank").collect()
    by = {}
    for r in top:
        by.setdefault(r.account_id, []).append((r.rank, r.id))
    acct = lambda i: 1 if i % 3 == 0 else (2 if i % 7 == 0 else 0)
    for a, rows in by.items():
        want = sorted((i for i in range(3000) if acct(i) == a), reverse=True)[:3]
        assert sorted(rows) == [(k + 1, i) for k, i in enumerate(want)]


def test_positions_hold_when_range_sampling_is_partial(spark):
    # with 2 sampled keys per partition the range boundaries differ from one
    # sampling to the next; positions must still equal row_number
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from rolodeck.operators.ranking import position_within

    old = spark.conf.get("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "2")
    try:
        # a payload column only the rows need: the count table's branch is pruned to other columns
        df = spark.range(0, 20000, 1, 8).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("k"), "id",
                                                 F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        got = position_within(df, ["g"], [F.col("k").desc(), F.col("id")], out="pos", num_partitions=16)
        want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(F.col("k").desc(), F.col("id"))))
        bad = got.join(want, ["g", "k", "id", "payload"], "full").filter(~F.col("pos").eqNullSafe(F.col("want"))).count()
        assert bad == 0 and got.count() == 20000
    finally:
        spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", old)


def test_weighted_positions_and_quantiles_of_counted_values(spark):
    import random

    from rolodeck.operators import loadstats as LS

    rng = random.Random(3)
    # a third of all rows have one value, group "c" one row, and there are nulls
    rows = [(g, 7 if rng.random() < 0.33 else rng.randrange(1, 500)) for g in "ab" for _ in range(3000)] + [("c", 5), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    names = {"p0": 0.0, "p50": 0.5, "p97": 0.975, "p100": 1.0}
    got = {r.g: (r.p0, r.p50, r.p97, r.p100) for r in LS.nearest_rank(df, ["g"], "v", names).collect()}
    for g in "abc":
        vals = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(vals[min(len(vals) - 1, int(len(vals) * p))] for p in names.values())
        assert got == {r.g: (r.p0, r.p50, r.p97, r.p100) for r in LS.nearest_rank(df.withColumn("v", F.col("v").cast("double")), ["g"], "v", names).collect()}
    counted = df.filter("v IS NOT NULL").groupBy("g", "v").count()
    ranked = position_within(counted, ["g"], [F.col("v").asc()], weight="count", with_group_size="n").collect()
    for r in ranked:
        assert r.pos == sum(1 for k, v in rows if k == r.g and v is not None and v <= r.v) and r.n == sum(1 for k, v in rows if k == r.g and v is not None)


def test_wide_rows_ranked_by_their_keys_alone(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 AS g", "hash(id) % 50 AS k", "repeat('x', 50) AS wide")
    order = [F.col("k").desc(), F.col("id").asc()]
    want = {r.id: r.pos for r in position_within(df, ["g"], order).collect()}
    got = position_by_key(df, "id", ["g"], order, ["k"])
    assert {r.id: r.pos for r in got.collect()} == want and set(got.columns) == {"id", "g", "k", "wide", "pos"}
    top = top_n_per_group(df, ["g"], order, 1200, out="pos", key="id", order_needs=["k"]).collect()
    assert {r.id: r.pos for r in top} == {i: p for i, p in want.items() if p <= 1200}


def test_step_digest_of_whole_and_of_broken_numbers(spark):
    from rolodeck.operators import loadstats as LS

    log = spark.range(4000).selectExpr("'s' || id % 2 AS scenario", "CAST(1 + id % 3 AS INT) AS clients", "CAST(CASE WHEN id % 50 = 0 THEN 500 WHEN id % 41 = 0 THEN 404 ELSE 200 END AS INT) AS status",
                                       "CASE WHEN id % 97 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id % 211 END AS latency_ms", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 60) AS started_at")
    whole = sorted(map(tuple, LS.step_digest(log).collect()))
    broken = sorted(map(tuple, LS.step_digest(log.withColumn("latency_ms", F.col("latency_ms").cast("double"))).collect()))
    assert len(whole) == 6 and whole == broken and sum(r[7] for r in whole) == 4000
