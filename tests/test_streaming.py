"""T2 and T3 under replays, restarts and late repeats."""

import os
import tempfile

from pyspark.sql import functions as F

from rolodeck.streaming import rollups as S

CHUNK = "job_id long, row_number long, value string, staged_at timestamp_ntz"


def _table(df):
    return sorted(map(tuple, df.collect()))


def test_a_repeat_is_never_applied_again(spark):
    top = tempfile.mkdtemp(prefix="stream-")
    src, out = os.path.join(top, "src"), os.path.join(top, "out")

    def arrive(name, rows):
        spark.createDataFrame([(j, r, v, None) for j, r, v in rows], "job_id long, row_number long, value string, day string") \
            .selectExpr("job_id", "row_number", "value", f"CAST('{name}' AS timestamp_ntz) AS staged_at").coalesce(1).write.parquet(os.path.join(src, f"d={name}"))

    schema = spark.createDataFrame([], CHUNK).schema

    def run(checkpoint):
        S.exactly_once_chunks(spark, src + "/*", schema, out, os.path.join(top, checkpoint), files_per_trigger=1).awaitTermination()
        return _table(S.read_applied(spark, out, schema).select("job_id", "row_number", "value"))

    arrive("2024-01-01", [(1, 1, "a"), (1, 2, "b"), (1, 1, "a again")])
    assert run("c1") == [(1, 1, "a"), (1, 2, "b")]
    arrive("2024-06-01", [(1, 2, "b much later"), (1, 3, "c"), (2, 1, "d")])  # far beyond any watermark
    want = [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")]
    assert run("c1") == want and run("c1") == want
    assert run("a-new-checkpoint") == want  # everything is read again


def test_a_replayed_batch_replaces_itself(spark):
    out = tempfile.mkdtemp(prefix="stream-")
    schema = spark.createDataFrame([], CHUNK).schema
    first = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", None)], schema)
    second = spark.createDataFrame([(1, 2, "b", None), (1, 3, "c", None)], schema)
    for batch, no in ((first, 0), (second, 1), (second, 1), (first, 0)):
        S.apply_once(batch, "s", no, out)
        assert len({(r.job_id, r.row_number) for r in S.read_applied(spark, out, schema).collect()}) == S.read_applied(spark, out, schema).count()
    assert _table(S.read_applied(spark, out, schema).select("row_number")) == [(1,), (2,), (3,)]
    S.apply_once(first.limit(0), "t", 0, out)
    assert S.read_applied(spark, out, schema).count() == 3


def test_rollup_keeps_the_latest_count_through_replays_and_bases(spark):
    out = tempfile.mkdtemp(prefix="stream-")

    def batch(rows):
        return spark.createDataFrame(rows, S.ROLLUP_SCHEMA)

    assert S.read_rollup(spark, out).count() == 0
    now = {}
    for no in range(13):
        rows = [(no % 3, f"2024-01-{1 + no % 5:02}", "A", 10 * no + 1), (9, "2024-02-01", "B", no)]
        now |= {r[:3]: r[3] for r in rows}
        for _ in range(1 + no % 2):  # every second batch is written twice
            S.upsert_rollup(batch(rows), no, out, compact_every=4)
        assert {tuple(r)[:3]: r.n for r in S.read_rollup(spark, out).collect()} == now
    assert max(S._folders(spark, out, "base")) == 11 and len(S._folders(spark, out, "batch")) <= 6


def test_daily_counts_of_late_and_repeated_events(spark):
    top = tempfile.mkdtemp(prefix="stream-")
    src, out, ck = (os.path.join(top, x) for x in ("src", "out", "ck"))

    def arrive(rows):
        df = spark.createDataFrame([(i, a, 1, t, None, None) for i, a, t, _ in rows], "id long, account_id int, contact_id long, type string, payload string, x string").drop("x")
        at = spark.createDataFrame([(i, d) for i, _, _, d in rows], "id long, d string").dropDuplicates(["id"])
        df.join(at, "id").withColumn("created_at", F.col("d").cast("timestamp_ntz")).drop("d").coalesce(1).write.mode("append").parquet(src)

    def run():
        S.daily_activity_stream(spark, src, out, ck, delay="10 days", compact_every=2).awaitTermination()
        return _table(S.read_rollup(spark, out))

    arrive([(1, 0, "A", "2024-01-01 10:00"), (2, 0, "A", "2024-01-01 11:00"), (3, 1, "B", "2024-01-02 00:00")])
    assert run() == [(0, "2024-01-01", "A", 2), (1, "2024-01-02", "B", 1)]
    arrive([(2, 0, "A", "2024-01-01 11:00"), (4, 0, "A", "2024-01-01 12:00"), (5, 1, "B", "2024-01-03 00:00")])  # 2 comes again
    assert run() == [(0, "2024-01-01", "A", 3), (1, "2024-01-02", "B", 1), (1, "2024-01-03", "B", 1)]
    arrive([(6, 0, "A", "2024-03-01 00:00")])
    run()
    arrive([(7, 0, "A", "2024-01-01 13:00"), (8, 0, "A", "2024-02-28 00:00")])  # 7 is older than the watermark
    assert run() == [(0, "2024-01-01", "A", 3), (0, "2024-02-28", "A", 1), (0, "2024-03-01", "A", 1), (1, "2024-01-02", "B", 1), (1, "2024-01-03", "B", 1)]
