"""The driver contract: entry(), queries() and oracle_sql(), checked on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and set(df.columns) >= {"account_id", "contacts", "quality", "daily"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["quality_pack", "list_combined", "page_cursors", "import_errors", "bulk_tag", "export_csv",
                                  "step_digest", "stream_daily_activity", "stable_bucket", "recent_tag_history"])
def test_query_matches_oracle(spark, duck, name):
    import sys

    sys.path.insert(0, "tools")
    from compare import digest

    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, srows)[0] == digest(rel.columns, drows)[0]


def test_opening_the_store_runs_no_job(spark):
    # the store records its schemas and input schemas are kept per file version:
    # opening the model and an input table plans queries without any Spark job
    from rolodeck.sources.fixtures import load_model, raw

    load_model(spark, SF)
    raw(spark, SF, "events")
    spark.sparkContext.setJobGroup("open-store", "open-store")
    try:
        m = load_model(spark, SF)
        raw(spark, SF, "events")
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("open-store") == []
        assert m.contacts.count() > 0
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_no_local_folder_off_local_masters():
    from types import SimpleNamespace

    from rolodeck.session import checkpoint_dir

    unset = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        checkpoint_dir(cluster)
