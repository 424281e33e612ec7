"""The bucketed contact store: joins by contact move no contact rows."""

import pytest
from conftest import SF

import __spark_entry__ as E
from rolodeck.sources.fixtures import load_model


def _exchanges(df):
    """The subtrees of the shuffles in the plan, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "Exchange" in line and "BroadcastExchange" not in line and "Reused" not in line:
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


@pytest.mark.parametrize("name", ["tags_any_of", "attention_untagged", "attention_duplicate_phone"])
def test_no_exchange_of_contacts(spark, name):
    load_model(spark, SF)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")  # of the contacts no side is broadcast
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = E.queries()[name](spark, SF)
        moved = _exchanges(df)
        assert not any("first_name" in m for m in moved), moved
        if name == "attention_untagged":
            assert not moved
        rows = df.count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert rows == E.queries()[name](spark, SF).count() > 0


def test_another_session_reads_the_same_store(spark):
    mine = load_model(spark, SF)
    other = load_model(spark.newSession(), SF)
    assert sorted(map(tuple, other.contacts.collect()), key=str) == sorted(map(tuple, mine.contacts.collect()), key=str)
    assert other.contact_tags.count() == mine.contact_tags.count() > 0
