"""The reference's hand-computed metrics dataset (7 active + 1 trashed)."""

import datetime as dt

import pytest

from conftest import make_contacts, make_links, make_tags
from rolodeck.operators import metrics as M
from rolodeck.operators import predicates as P

NOW = dt.datetime(2024, 6, 15, 10, 0, 0)


def ago(days):
    return NOW - dt.timedelta(days=days)


@pytest.fixture(scope="module")
def data(spark):
    c = make_contacts(spark, [
        dict(id=1, first="A1", last="Full", email="a1@x.io", phone="+1 415 555 0001", company="Acme", created=ago(2)),
        dict(id=2, first="A2", last="Email", email="a2@x.io", company="Edited Co", created=ago(5), updated=NOW, version=2),
        dict(id=3, first="A3", last="Stale", phone="+1 415 555 0003", created=ago(40), updated=ago(120)),
        dict(id=4, first="A4", last="Nothing", company="Ghost Co", created=ago(10)),
        dict(id=5, first="A5", last="DupOne", email="a5@x.io", phone="555-010-1234", created=ago(3)),
        dict(id=6, first="A6", last="DupTwo", phone="(555) 010-1234", created=ago(3)),
        dict(id=7, first="A7", last="Restored", email="a7@x.io", created=ago(1), version=3),
        dict(id=8, first="T1", last="Trashed", email="t1@x.io", created=ago(1), deleted=NOW, version=2),
    ])
    t = make_tags(spark, [(1, 0, "VIP"), (2, 0, "Lead")])
    ct = make_links(spark, [(1, 1), (5, 1), (2, 2)])
    act = spark.createDataFrame([
        (1, 0, 1, "TAG_ADDED", "{}", NOW), (2, 0, 5, "TAG_ADDED", "{}", NOW), (3, 0, 2, "TAG_ADDED", "{}", NOW),
        (4, 0, 2, "CONTACT_UPDATED", "{}", NOW), (5, 0, 8, "CONTACT_DELETED", "{}", NOW),
        (6, 0, 7, "CONTACT_DELETED", "{}", NOW), (7, 0, 7, "CONTACT_RESTORED", "{}", NOW),
    ], "id long, account_id int, contact_id long, type string, payload string, created_at timestamp_ntz")
    jobs = spark.createDataFrame([
        (1, 0, "completed", 100, 5, 80, 10, 5, NOW), (2, 0, "failed", 0, 0, 0, 0, 0, NOW),
        (3, 1, "failed", 0, 0, 0, 0, 0, NOW),  # account 1 has nothing else: the "empty tenant"
    ], "id long, account_id int, status string, total_rows int, error_rows int, created_count int, updated_count int, "
       "unchanged_count int, created_at timestamp_ntz")
    return c, t, ct, act, jobs


def test_metrics_document_range_30(data):
    c, t, ct, act, jobs = data
    doc = {r.account_id: r for r in M.metrics_document(c, t, ct, act, jobs, NOW, 30).collect()}
    m = doc[0]
    assert m.contacts.asDict() == dict(active=7, newInRange=6, newPrevRange=1, changePct=500.0, inTrash=1)
    q = m.quality.asDict()
    assert (q["withEmail"], q["withPhone"], q["withCompany"], q["noContactInfo"], q["reachable"]) == (4, 4, 3, 1, 6)
    assert (q["untagged"], q["stale"], q["staleDays"], q["duplicatePhoneContacts"], q["duplicatePhoneGroups"]) == (4, 1, 90, 2, 1)
    assert [(x.name, x["count"]) for x in m.tags] == [("VIP", 2), ("Lead", 1)]
    assert m.trash.asDict() == dict(current=1, deletedInRange=2, restoredInRange=1)
    assert m.imports.asDict() == dict(jobs=2, completed=1, failed=1, rowsCreated=80, rowsUpdated=10, rowsRejected=5,
                                      rowsSubmitted=100, acceptRate=95.0)
    types = {x.type: x["count"] for x in m.activity}
    assert types == {"TAG_ADDED": 3, "CONTACT_UPDATED": 1, "CONTACT_DELETED": 2, "CONTACT_RESTORED": 1}
    assert len(m.daily) == 30


def test_empty_tenant_is_zeros_and_nulls(data):
    c, t, ct, act, jobs = data
    doc = {r.account_id: r for r in M.metrics_document(c, t, ct, act, jobs, NOW, 30).collect()}
    e = doc[1]
    assert e.contacts.asDict() == dict(active=0, newInRange=0, newPrevRange=0, changePct=None, inTrash=0)
    assert e.quality.reachable == 0 and e.quality.duplicatePhoneContacts == 0
    assert e.tags == [] and e.imports.acceptRate is None and e.imports.jobs == 1
    assert all(d.created == 0 and d.edits == 0 for d in e.daily)


def test_range_7_daily_series(data):
    c, t, ct, act, jobs = data
    m = {r.account_id: r for r in M.metrics_document(c, t, ct, act, jobs, NOW, 7).collect()}[0]
    assert m.contacts.newInRange == 5 and m.contacts.active == 7
    days = {d.date: d for d in m.daily}
    assert len(m.daily) == 7 and m.daily[-1].date == NOW.strftime("%Y-%m-%d")
    key = lambda n: ago(n).strftime("%Y-%m-%d")
    assert days[key(2)].created == 1 and days[key(3)].created == 2 and days[key(1)].created == 1 and days[key(4)].created == 0
    assert days[NOW.strftime("%Y-%m-%d")].edits == 1


def test_attention_lists_equal_counts(data):
    c, t, ct, act, jobs = data
    names = lambda df: sorted(r.first_name for r in df.collect())
    assert names(P.attention(c, ct, "no_contact_info", NOW)) == ["A4"]
    assert names(P.attention(c, ct, "untagged", NOW)) == ["A3", "A4", "A6", "A7"]
    assert names(P.attention(c, ct, "stale", NOW)) == ["A3"]
    assert names(P.attention(c, ct, "duplicate_phone", NOW)) == ["A5", "A6"]
    counts = {(r.account_id, r.filter): r.n for r in M.attention_counts(c, ct, NOW).collect()}
    assert counts == {(0, "no_contact_info"): 1, (0, "untagged"): 4, (0, "stale"): 1, (0, "duplicate_phone"): 2}


def test_trashed_never_counts_as_duplicate(spark):
    c = make_contacts(spark, [dict(id=1, first="Live", last="One", phone="555-010-9999", created=NOW),
                              dict(id=2, first="Gone", last="Two", phone="555-010-9999", created=NOW, deleted=NOW)])
    assert P.duplicate_phone(c).count() == 0
    assert M.duplicate_phone_groups(c).count() == 0


def test_js_rounding_halves_up(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-0.0625,), (0.0625,), (0.0624,)], "x double")
    assert [r.p for r in df.select(M.round1(F.col("x")).alias("p")).collect()] == [-6.2, 6.3, 6.2]
