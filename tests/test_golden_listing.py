"""Search, filters, keyset paging under heavy ties, export cells (reference golden cases)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import make_contacts, make_links, make_tags
from rolodeck.functions.csvcells import csv_line_from_array, csv_safe
from rolodeck.operators import listing as L
from rolodeck.operators import metrics as M

AS_OF = dt.datetime(2025, 12, 1)


@pytest.fixture(scope="module")
def people(spark):
    c = make_contacts(spark, [
        dict(id=1, first="Ada", last="Lovelace", email="ada@analytical.io", phone="+1 (555) 010-1234", company="Analytical Engines",
             created=dt.datetime(2025, 3, 1)),
        dict(id=2, first="Grace", last="Hopper", email="grace@navy.mil", phone="555.020.9999", company="US Navy", created=dt.datetime(2025, 6, 1)),
        dict(id=3, first="Alan", last="Turing", email="alan@bletchley.uk", company="Bletchley Park", created=dt.datetime(2025, 9, 1)),
    ])
    return c, make_tags(spark, [(1, 0, "VIP")]), make_links(spark, [(1, 1)])


def _names(df):
    return sorted(r.first_name for r in df.collect())


@pytest.mark.parametrize("q,expected", [("LACE", ["Ada"]), ("ada love", ["Ada"]), ("navy.mil", ["Grace"]),
                                        ("010-1234", ["Ada"]), ("(555) 020", ["Grace"]), ("%%", [])])
def test_search(people, q, expected):
    c, t, ct = people
    assert _names(L.list_filtered(c, t, ct, L.ListQuery(q=q), AS_OF)) == expected


def test_search_needs_two_characters(people):
    c, t, ct = people
    with pytest.raises(ValueError):
        L.list_filtered(c, t, ct, L.ListQuery(q="a"), AS_OF)


def test_filters_combine(people):
    c, t, ct = people
    assert _names(L.list_filtered(c, t, ct, L.ListQuery(company="navy"), AS_OF)) == ["Grace"]
    q = L.ListQuery(created_from=dt.datetime(2025, 5, 1), created_to=dt.datetime(2025, 7, 1))
    assert _names(L.list_filtered(c, t, ct, q, AS_OF)) == ["Grace"]
    assert _names(L.list_filtered(c, t, ct, L.ListQuery(tags=["vip", "lead"]), AS_OF)) == ["Ada"]
    assert _names(L.list_filtered(c, t, ct, L.ListQuery(tags=["vip"], company="navy"), AS_OF)) == []


def test_sort_rules(people):
    c, t, ct = people
    with pytest.raises(ValueError):
        L.ListQuery(status="deleted", sort="name").resolved_sort()
    with pytest.raises(ValueError):
        L.ListQuery(sort="deletedAt").resolved_sort()
    with pytest.raises(ValueError):
        L.ListQuery(status="deleted", attention="stale").resolved_sort()


def _walk(c, t, ct, q):
    """Follow next_cursor until the last page; return the ids page by page."""
    pages, cursor = [], None
    while True:
        page = L.keyset_page(c, t, ct, L.ListQuery(**{**q.__dict__, "cursor": cursor}), AS_OF).orderBy("pos").collect()
        pages.append([r.id for r in page])
        nxt = [r.next_cursor for r in page if r.next_cursor]
        if not nxt:
            return pages
        cursor = nxt[0]


def test_page_walk_under_heavy_ties(spark):
    lasts = ["Alpha", "Beta", "Gamma", "Delta", "Eps"]
    stamps = [dt.datetime(2025, 1, 1, 0, 0, 0, 123456), dt.datetime(2025, 1, 1, 0, 0, 0, 123457), dt.datetime(2025, 1, 2)]
    c = make_contacts(spark, [dict(id=i, first=f"P{i % 3}", last=lasts[i % 5], created=stamps[i % 3]) for i in range(55)])
    t, ct = make_tags(spark, []), make_links(spark, [])
    for sort, order in [("name", "asc"), ("createdAt", "desc"), ("createdAt", "asc")]:
        q = L.ListQuery(sort=sort, order=order, limit=10)
        pages = _walk(c, t, ct, q)
        flat = [i for p in pages for i in p]
        assert len(pages) == 6 and len(flat) == 55 and len(set(flat)) == 55
        full = [r.id for r in L.sort_contacts(c, sort, order).orderBy("pos").collect()]
        assert flat == full
        nums = {r.id: r.page for r in L.page_numbers(c, sort, order, 10).collect()}
        assert all(nums[i] == k for k, p in enumerate(pages) for i in p)


def test_trash_ties(spark):
    when = dt.datetime(2025, 2, 2, 12, 0, 0, 5)
    c = make_contacts(spark, [dict(id=i, first="T", last=str(i), created=when, deleted=when) for i in range(23)])
    pages = _walk(c, make_tags(spark, []), make_links(spark, []), L.ListQuery(status="deleted", limit=5))
    flat = [i for p in pages for i in p]
    assert len(flat) == 23 and len(set(flat)) == 23 and flat == sorted(flat, reverse=True)


def test_cursor_refused_for_other_sort():
    tok = L.encode_cursor("name", "asc", "x", 1)
    assert L.decode_cursor(tok, "name:asc") == ("x", 1)
    with pytest.raises(ValueError):
        L.decode_cursor(tok, "createdAt:desc")
    with pytest.raises(ValueError):
        L.decode_cursor("not-a-token", "name:asc")


def test_bounded_count(spark):
    df = spark.range(25)
    assert M.bounded_count(df, 10).first().asDict() == {"total": 10, "total_capped": True}
    assert M.bounded_count(df, 100).first().asDict() == {"total": 25, "total_capped": False}


@pytest.mark.parametrize("cell,expected", [
    ("=1+1", "'=1+1"), ("@SUM(A1)", "'@SUM(A1)"), ("-2+3", "'-2+3"), ("+cmd|x", "'+cmd|x"), ("\tx", "'\tx"), ("-cmd", "'-cmd"),
    ("+1 (415) 555-0172", "+1 (415) 555-0172"), ("-", "-"), ("Ada", "Ada"), ("(212) 555-0199", "(212) 555-0199"),
    ("555-0100", "555-0100"), ("", ""),
])
def test_csv_safe(spark, cell, expected):
    assert spark.createDataFrame([(cell,)], "c string").select(csv_safe(F.col("c")).alias("s")).first().s == expected


def test_csv_line(spark):
    df = spark.createDataFrame([(["a,b", 'say "hi"', "x\ny", "plain"],)], "a array<string>")
    assert df.select(csv_line_from_array("a").alias("l")).first().l == '"a,b","say ""hi""","x\ny",plain'


def test_export_lines(spark, people):
    from rolodeck.sources import csvio

    c, t, ct = people
    t2 = make_tags(spark, [(1, 0, "VIP"), (2, 0, "Lead")])
    ct2 = make_links(spark, [(1, 1), (1, 2)])
    lines = [r.line for r in csvio.export_lines(c, t2, ct2, L.ListQuery(sort="name", order="asc"), AS_OF).orderBy("pos").collect()]
    assert lines[0] == "﻿first_name,last_name,email,phone,company,tags"
    assert lines[1] == 'Grace,Hopper,grace@navy.mil,555.020.9999,US Navy,'
    assert lines[2] == 'Ada,Lovelace,ada@analytical.io,+1 (555) 010-1234,Analytical Engines,Lead;VIP'
