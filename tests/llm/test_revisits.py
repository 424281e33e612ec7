"""Operator 10 against a walk over the records in order, and its defined cases."""

import random

from pyspark.sql import functions as F

from rolodeck.llm import revisits as R

SCHEMA = "record_id string, kind string, url string, time long, headers map<string,string>, payload string"


def resolved(spark, rows):
    return {r["record_id"]: r for r in R.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_canonical_urls(spark):
    urls = ["HTTP://A.org:80/x/?b=2&a=1&utm_source=q#f", "https://a.org/x?a=1&b=2", "http://a.org", "http://a.org/", "http://a.org?PHPSESSID=3", None, "nothing", "http://a.org:8080/x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(R.canonical_url(F.col("u")))
    assert [r[0] for r in df.collect()] == ["a.org/x?a=1&b=2", "a.org/x?a=1&b=2", "a.org", "a.org", "a.org", None, None, "a.org:8080/x"]


def test_outcomes(spark):
    u = "http://a.org/x"
    got = resolved(spark, [
        ("r1", "response", u, 10, {"ETag": '"1"', "Content-Type": "text/html", "Date": "d1"}, "body 1"),
        ("r2", "response", u + "#f", 20, {"etag": '"2"', "Last-Modified": "m2"}, "body 2"),
        ("before", "revisit", u, 5, {"etag": '"1"'}, None),
        ("same-time", "revisit", u, 10, {"etag": '"1"'}, None),
        ("weak", "revisit", "https://A.org/x/", 15, {"ETAG": 'W/"1"', "Date": "d2", "Content-Length": "0", "X-Other": "o"}, None),
        ("changed", "revisit", u, 25, {"etag": '"1"'}, None),
        ("by-date", "revisit", u, 25, {"last-modified": "m2"}, None),
        ("nothing", "revisit", u, 25, None, "ignored"),
        ("no-url", "revisit", None, 25, {"etag": '"2"'}, None),
        ("no-time", "revisit", u, None, {"etag": '"2"'}, None),
        ("meta", "metadata", u, 11, {"A": "1", "a": "2"}, "m"),
    ])
    assert {k: r["outcome"] for k, r in got.items()} == {
        "r1": "full", "r2": "full", "before": "no_earlier_response", "same-time": "no_earlier_response", "weak": "resolved", "changed": "validator_mismatch", "by-date": "resolved",
        "nothing": "no_validator", "no-url": "no_earlier_response", "no-time": "no_earlier_response", "meta": "full",
    }
    assert got["weak"]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "date": "d2"}
    assert (got["weak"]["refers_to"], got["weak"]["payload"]) == ("r1", "body 1")
    assert (got["by-date"]["refers_to"], got["by-date"]["payload"]) == ("r2", "body 2")
    assert got["changed"]["refers_to"] is None and got["changed"]["payload"] is None and got["nothing"]["headers"] == {}
    assert got["meta"]["headers"] == {"a": "2"} and got["r1"]["payload"] == "body 1"


def test_a_hot_url_and_many_others(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        u = "http://hot.org/" if i % 3 == 0 else f"http://h{rng.randrange(40)}.org/"
        kind = "response" if rng.random() < 0.15 else "revisit"
        rows.append((f"x{i:04}", kind, u, rng.randrange(300), {"etag": str(rng.randrange(2))}, f"b{i}" if kind == "response" else None))
    got = resolved(spark, rows)
    assert len(got) == len(rows)
    for rid, kind, u, t, h, _ in rows:
        if kind == "revisit":
            earlier = max(((r[3], r[0], r) for r in rows if r[1] == "response" and r[2] == u and r[3] < t), default=None)
            want = "no_earlier_response" if not earlier else "resolved" if earlier[2][4] == h else "validator_mismatch"
            assert got[rid]["outcome"] == want
            if want == "resolved":
                assert got[rid]["payload"] == earlier[2][5]


def test_empty(spark):
    assert resolved(spark, []) == {}
