"""Operator 1: rules, edges from markup, and components against a walk by hand."""

import random

from pyspark.sql import functions as F

from rolodeck.llm import url_redirects as U

SCHEMA = "page_id long, url string, html string"


def verdicts(spark, pages, edges=()):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(pages)], SCHEMA)
    links = spark.createDataFrame(list(edges), "a string, b string")
    return [tuple(r)[1:] for r in sorted(U.judged(df, links).collect())]


def test_rules(spark):
    urls = ["http://a.example.com/en/1", "HTTPS://WWW.Example.COM/en/1?x#y", "http://example.com/de/", "http://x.net/es/", "http://x.net/es", "http://x.org/fr/", "http://notexample.com/en/", "http://com/", "http://a.com", None, "nothing", "", "://x.net/fr/1", "a://u@H:80/p#://z.net/es/"]
    assert verdicts(spark, urls) == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/de/", "com/", "allow"),
        ("x.net", "/es/", "net/es/", "block"), ("x.net", "/es", None, "allow"), ("x.org", "/fr/", None, "allow"), ("notexample.com", "/en/", "com/", "allow"), ("com", "/", "com/", "allow"),
        ("a.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.net", "/fr/1", "net/fr/", "block"), ("u@h:80", "/p", None, "allow"),
    ]


def test_blocks_reach_aliases_but_not_what_is_allowed(spark):
    blocked, allowed = "http://z.net/es/1", "http://z.com/1"
    pages = ["http://a.org/1", "http://b.org/1", "http://c.org/1#top", "http://d.org/1", "http://e.org/1", allowed, "http://f.org/1"]
    edges = [("http://a.org/1", "http://b.org/1#x"), ("HTTP://B.org/1", blocked), ("http://c.org/1", "http://a.org/1"),  # a chain to a block that is no page
             ("http://d.org/1", blocked.replace("1", "2")), ("http://e.org/1", allowed), ("http://e.org/1", "http://z.net/fr/9")]
    got = verdicts(spark, pages, edges)
    assert [v[-1] for v in got] == ["block", "block", "block", "block", "allow", "allow", "allow"]
    assert got[0][2] is None


def test_random_components(spark):
    rng = random.Random(6)
    urls = [f"http://h{i}.{'net/es/' if i % 9 == 0 else 'com/' if i % 11 == 0 else 'org/'}{i}" for i in range(120)]
    edges = [tuple(rng.sample(urls, 2)) for _ in range(70)]
    group = {u: {u} for u in urls}
    for a, b in edges:
        joined = group[a] | group[b]
        for u in joined:
            group[u] = joined

    def rule(u):
        return "block" if ".net/es/" in u else "allow" if ".com/" in u else None

    def want(u):
        said = {rule(x) for x in group[u]}
        return rule(u) or ("allow" if "allow" in said else "block" if "block" in said else "allow")

    assert [v[-1] for v in verdicts(spark, urls, edges)] == [want(u) for u in urls]


def test_edges_from_markup(spark):
    rows = [
        (1, "http://a.org/x/y?q=1", '<head><LINK href="/c" rel="canonical"><link rel=stylesheet href=/s>'), (2, "http://b.org/x/y", "<link rel='canonical' href='z'>"),
        (3, "http://c.org", '<meta http-equiv="refresh" content="0; url=//d.org/e&amp;f">'), (4, "http://e.org/", '<!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="http://F.org/G#h">'),
        (5, None, '<link rel="canonical" href="/c">'), (6, "http://g.org/", '<link rel="canonical" href="http://g.org/#me"> <p>canonical'), (7, "http://h.org/", None),
        (8, "http://i.org/a", '<link rel="canonical" href="mailto:x">'),
    ]
    got = U.page_edges(spark.createDataFrame(rows, SCHEMA)).select(U.key_of(F.col("a")).alias("a"), U.key_of(F.col("b")).alias("b")).where("a <> b").collect()
    assert sorted(map(tuple, got)) == [("http://a.org/x/y?q=1", "http://a.org/c"), ("http://b.org/x/y", "http://b.org/x/z"), ("http://c.org", "http://d.org/e&f"), ("http://e.org/", "http://f.org/G")]


def test_empty_and_repeated(spark):
    assert verdicts(spark, ["http://x.net/es/"] * 3) == [("x.net", "/es/", "net/es/", "block")] * 3
    none = spark.createDataFrame([], SCHEMA)
    assert U.judged(none, U.page_edges(none)).collect() == []
