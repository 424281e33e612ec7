"""Operator 1, URL filters with redirect equivalence.

Rules name a host with its subdomains and a path prefix; the longest that fits
decides. Redirects and canonical links make URLs aliases of one another: the
connected components of those edges carry a block to every alias that no rule
names. An explicit allow has precedence, for the URL it fits and, within a
component, over the blocks of other aliases.

Hosts, paths and rules are expressions on each row; only the ends of edges are
shuffled, by URL. Components are found by joins (see components.py), their
decisions are map-side combined.

Defined cases: a URL that is null or has no ``://`` has an empty host and
path, fits no rule, is on no edge and is allowed; repeated rows get a row
each; an edge may lead to a URL that no page has; no edges and no pages are
empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolodeck.llm.components import connected_components
from rolodeck.llm.staging import staged

#: (rule, verdict). A rule is a host suffix up to the first slash and a path prefix from there.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Rules travel as a literal in the plan.
MOST_RULES = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What makes URLs the same on an edge: all but the fragment, scheme and host in lower case; null without ``://``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(size, host_size, allow, rule, verdict); null if none does."""
    if len(rules) > MOST_RULES or any("/" not in r or v not in ("allow", "block") for r, v in rules):
        raise ValueError(f"at most {MOST_RULES} rules 'host/path', allow or block")
    fits = []
    for rule, verdict in rules:
        name = rule[: rule.index("/")]
        fit = ((host == name) | host.endswith(f".{name}")) & path.startswith(rule[len(name) :])
        found = F.struct(F.lit(len(rule)).alias("size"), F.lit(len(name)).alias("host_size"), F.lit(verdict == "allow").alias("allow"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(fit, found))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,host_size:int,allow:boolean,rule:string,verdict:string>")


_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<script\b.*?(?:</script|$)", re.S | re.I)
_TAG = re.compile(r"<(link|meta)\b([^>]*)>", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_REFRESH = re.compile(r"""\burl\s*=\s*["']?([^"']*)""", re.I)


def targets(url: str, html: str) -> list[str]:
    """Where the canonical links and meta refreshes of a page lead, as whole URLs."""
    out = []
    for name, attributes in _TAG.findall(_HIDDEN.sub(" ", html)):
        got = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        link = None
        if name.lower() == "link" and "canonical" in got.get("rel", "").lower().split():
            link = got.get("href")
        elif name.lower() == "meta" and got.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.search(got.get("content", ""))):
            link = m[1]
        if link and link.strip():
            try:
                out.append(urljoin(url, link.strip()))
            except ValueError:  # not a URL
                pass
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(url, to) for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for to in targets(url, html)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["a", "b"])


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): the page's URL and the target of its canonical link or of its redirect by meta refresh.

    Only pages that hold either word are parsed.
    """
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    return rows.mapInArrow(_edges, "a string, b string")


def alias_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(key, passed_on): for each URL on an edge, allow or block if a rule decides for any of its aliases."""
    parts = staged(connected_components(edges), "aliases")
    key = F.col("node")
    own = longest_rule(host_of(key), path_of(key), rules)["verdict"]
    said = parts.withColumn("own", own).groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allow"), F.max((F.col("own") == "block").cast("int")).alias("block"))
    said = said.select("component", F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").alias("passed_on")).where("passed_on IS NOT NULL")
    return parts.join(said, "component").select(F.col("node").alias("key"), "passed_on")


def judged(pages: DataFrame, edges: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``. edges: (a, b), URLs of redirects and canonical links."""
    edges = edges.select(key_of(F.col("a")).alias("a"), key_of(F.col("b")).alias("b"))
    passed = staged(alias_verdicts(edges, rules), "alias-verdicts")
    u = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), key_of(u).alias("key"))
    rows = rows.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules)).join(passed, "key", "left")
    return rows.select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", "passed_on", F.lit("allow")).alias("verdict"))
