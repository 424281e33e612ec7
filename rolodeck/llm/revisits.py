"""Operator 10, resolution of WARC not-modified revisits.

A server that answers 304 leaves a revisit record without a body. An as-of
join by canonical URL finds the latest earlier full response; if the
validators agree (entity tags by weak comparison, else Last-Modified), the
revisit gets that response's payload and its headers, updated by those that a
304 may change. Only ids and times take part in the as-of join (see asof.py);
payloads are fetched by record id afterwards, a join that AQE can split when
one response answers a third of all revisits.

Records: record_id (unique), kind (``response`` or ``revisit``), url, time
(any ordered type), headers (map, names in any case), payload.

Defined cases: a response at the same time is not earlier; a record with a
null url, time or id is not linked; revisits without an earlier response, with
validators that differ, or with none to compare keep their own headers and no
payload, and say so in ``outcome``; records of other kinds and full responses
pass through as ``full``; null headers are no headers; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolodeck.llm.asof import latest_earlier

#: Headers of a 304 that update the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track the visitor.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without a last slash, sorted query without tracking; no scheme or fragment."""
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.when(rest != "", F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def _lowered(headers: Column) -> Column:
    # of names that differ only in case, the last in byte order stands
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    none = F.array().cast("array<string>")
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(none, none))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), r"^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, kind, url, time, url_key, outcome, refers_to, headers, payload), a row for each record."""
    full = (F.col("kind") == "response") & F.col("record_id").isNotNull() & F.col("time").isNotNull()
    narrow = records.where("kind IN ('response', 'revisit') AND url IS NOT NULL AND time IS NOT NULL AND record_id IS NOT NULL").select(
        canonical_url(F.col("url")).alias("url_key"), "time", F.col("kind").eqNullSafe("response").alias("later"), "record_id",
        F.when(full, F.col("record_id")).alias("answer"),
    )
    # at the same time revisits come first, so that a response then is not earlier
    asof = latest_earlier(narrow, ["url_key"], ["time", "later", "record_id"], "answer", "refers_to").where("NOT later AND refers_to IS NOT NULL").select("record_id", "refers_to")
    rows = records.select("record_id", "kind", "url", "time", _lowered(F.col("headers")).alias("headers"), "payload", canonical_url(F.col("url")).alias("url_key"))
    revisits = rows.where("kind = 'revisit'").drop("payload").join(asof, "record_id", "left")
    answers = rows.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col("headers").alias("stored"), F.col("payload").alias("body"))
    found = revisits.join(answers, "refers_to", "left")
    own, stored = F.col("headers"), F.col("stored")
    same_tag = _tag(own) == _tag(stored)
    same_date = F.try_element_at(own, F.lit("last-modified")) == F.try_element_at(stored, F.lit("last-modified"))
    agree = F.coalesce(same_tag, same_date)
    outcome = F.when(F.col("refers_to").isNull(), "no_earlier_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    found = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    update = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    found = found.select(
        "record_id", "kind", "url", "time", "url_key", "outcome", F.when(resolved, F.col("refers_to")).alias("refers_to"),
        F.when(resolved, merged).otherwise(own).alias("headers"), F.when(resolved, F.col("body")).alias("payload"),
    )
    others = rows.where("kind IS NULL OR kind <> 'revisit'").select(
        "record_id", "kind", "url", "time", "url_key", F.lit("full").alias("outcome"), F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"), "headers", "payload")
    return found.unionByName(others)


#: Second at which the crawl of ``captures`` begins.
FIRST_DAY = 86_400


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl that fetched every page, some of them twice, and asked again for each under other spellings of its URL.

    Per page: a response at second 100 * page_id of the crawl; for every fourth page a changed response 40 later; revisits 20 and
    60 later (every third page: only the second). Every fifth page answers with a foreign entity tag, every seventh
    without one but with Last-Modified, every eleventh has a revisit before its response.
    """
    p = F.col("page_id")
    html = F.coalesce("html", F.lit(""))
    changed = F.concat(html, F.lit("<!-- changed -->"))
    day = lambda t: F.concat(F.lit("day "), F.floor(t / 86_400).cast("string"))

    def response(step, name, body):
        t = p * 100 + FIRST_DAY + step
        h = F.map_from_arrays(
            F.array(*[F.lit(x) for x in ("ETag", "Last-Modified", "Content-Type", "Date", "Content-Length")]),
            F.array(F.when(p % 7 == 0, F.lit("none")).otherwise(F.concat(F.lit('"'), F.md5(body), F.lit('"'))), F.concat(F.lit("mod "), p.cast("string"), F.lit(name)), F.lit("text/html"), day(t), F.octet_length(body).cast("string")),
        )
        return F.struct(F.concat(F.lit(f"{name}-"), p.cast("string")).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("url"), t.alias("time"), F.map_filter(h, lambda k, v: ~((k == "ETag") & (v == "none"))).alias("headers"), body.alias("payload"))

    def revisit(step, name, last, body):
        t = p * 100 + FIRST_DAY + step
        tag = F.when(p % 5 == 0, F.lit('"foreign"')).when(p % 7 == 0, F.lit("none")).otherwise(F.concat(F.lit('W/"'), F.md5(body), F.lit('"')))
        h = F.map_from_arrays(
            F.array(*[F.lit(x) for x in ("etag", "last-modified", "cache-control", "date", "content-length", "x-seen")]),
            F.array(tag, F.concat(F.lit("mod "), p.cast("string"), F.lit(last)), F.lit("max-age=60"), day(t), F.lit("0"), F.lit(name)),
        )
        asked = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", "HTTPS://"), "#.*$", ""), F.when(F.col("url").contains("?"), "&utm_medium=again").otherwise("?utm_medium=again"))
        return F.struct(F.concat(F.lit(f"{name}-"), p.cast("string")).alias("record_id"), F.lit("revisit").alias("kind"), asked.alias("url"), t.alias("time"), F.map_filter(h, lambda k, v: ~((k == "etag") & (v == "none"))).alias("headers"), F.lit(None).cast("string").alias("payload"))

    twice, again = p % 4 == 0, p % 3 != 0
    made = F.array_compact(F.array(
        response(0, "first", html), F.when(twice, response(40, "second", changed)), F.when(again, revisit(20, "early", "first", html)),
        F.when(twice, revisit(60, "late", "second", changed)).otherwise(revisit(60, "late", "first", html)), F.when(p % 11 == 0, revisit(-30, "before", "first", html)),
    ))
    return pages.select(F.explode(made).alias("r")).select("r.*")
