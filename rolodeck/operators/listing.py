"""Search, filter, sort and keyset-page contacts.

A page is a top-k: with one tenant it is ``orderBy(...).limit(n)`` (planned
as ``TakeOrderedAndProject``, a bounded heap per partition, no full sort);
for all tenants at once it is ``row_number() <= n`` per account, which Spark
limits per group before the shuffle. Tags are joined after the limit.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolodeck.functions.text import UUID_PATTERN
from rolodeck.operators import predicates as P
from rolodeck.operators.ranking import position_by_key, position_within, top_n_per_group

# Fixed values
SORT_COLUMNS = {"name": "name_sort", "createdAt": "created_at", "deletedAt": "deleted_at"}
TOTAL_CAP = 10_000
MAX_TAG_FILTER = 10
TAG_PREFIX_LIMIT = 200
QUICK_FETCH, QUICK_KEEP = 15, 6


@dataclass
class ListQuery:
    account_id: int | None = None  # None = every tenant, one page each
    status: str = "active"
    q: str | None = None
    tags: list[str] = field(default_factory=list)
    company: str | None = None
    attention: str | None = None
    created_from: dt.datetime | None = None
    created_to: dt.datetime | None = None
    sort: str | None = None
    order: str = "desc"
    limit: int = 25
    cursor: str | None = None

    def resolved_sort(self) -> str:
        sort = self.sort or ("deletedAt" if self.status == "deleted" else "createdAt")
        if self.status == "deleted" and sort != "deletedAt":
            raise ValueError("The trash can only be sorted by deletedAt")
        if self.status == "active" and sort == "deletedAt":
            raise ValueError("deletedAt sorting is only available for the trash")
        if self.attention and self.status == "deleted":
            raise ValueError("Attention filters only apply to active contacts")
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must be 1 to 100")
        if len(self.tags) > MAX_TAG_FILTER:
            raise ValueError("at most 10 tags")
        return sort


# ---------------------------------------------------------------- O3 cursors


def text_timestamp(c) -> Column:
    """timestamp as text with microseconds (so a cursor keeps them)."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sort_value_text(sort: str) -> Column:
    col = SORT_COLUMNS[sort]
    return F.col(col) if sort == "name" else text_timestamp(F.col(col))


def cursor_token(ordering: Column, value: Column, id_col: Column) -> Column:
    """O3: base64url (no padding) of {"s": sort:order, "v": value, "id": id}."""
    js = F.to_json(F.struct(ordering.alias("s"), value.alias("v"), id_col.cast("string").alias("id")))
    # Spark's base64 wraps lines (MIME style); drop the breaks and the padding
    b64 = F.regexp_replace(F.base64(F.encode(js, "UTF-8")), "[\\r\\n=]", "")
    return F.translate(b64, "+/", "-_")


def encode_cursor(sort: str, order: str, value: str, id_) -> str:
    raw = json.dumps({"s": f"{sort}:{order}", "v": value, "id": str(id_)}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(token: str, expected_ordering: str) -> tuple[str, int | str]:
    """Driver-side check of a cursor parameter; refuses another ordering or a bad id."""
    try:
        pad = "=" * (-len(token) % 4)
        p = json.loads(base64.urlsafe_b64decode(token + pad).decode("utf-8"))
        s, v, i = p["s"], p["v"], p["id"]
        if not all(isinstance(x, str) for x in (s, v, i)) or s != expected_ordering:
            raise ValueError
        if re.match(UUID_PATTERN, i):
            return v, i
        return v, int(i)
    except Exception as e:  # noqa: BLE001
        raise ValueError("Cursor is invalid or does not match the requested sort") from e


# ---------------------------------------------------------------- filters


def with_any_tag(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, names: list[str]) -> DataFrame:
    """Contacts having ANY of the tag names (case-insensitive): EXISTS →
    left semi join against links of the matching (few) tags."""
    wanted = [n.strip().lower() for n in names if n.strip()]
    hit_tags = tags.filter(F.lower("name").isin(wanted)).select(F.col("id").alias("tag_id"))
    links = contact_tags.join(hit_tags, "tag_id", "left_semi").select(F.col("contact_id").alias("id"))
    return contacts.join(links, "id", "left_semi")


def list_filtered(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, q: ListQuery,
                  as_of: dt.datetime) -> DataFrame:
    """P10: AND of every requested filter (without the cursor)."""
    q.resolved_sort()
    df = contacts
    if q.account_id is not None:
        df = P.for_account(df, q.account_id)
    df = P.with_status(df, q.status)
    if q.q:
        df = df.filter(P.search_predicate(q.q))
    if q.company:
        df = df.filter(P.company_predicate(q.company))
    if q.created_from or q.created_to:
        df = df.filter(P.created_between(q.created_from, q.created_to))
    if q.tags:
        df = with_any_tag(df, tags, contact_tags, q.tags)
    if q.attention:
        if q.attention == "duplicate_phone":
            df = df.join(P.duplicate_phone(contacts).select("id"), "id", "left_semi")
        elif q.attention == "untagged":
            df = P.untagged(df, contact_tags)
        elif q.attention == "no_contact_info":
            df = df.filter(P.no_contact_info())
        elif q.attention == "stale":
            df = df.filter(P.stale(as_of))
        else:
            raise ValueError(f"unknown attention filter {q.attention!r}")
    return df


def sort_columns(sort: str, order: str) -> list[Column]:
    """O1: sort key then id, both in the requested direction."""
    key, idc = F.col(SORT_COLUMNS[sort]), F.col("id")
    return [key.asc(), idc.asc()] if order == "asc" else [key.desc(), idc.desc()]


def after_cursor(sort: str, order: str, value, id_) -> Column:
    """O2: strict (key, id) comparison. Written as ``k >= v AND (k > v OR id > i)``
    so the first conjunct is a plain range predicate Parquet can push down."""
    key = F.col(SORT_COLUMNS[sort])
    v = F.lit(value) if sort == "name" else F.lit(value).cast("timestamp_ntz")
    i = F.lit(id_)
    if order == "asc":
        return (key >= v) & ((key > v) | (F.col("id") > i))
    return (key <= v) & ((key < v) | (F.col("id") < i))


def keyset_page(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, q: ListQuery,
                as_of: dt.datetime) -> DataFrame:
    """O2 (+P10): one page per account: the contact columns, ``pos`` in the
    page, ``has_more`` and the ``next_cursor`` for the last row of the page."""
    sort = q.resolved_sort()
    df = list_filtered(contacts, tags, contact_tags, q, as_of)
    if q.cursor:
        v, i = decode_cursor(q.cursor, f"{sort}:{q.order}")
        df = df.filter(after_cursor(sort, q.order, v, i))
    ordering = sort_columns(sort, q.order)
    fetched = top_n_per_group(df, ["account_id"], ordering, q.limit + 1, out="pos")
    size = F.count(F.lit(1)).over(Window.partitionBy("account_id"))
    page = fetched.withColumn("_fetched", size)
    has_more = F.col("_fetched") > q.limit
    return page.filter(F.col("pos") <= q.limit).select(
        *[c for c in contacts.columns],
        "pos",
        has_more.alias("has_more"),
        F.when(has_more & (F.col("pos") == q.limit),
               cursor_token(F.lit(f"{sort}:{q.order}"), sort_value_text(sort), F.col("id"))).alias("next_cursor"),
    )


def single_tenant_page(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, q: ListQuery,
                       as_of: dt.datetime) -> DataFrame:
    """O2 for one account: ``orderBy(k, id).limit(limit + 1)`` (TakeOrderedAndProject)."""
    if q.account_id is None:
        raise ValueError("single_tenant_page needs an account")
    sort = q.resolved_sort()
    df = list_filtered(contacts, tags, contact_tags, q, as_of)
    if q.cursor:
        v, i = decode_cursor(q.cursor, f"{sort}:{q.order}")
        df = df.filter(after_cursor(sort, q.order, v, i))
    return df.orderBy(*sort_columns(sort, q.order)).limit(q.limit + 1)


def list_total(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, q: ListQuery,
               as_of: dt.datetime, cap: int = TOTAL_CAP) -> DataFrame:
    """First-page total per account, capped (A13 across tenants)."""
    df = list_filtered(contacts, tags, contact_tags, q, as_of)
    return df.groupBy("account_id").agg(F.count(F.lit(1)).alias("_n")).select(
        "account_id", F.least(F.col("_n"), F.lit(cap)).cast("long").alias("total"), (F.col("_n") > cap).alias("total_capped")
    )


# ---------------------------------------------------------------- J4


def contact_tag_list(contact_tags: DataFrame, tags: DataFrame, contact_ids: DataFrame | None = None) -> DataFrame:
    """Per contact, its tags ordered by lower(name), then id, as array<struct<id,name>>."""
    links = contact_tags.select("contact_id", "tag_id")
    if contact_ids is not None:
        links = links.join(contact_ids.select(F.col("id").alias("contact_id")), "contact_id", "left_semi")
    t = tags.select(F.col("id").alias("tag_id"), "name")
    return (
        links.join(t, "tag_id")
        .groupBy("contact_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), F.col("tag_id").alias("id"), "name"))).alias("_t"))
        .select("contact_id", F.transform("_t", lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"))).alias("tags"))
    )


def with_tags(page: DataFrame, contact_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Attach J4 to an already-limited page (left join; empty array when untagged)."""
    tl = contact_tag_list(contact_tags, tags, page.select("id"))
    return page.join(tl.withColumnRenamed("contact_id", "id"), "id", "left").withColumn(
        "tags", F.coalesce(F.col("tags"), F.array().cast("array<struct<id:int,name:string>>"))
    )


# ---------------------------------------------------------------- P11 / P12 / P13


def point_lookup(contacts: DataFrame, account_id, id_) -> DataFrame:
    """One contact by (id, account), trashed included."""
    return contacts.filter((F.col("id") == F.lit(id_)) & (F.col("account_id") == F.lit(account_id)))


def id_in_list(contacts: DataFrame, ids: DataFrame) -> DataFrame:
    """Contacts whose id is in a (de-duplicated) id DataFrame: left semi join."""
    return contacts.join(ids.select("id").distinct(), "id", "left_semi")


def tag_prefix(tags: DataFrame, prefix: str, limit: int = TAG_PREFIX_LIMIT) -> DataFrame:
    """Tags of each account whose lower(name) starts with the prefix (≤ 50
    chars), ordered by lower(name) then id, at most ``limit`` per account."""
    p = prefix.strip().lower()[:50]
    hits = tags.filter(F.startswith(F.lower("name"), F.lit(p)))
    return top_n_per_group(hits, ["account_id"], [F.lower("name"), F.col("id")], limit, out="rank").select(
        "account_id", "id", "name", "rank"
    )


# ---------------------------------------------------------------- O1 / W8 / O3


def sort_contacts(contacts: DataFrame, sort: str = "createdAt", order: str = "desc", status: str = "active") -> DataFrame:
    """O1 over whole accounts: ``pos`` = 1-based position in the list order
    (distributed ranking, no single task per account)."""
    df = P.with_status(contacts, status)
    return position_by_key(df, "id", ["account_id"], sort_columns(sort, order), [SORT_COLUMNS[sort]], out="pos")


def page_numbers(contacts: DataFrame, sort: str = "createdAt", order: str = "desc", limit: int = 25,
                 status: str = "active") -> DataFrame:
    """Page index (0-based) of every row when paging with ``limit``."""
    df = P.with_status(contacts, status).select("account_id", "id", SORT_COLUMNS[sort])
    ranked = position_within(df, ["account_id"], sort_columns(sort, order), out="pos")
    return ranked.select("account_id", "id", "pos", F.floor((F.col("pos") - 1) / limit).cast("long").alias("page"))


def page_cursors(contacts: DataFrame, sort: str = "createdAt", order: str = "desc", limit: int = 25,
                 status: str = "active") -> DataFrame:
    """O3: the next-page token of every page that has a next page."""
    df = P.with_status(contacts, status).select("account_id", "id", SORT_COLUMNS[sort])
    ranked = position_within(df, ["account_id"], sort_columns(sort, order), out="pos", with_group_size="_size")
    last = ranked.filter((F.col("pos") % limit == 0) & (F.col("pos") < F.col("_size")))
    return last.select(
        "account_id",
        (F.col("pos") / limit - 1).cast("long").alias("page"),
        cursor_token(F.lit(f"{sort}:{order}"), sort_value_text(sort), F.col("id")).alias("cursor"),
    )


# ---------------------------------------------------------------- O5 / O7 / O8 / W6


def newest_n(contacts: DataFrame, n: int, per_account: bool = True) -> DataFrame:
    """Newest ``n`` contacts (created_at desc, id desc)."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    if per_account:
        return top_n_per_group(contacts, ["account_id"], order, n).select("account_id", "id", "created_at", "rank")
    return contacts.orderBy(*order).limit(n).select("account_id", "id", "created_at")


def import_history(jobs: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` jobs per account (1–100)."""
    n = min(max(n, 1), 100)
    return top_n_per_group(jobs, ["account_id"], [F.col("created_at").desc(), F.col("id").desc()], n)


def seeded_order(column: str, seed: int) -> Column:
    """A value to order by that looks random: the MD5 of the seed and the column."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")).cast("binary"))


def random_sample(contacts: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``ORDER BY random() LIMIT n`` as a seeded hash order (repeatable)."""
    return contacts.orderBy(seeded_order("id", seed), F.col("id")).limit(n).select("id")


def bernoulli_sample(contacts: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """O7 (TABLESAMPLE form): keep each row with probability ``fraction``."""
    return contacts.sample(withReplacement=False, fraction=fraction, seed=seed)


def quick_search_rank(contacts: DataFrame, q: str) -> DataFrame:
    """Per account, the first 15 active matches by name, re-ranked
    0 = full name starts with the term, 1 = last name or e-mail starts with it,
    2 = other match; stable on the name order; keep 6."""
    term, _ = P.search_terms(q)
    hits = contacts.filter(P.is_active() & P.search_predicate(q))
    first15 = top_n_per_group(hits, ["account_id"], [F.col("name_sort").asc(), F.col("id").asc()], QUICK_FETCH, out="fetch_pos")
    rank = (
        F.when(F.startswith(F.col("search_name"), F.lit(term)), 0)
        .when(F.startswith(F.lower("last_name"), F.lit(term)) | F.coalesce(F.startswith(F.col("email"), F.lit(term)), F.lit(False)), 1)
        .otherwise(2)
    )
    ranked = first15.withColumn("match_rank", rank)
    return top_n_per_group(ranked, ["account_id"], [F.col("match_rank"), F.col("fetch_pos")], QUICK_KEEP, out="pos").select(
        "account_id", "pos", "match_rank", "id", F.concat_ws(" ", "first_name", "last_name").alias("name")
    )
