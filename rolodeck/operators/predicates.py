"""Shared predicates (P1–P9, J2, J3) used by both lists and metric counts.

The same ``Column`` / DataFrame builders serve the list filter and the count,
so an attention number always equals the length of the list it links to.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
STALE_DAYS = 90
SEARCH_MIN, SEARCH_MAX = 2, 100
ATTENTION_FILTERS = ("no_contact_info", "untagged", "stale", "duplicate_phone")

_PHONE_LIKE = re.compile(r"^[\d\s()+.\-]+$")


def ts_lit(value: dt.datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def is_active() -> Column:
    """P2 'active'."""
    return F.col("deleted_at").isNull()


def is_trashed() -> Column:
    """P2 'deleted'."""
    return F.col("deleted_at").isNotNull()


def for_account(df: DataFrame, account_id) -> DataFrame:
    """Keep one tenant (pushed into the Parquet scan)."""
    return df.filter(F.col("account_id") == F.lit(account_id))


def with_status(df: DataFrame, status: str = "active") -> DataFrame:
    """P2."""
    if status not in ("active", "deleted"):
        raise ValueError(f"unknown status {status!r}")
    return df.filter(is_active() if status == "active" else is_trashed())


def search_terms(q: str) -> tuple[str, str | None]:
    """Driver-side check of the search term (P3/P4): the lower-cased term and,
    when the term looks like a phone number with at least 3 digits, its digits."""
    t = q.strip()
    if not (SEARCH_MIN <= len(t) <= SEARCH_MAX):
        raise ValueError("search must be 2 to 100 characters")
    lower = t.lower()
    digits = re.sub(r"\D", "", t)
    phone = digits if _PHONE_LIKE.match(t) and len(digits) >= 3 else None
    return lower, phone


def search_predicate(q: str) -> Column:
    """P3 + P4 + P5: name or email contains the term literally (no LIKE
    escaping needed), or the phone digits contain the term's digits."""
    lower, phone = search_terms(q)
    cond = F.contains(F.col("search_name"), F.lit(lower)) | F.contains(F.col("email"), F.lit(lower))
    if phone is not None:
        cond = cond | F.contains(F.col("phone_digits"), F.lit(phone))
    # null email makes the OR null, never true; coalesce keeps filter semantics explicit
    return F.coalesce(cond, F.lit(False))


def company_predicate(s: str) -> Column:
    """Substring of the lower-cased company."""
    return F.contains(F.col("company_lower"), F.lit(s.strip().lower()))


def created_between(start: dt.datetime | None = None, end: dt.datetime | None = None) -> Column:
    """Inclusive at both ends, either end optional."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("created_at") >= ts_lit(start))
    if end is not None:
        cond = cond & (F.col("created_at") <= ts_lit(end))
    return cond


def no_contact_info() -> Column:
    """Neither e-mail nor phone (phone IS NULL, not 'no digits')."""
    return F.col("email").isNull() & F.col("phone").isNull()


def stale(as_of: dt.datetime) -> Column:
    """Not updated for 90 days before ``as_of`` (strict)."""
    return F.col("updated_at") < ts_lit(as_of - dt.timedelta(days=STALE_DAYS))


def untagged(contacts: DataFrame, contact_tags: DataFrame) -> DataFrame:
    """Contacts with no link row (NOT EXISTS → left anti join)."""
    return contacts.join(contact_tags.select(F.col("contact_id").alias("id")), "id", "left_anti")


def shared_phone_keys(contacts: DataFrame) -> DataFrame:
    """(account_id, phone_digits, n) for digits used by more than one active
    contact. Empty digits are removed *before* the shuffle (they would be the
    hottest key); the count is a partial (map-side) aggregate, so a key held by
    a third of all rows still moves only one row per map task."""
    return (
        contacts.filter(is_active() & (F.col("phone_digits") != ""))
        .groupBy("account_id", "phone_digits")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def duplicate_phone(contacts: DataFrame) -> DataFrame:
    """Active contacts whose phone digits are shared within the account.

    Semi join against the grouped keys (AQE splits a skewed key), instead of
    a window over (account, digits) that would pull a hot group into one task.
    Only ids and numbers are dealt by number; the contacts meet the ids by id,
    in the buckets of the store.
    """
    active = contacts.filter(is_active() & (F.col("phone_digits") != ""))
    keys = shared_phone_keys(contacts).select("account_id", "phone_digits")
    ids = active.select("id", "account_id", "phone_digits").join(keys, ["account_id", "phone_digits"], "left_semi").select("id")
    return active.join(ids, "id", "left_semi")


def attention(contacts: DataFrame, contact_tags: DataFrame, which: str, as_of: dt.datetime) -> DataFrame:
    """The four attention lists, over active contacts."""
    active = contacts.filter(is_active())
    if which == "no_contact_info":
        return active.filter(no_contact_info())
    if which == "untagged":
        return untagged(active, contact_tags)
    if which == "stale":
        return active.filter(stale(as_of))
    if which == "duplicate_phone":
        return duplicate_phone(contacts)
    raise ValueError(f"unknown attention filter {which!r}")


def spread_nulls(key: Column, salt: Column) -> Column:
    """Join / window key for an optional text value (e-mail, claim). A null
    matches nothing; a unique NUL-prefixed text, which no stored value can
    equal, gives the same left, anti and semi join results while spreading
    the rows without a value over all partitions instead of hashing them all
    to one."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), salt.cast("string")))
