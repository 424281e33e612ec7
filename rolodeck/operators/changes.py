"""Change application as set operators.

A batch of commands is applied to a contact snapshot and yields the next
snapshot rows, the activity rows to append and one outcome per command.
Version checks and e-mail ownership are ``versionscan``; everything else is
joins and map-side-combined aggregates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rolodeck.functions import rules
from rolodeck.functions.text import trim_lower, trim_to_null
from rolodeck.functions.jsonpayload import json_object
from rolodeck.operators import predicates as P
from rolodeck.operators import versionscan
from rolodeck.operators.listing import seeded_order
from rolodeck.session import checkpoint_dir
from rolodeck.sources.contacts import with_generated_columns

# Editable fields (API name → column) and outcome codes.
EDITABLE = {"firstName": "first_name", "lastName": "last_name", "email": "email", "phone": "phone", "company": "company"}
APPLIED, NO_CHANGE = "APPLIED", "NO_CHANGE"
NOT_FOUND, IN_TRASH, CONFLICT, EMAIL_TAKEN = "NOT_FOUND", "CONTACT_DELETED", "VERSION_CONFLICT", "EMAIL_TAKEN"
ALREADY_DELETED, ALREADY_ACTIVE = "ALREADY_DELETED", "ALREADY_ACTIVE"
BULK_MAX_IDS = 1000
MAX_TAGS = 20
TOO_MANY_TAGS, TOO_MANY_IDS = "TOO_MANY_TAGS", "TOO_MANY_IDS"
INVALID = "VALIDATION_ERROR"


# ---------------------------------------------------------------- F24 / helpers


def changed_fields(old: dict[str, Column], new: dict[str, Column], present: dict[str, Column]) -> Column:
    """map field → {from, to} for present fields whose value differs (null-safe)."""
    entries = [
        F.when(present[k] & ~old[k].eqNullSafe(new[k]),
               F.struct(F.lit(k).alias("key"), F.struct(old[k].alias("from"), new[k].alias("to")).alias("value")))
        for k in old
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda x: x.isNotNull()))


def normalise_fields(df: DataFrame, prefix: str = "") -> DataFrame:
    """F2/F3 on command values: names/phone/company trimmed to null, e-mail trimmed and lower-cased."""
    return df.withColumns({
        f"{prefix}first_name": trim_to_null(f"{prefix}first_name"),
        f"{prefix}last_name": trim_to_null(f"{prefix}last_name"),
        f"{prefix}email": trim_lower(f"{prefix}email"),
        f"{prefix}phone": trim_to_null(f"{prefix}phone"),
        f"{prefix}company": trim_to_null(f"{prefix}company"),
    })


def _event_id(kind: str, as_of: dt.datetime, *key: Column | str) -> Column:
    """An event's id: its kind, its batch (the batch's clock) and its key in the batch. A batch that is applied again
    gives the same ids; another batch's event on the same contact has another one."""
    return F.xxhash64(F.lit(kind), F.lit(as_of.isoformat()), *key).alias("id")


def _ev(account: Column, contact: Column, typ: str, payload: Column, seq: Column, as_of: dt.datetime) -> list[Column]:
    return [
        _event_id(typ, as_of, seq),
        account.alias("account_id"), contact.alias("contact_id"), F.lit(typ).alias("type"),
        payload.alias("payload"), P.ts_lit(as_of).alias("created_at"),
    ]


# ---------------------------------------------------------------- M1 create


def apply_create(contacts: DataFrame, commands: DataFrame, as_of: dt.datetime, tags: DataFrame | None = None) -> dict[str, DataFrame]:
    """M1: insert normalised contacts with their initial tags.

    ``commands``: seq, account_id, new_id, first_name, last_name, email, phone,
    company and, where ``tags`` (the tags that there are) is given, a column
    tags of names. A command that breaks a rule of its fields (``rules``) is
    VALIDATION_ERROR; an e-mail already used by an active contact, or taken by
    an earlier valid command of the batch, is EMAIL_TAKEN. Either writes
    nothing, no tag and no event. Names are trimmed and used once in any
    casing; a tag of the account keeps its casing, a new one takes the first
    spelling. Returns new_contacts, new_tags, new_links, activity and outcomes
    (seq, contact_id, outcome, errors)."""
    names = rules.trimmed_tags("tags") if tags is not None else F.array().cast("array<string>")
    c = normalise_fields(commands).withColumn("_names", names)
    # rules are checked once, not in each output
    checkpoint_dir(contacts.sparkSession)
    c = c.withColumn("errors", rules.field_errors(tags=F.col("_names"))).withColumn("_ok", F.size("errors") == 0)
    c = c.withColumn("_k", P.spread_nulls(F.when(F.col("_ok"), F.col("email")), F.col("seq"))).checkpoint()
    taken = contacts.filter(P.is_active() & F.col("email").isNotNull()).select("account_id", F.col("email").alias("_k")).distinct()
    free = c.filter("_ok").join(taken, ["account_id", "_k"], "left_anti")
    first = free.filter(F.col("email").isNotNull()).groupBy("account_id", "_k").agg(F.min("seq").alias("_first"))
    judged = c.join(first, ["account_id", "_k"], "left").drop("_k").withColumn(
        "outcome",
        F.when(~F.col("_ok"), INVALID).when(F.col("email").isNull() | (F.col("seq") == F.col("_first")), APPLIED).otherwise(EMAIL_TAKEN),
    )
    ok = judged.filter(F.col("outcome") == APPLIED)
    ts = P.ts_lit(as_of)
    new_rows = with_generated_columns(ok.select(
        F.col("new_id").alias("id"), "account_id", "first_name", "last_name", "email", "phone", "company",
        F.lit(1).alias("version"), ts.alias("created_at"), ts.alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    ))
    payload = json_object(F.struct(F.struct(F.col("first_name").alias("firstName"), F.col("last_name").alias("lastName")).alias("fields")))
    activity = ok.select(*_ev(F.col("account_id"), F.col("new_id"), "CONTACT_CREATED", payload, F.col("seq"), as_of))
    out = {"new_contacts": new_rows, "activity": activity,
           "outcomes": judged.select("seq", F.col("new_id").alias("contact_id"), "outcome", "errors")}
    if tags is None:
        return out
    wanted = ok.select("seq", "account_id", F.col("new_id").alias("contact_id"), F.posexplode("_names").alias("pos", "name"))
    links, new_tags = _resolved_tags(wanted, tags)
    tag_payload = json_object(F.struct(F.struct(F.col("tag_id").alias("id"), F.col("tag_name").alias("name")).alias("tag")))
    added = links.select(_event_id("create-tag", as_of, "seq", "tag_id"), "account_id", "contact_id", F.lit("TAG_ADDED").alias("type"), tag_payload.alias("payload"), ts.alias("created_at"))
    return out | {"activity": activity.unionByName(added), "new_tags": new_tags.select("id", "account_id", "name", ts.alias("created_at")),
                  "new_links": links.select("contact_id", "tag_id", ts.alias("created_at"))}


def _resolved_tags(wanted: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, new tags) of ``wanted`` (seq, account_id, contact_id, pos, name): per command and lower-cased name one link
    (with tag_id, tag_name, pos), to the account's tag of that name or to a new one in the first spelling."""
    per_cmd = wanted.groupBy("seq", "account_id", "contact_id", F.lower("name").alias("key")).agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))
    firsts = per_cmd.groupBy("account_id", "key").agg(F.min_by("name", F.struct("seq", "pos")).alias("first"))
    have = tags.select("account_id", F.lower("name").alias("key"), F.col("id").cast("long").alias("tag_id"), F.col("name").alias("have"))
    resolved = firsts.join(have, ["account_id", "key"], "left").select(
        "account_id", "key", F.coalesce("tag_id", F.xxhash64("account_id", "key")).alias("tag_id"), F.coalesce("have", "first").alias("tag_name"),
        F.col("tag_id").isNull().alias("is_new"))
    new = resolved.filter("is_new").select(F.col("tag_id").alias("id"), "account_id", F.col("tag_name").alias("name"))
    return per_cmd.join(resolved, ["account_id", "key"]), new


# ---------------------------------------------------------------- M2 / M3 / M4


def apply_commands(contacts: DataFrame, commands: DataFrame, as_of: dt.datetime, chain: int = versionscan.CHAIN, range_rows: int = versionscan.RANGE_ROWS) -> dict[str, DataFrame]:
    """M2 update / M3 soft delete / M4 restore for a batch of commands, as if
    applied one after another in ``seq`` order.

    ``commands``: seq (unique), account_id, contact_id, kind ∈ {update, delete,
    restore}, expected_version, and for updates first_name … company with
    ``*_set`` presence flags. Returns next_contacts (changed rows only),
    activity and outcomes (seq, contact_id, kind, outcome, version).

    An update that breaks a rule of its fields is VALIDATION_ERROR, a command
    for a contact that its account does not have NOT_FOUND. An
    e-mail belongs to the active contact that holds it at that moment: it is
    free again once its owner changes it or goes to the trash, and a restore
    claims what the contact had last. ``versionscan`` judges the batch in
    expressions; ``chain`` commands of a contact share a row, contacts with more
    are spread, as are e-mails in batches of more than ``range_rows`` commands. The judged batch is checkpointed (eagerly, in the shared
    checkpoint folder): the three outputs read it.
    """
    fields = list(versionscan.FIELDS)
    checkpoint_dir(contacts.sparkSession)
    cmds = normalise_fields(commands).withColumn("seq", F.col("seq").cast("bigint"))
    snap = contacts.select("id", "account_id", "version", "deleted_at", *fields, "created_at")
    known = snap.select(F.col("id").alias("contact_id"), "account_id", F.col("version").cast("int").alias("version"),
                        F.col("deleted_at").isNotNull().alias("deleted"), *fields)
    given = {f: F.coalesce(F.col(f"{f}_set"), F.lit(False)) for f in fields}
    cmds = cmds.withColumn("errors", F.when(F.col("kind") == "update", rules.field_errors(given)).otherwise(F.array().cast(rules.NO_ERRORS)))
    folded = versionscan.settle(cmds.filter(F.size("errors") == 0).drop("errors"), known, chain, range_rows).checkpoint()

    invalid = cmds.filter(F.size("errors") > 0).select("seq", "contact_id", "kind", F.lit(INVALID).alias("outcome"), F.lit(None).cast("int").alias("version"))
    outcomes = folded.select("seq", "contact_id", "kind", "outcome", "version").unionByName(invalid)

    ts = P.ts_lit(as_of)
    applied = folded.filter(F.col("outcome") == APPLIED)
    is_upd = F.col("kind") == "update"
    after = [F.when(is_upd & F.col(f"{f}_set"), F.col(f)).otherwise(F.col(f"b_{f}")).alias(f) for f in fields]
    # the state after each contact's last applied command (partial max_by per map task, so a hot contact ships one row per task)
    last = applied.groupBy("contact_id", "account_id").agg(
        F.max_by(F.struct(*after, "version", "deleted"), "seq").alias("s"))
    next_rows = with_generated_columns(last.join(snap.select(F.col("id").alias("contact_id"), "created_at", "deleted_at").hint("merge"), "contact_id").select(
        F.col("contact_id").alias("id"), "account_id", *[F.col(f"s.{f}").alias(f) for f in fields],
        F.col("s.version").alias("version"), "created_at", ts.alias("updated_at"),
        F.when(F.col("s.deleted") & F.col("deleted_at").isNotNull(), F.col("deleted_at")).when(F.col("s.deleted"), ts).alias("deleted_at"),
    ))
    chg = changed_fields({k: F.col(f"b_{v}") for k, v in EDITABLE.items()}, {k: F.col(v) for k, v in EDITABLE.items()},
                         {k: F.col(f"{v}_set") for k, v in EDITABLE.items()})
    typ = F.when(is_upd, "CONTACT_UPDATED").when(F.col("kind") == "delete", "CONTACT_DELETED").otherwise("CONTACT_RESTORED")
    payload = F.when(is_upd, json_object(F.struct(chg.alias("changes"), F.col("version").alias("version")))) \
        .otherwise(json_object(F.struct(F.col("version").alias("version"))))
    activity = applied.select(
        _event_id("change", as_of, F.col("seq")), "account_id", "contact_id", typ.alias("type"),
        payload.alias("payload"), ts.alias("created_at"),
    )
    return {"next_contacts": next_rows, "activity": activity, "outcomes": outcomes}


# ---------------------------------------------------------------- M5 / M8 bulk, J7, A18


def _request_keys(requests: DataFrame) -> tuple[list[str], Column]:
    """Bulk requests are reported per ``request_id`` when the requests carry
    one, applied in that order; without it an account's requests count as
    one request."""
    if "request_id" in requests.columns:
        return ["request_id", "account_id"], F.col("request_id")
    return ["account_id"], F.lit(0)


def _sized(requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(requests of at most ``BULK_MAX_IDS`` distinct ids, the others as refused rows: keys, requested, outcome).

    A request that names more is refused whole: nothing is written for it."""
    sizes = requests.groupBy(*keys).agg(F.count_distinct("id").alias("requested"))
    over = sizes.filter(F.col("requested") > BULK_MAX_IDS)
    return requests.join(over.select(*keys), keys, "left_anti"), over.withColumn("outcome", F.lit(TOO_MANY_IDS))


def bulk_delete(contacts: DataFrame, requests: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """M5: trash the requested ids (ids de-duplicated per request; other
    accounts' ids are not found). ``requests``: [request_id,] account_id, id.
    An active contact is trashed by the first request naming it; later
    requests find it already in the trash. A request of more than 1,000 ids is
    in ``refused`` instead of the report, and trashes nothing."""
    keys, order = _request_keys(requests)
    requests, refused = _sized(requests, keys)
    req = requests.select(*keys, "id").distinct().withColumn("_order", order)
    existing = req.join(contacts.select("account_id", "id", "deleted_at"), ["account_id", "id"])
    first = existing.filter(P.is_active()).groupBy("account_id", "id").agg(F.min("_order").alias("_first"))
    judged = existing.join(first, ["account_id", "id"], "left").withColumn(
        "_deletes", P.is_active() & (F.col("_order") == F.col("_first")))
    report = (
        req.groupBy(*keys).agg(F.count(F.lit(1)).alias("requested"))
        .join(judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_existing"), F.count_if("_deletes").alias("deleted")), keys, "left")
        .select(*keys, "requested", F.coalesce("deleted", F.lit(0)).alias("deleted"),
                (F.coalesce("_existing", F.lit(0)) - F.coalesce("deleted", F.lit(0))).alias("already_in_trash"),
                (F.col("requested") - F.coalesce("_existing", F.lit(0))).alias("not_found"))
    )
    to_trash = first.select("account_id", "id")
    ts = P.ts_lit(as_of)
    changed = contacts.join(to_trash.select("id"), "id", "left_semi").withColumn("version", F.col("version") + 1) \
        .withColumn("deleted_at", ts).withColumn("updated_at", ts)
    activity = to_trash.select(_event_id("bulk-delete", as_of, F.col("id")), "account_id", F.col("id").alias("contact_id"),
                               F.lit("CONTACT_DELETED").alias("type"), F.lit('{"bulk":true}').alias("payload"), ts.alias("created_at"))
    return {"next_contacts": changed, "activity": activity, "report": report, "refused": refused,
            "not_found": bulk_not_found(contacts, requests)}


def bulk_not_found(contacts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested ids with no contact in the requesting account."""
    return requests.select("account_id", "id").distinct().join(contacts.select("account_id", "id"), ["account_id", "id"], "left_anti")


def bulk_tag(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, requests: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """M8: tag many contacts with one tag name. ``requests``: [request_id,]
    account_id, id, tag_name. Trashed and foreign ids count as not found;
    the tag is found case-insensitively (existing casing kept) or created
    (``new_tags``), in the spelling of the first request that names it and
    even if that request matches no contact.
    A link is added by the first request that asks for it; later requests
    find the contact already tagged. A request of more than 1,000 ids is in
    ``refused`` instead of the report; it adds no link and no tag."""
    keys, order = _request_keys(requests)
    requests, refused = _sized(requests, keys)
    req = requests.select(*keys, "id", "tag_name").distinct().withColumn("_order", order)
    names = req.groupBy("account_id", F.lower("tag_name").alias("key")).agg(F.min_by("tag_name", F.struct("_order", "tag_name")).alias("tag_name"))
    have = tags.select("account_id", F.lower("name").alias("key"), F.col("id").cast("long").alias("tag_id"), F.col("name").alias("have"))
    tag = names.join(have, ["account_id", "key"], "left").select(
        "account_id", "key", F.coalesce("tag_id", F.xxhash64("account_id", "key")).alias("tag_id"), F.coalesce("have", "tag_name").alias("name"),
        F.col("tag_id").isNull().alias("is_new"))
    target = req.join(contacts.filter(P.is_active()).select("account_id", "id"), ["account_id", "id"], "left_semi") \
        .withColumn("key", F.lower("tag_name")).join(tag, ["account_id", "key"])
    links = contact_tags.select(F.col("contact_id").alias("id"), F.col("tag_id").cast("long").alias("tag_id"))
    fresh = target.join(links, ["id", "tag_id"], "left_anti")
    first = fresh.groupBy("id", "tag_id").agg(F.min("_order").alias("_first"))
    added = fresh.join(first, ["id", "tag_id"]).filter(F.col("_order") == F.col("_first"))
    per = req.groupBy(*keys).agg(F.count(F.lit(1)).alias("requested")).join(
        target.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched")), keys, "left").join(
        added.groupBy(*keys).agg(F.count(F.lit(1)).alias("added")), keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = per.select(*keys, "requested", z("matched").alias("matched"), z("added").alias("added"),
                        (z("matched") - z("added")).alias("already_tagged"), (F.col("requested") - z("matched")).alias("not_found"))
    ts = P.ts_lit(as_of)
    activity = added.select(_event_id("bulk-tag", as_of, "id", "tag_id"), "account_id", F.col("id").alias("contact_id"),
                            F.lit("TAG_ADDED").alias("type"),
                            json_object(F.struct(F.struct(F.col("tag_id").alias("id"), "name").alias("tag"), F.lit(True).alias("bulk"))).alias("payload"),
                            ts.alias("created_at"))
    return {"new_links": added.select(F.col("id").alias("contact_id"), "tag_id", ts.alias("created_at")),
            "new_tags": tag.filter("is_new").select(F.col("tag_id").alias("id"), "account_id", "name", ts.alias("created_at")),
            "activity": activity, "report": report, "refused": refused}


def bulk_result_sets(contacts: DataFrame, requests: DataFrame) -> DataFrame:
    """Per bulk request, the sorted array of its ids that exist in its
    account and how many of them are active. ``requests``: request_id,
    account_id, id. A request of more than 1,000 distinct ids is refused (as
    the reference's validation does), so an array never exceeds 1,000 ids,
    whatever the size of the table or of the batch."""
    req = requests.select("request_id", "account_id", "id").distinct()
    sizes = req.groupBy("request_id", "account_id").agg(F.count(F.lit(1)).alias("requested"))
    ok = req.join(sizes.filter(F.col("requested") <= BULK_MAX_IDS).select("request_id"), "request_id", "left_semi")
    hit = ok.join(contacts.select("account_id", "id", "deleted_at"), ["account_id", "id"])
    res = hit.groupBy("request_id").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count_if(P.is_active()).alias("affected"))
    valid = F.col("requested") <= BULK_MAX_IDS
    return sizes.join(res, "request_id", "left").select(
        "request_id", "account_id", "requested", (~valid).alias("refused"),
        F.when(valid, F.coalesce("ids", F.array().cast(ArrayType(requests.schema["id"].dataType)))).alias("ids"),
        F.when(valid, F.coalesce("affected", F.lit(0))).alias("affected"),
    )


# ---------------------------------------------------------------- M6 / M7 tags


def add_tags(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, commands: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """M6: add up to 20 names to a contact (first spelling wins); only new
    links are written and logged; a trashed contact is rejected, and so is a
    command with more names, of which none is added; the contact version does
    not change. ``commands``: seq, account_id, contact_id, names."""
    outcome = F.when(F.size("names") > MAX_TAGS, TOO_MANY_TAGS).when(F.col("deleted_at").isNotNull(), IN_TRASH).when(F.col("deleted_at").isNull() & F.col("_found"), APPLIED).otherwise(NOT_FOUND)
    c = commands.join(contacts.select(F.col("id").alias("contact_id"), "account_id", "deleted_at", F.lit(True).alias("_found")),
                      ["contact_id", "account_id"], "left").withColumn("outcome", F.coalesce(outcome, F.lit(NOT_FOUND)))
    ok = c.filter(F.col("outcome") == APPLIED)
    wanted = ok.select("seq", "account_id", "contact_id", F.posexplode("names").alias("pos", "name")) \
        .withColumn("name", trim_to_null("name")).filter(F.col("name").isNotNull())
    links, new_tags = _resolved_tags(wanted, tags)
    existing = contact_tags.select("contact_id", F.col("tag_id").cast("long").alias("tag_id"))
    new_links = links.join(existing, ["contact_id", "tag_id"], "left_anti")
    first_add = new_links.groupBy("contact_id", "tag_id").agg(F.min(F.struct("seq", "pos")).alias("_k"))
    new_links = new_links.join(first_add, ["contact_id", "tag_id"]).filter(F.struct("seq", "pos") == F.col("_k"))
    ts = P.ts_lit(as_of)
    activity = new_links.select(_event_id("add-tag", as_of, "seq", "tag_id"), "account_id", "contact_id", F.lit("TAG_ADDED").alias("type"),
                                json_object(F.struct(F.struct(F.col("tag_id").alias("id"), F.col("tag_name").alias("name")).alias("tag"))).alias("payload"),
                                ts.alias("created_at"))
    counts = new_links.groupBy("seq").agg(F.count(F.lit(1)).alias("added_count"))
    outcomes = c.select("seq", "contact_id", "outcome").join(counts, "seq", "left").withColumn("added_count", F.coalesce("added_count", F.lit(0)))
    return {"new_links": new_links.select("contact_id", "tag_id", ts.alias("created_at")),
            "new_tags": new_tags.select("id", "account_id", "name", ts.alias("created_at")),
            "activity": activity, "outcomes": outcomes}


def remove_tag(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, commands: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """M7: delete the (contact, tag) link when the tag belongs to the account.

    The first command of the batch that names an existing link removes it and
    writes TAG_REMOVED; later ones find no link and write nothing. A trashed
    contact is refused. ``commands``: seq, account_id, contact_id, tag_id."""
    known = contacts.select(F.col("id").alias("contact_id"), "account_id", "deleted_at", F.lit(True).alias("_found"))
    judged = commands.join(known, ["contact_id", "account_id"], "left").withColumn(
        "outcome", F.when(F.col("_found").isNull(), NOT_FOUND).when(F.col("deleted_at").isNotNull(), IN_TRASH).otherwise(APPLIED))
    t = tags.select(F.col("id").alias("tag_id"), "account_id", F.col("name").alias("tag_name"))
    links = contact_tags.select("contact_id", "tag_id")
    first = judged.filter(F.col("outcome") == APPLIED).join(links, ["contact_id", "tag_id"], "left_semi") \
        .groupBy("account_id", "contact_id", "tag_id").agg(F.min("seq").alias("seq"))
    removed = first.join(t, ["tag_id", "account_id"])
    remaining = contact_tags.join(removed.select("contact_id", "tag_id"), ["contact_id", "tag_id"], "left_anti")
    activity = removed.select(_event_id("remove-tag", as_of, "seq", "contact_id", "tag_id"), "account_id", "contact_id", F.lit("TAG_REMOVED").alias("type"),
                              json_object(F.struct(F.struct(F.col("tag_id").alias("id"), F.col("tag_name").alias("name")).alias("tag"))).alias("payload"),
                              P.ts_lit(as_of).alias("created_at"))
    return {"contact_tags": remaining, "activity": activity, "outcomes": judged.select("seq", "contact_id", "outcome")}


# ---------------------------------------------------------------- M11 / M12 / J12 / U1–U3


def email_conflicts(contacts: DataFrame) -> DataFrame:
    """Active non-null e-mails used more than once in an account."""
    return contacts.filter(P.is_active() & F.col("email").isNotNull()).groupBy("account_id", "email").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def email_owner(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """The active contact that owns each (account, e-mail)."""
    act = contacts.filter(P.is_active()).select("account_id", "email", "id", F.concat_ws(" ", "first_name", "last_name").alias("name"))
    return emails.select("account_id", "email").distinct().join(act, ["account_id", "email"])


def three_way_merge(base: DataFrame, mine: DataFrame, latest: DataFrame, fields: list[str]) -> DataFrame:
    """Per contact and per field the user changed (mine ≠ base): the
    original, latest and mine values, ``clash`` when latest differs from both,
    and the merged value (mine wins on the fields the user changed)."""
    j = _three_sides(base, mine, latest, fields)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("original"), F.col(f"l_{f}").alias("latest"),
                              F.col(f"m_{f}").alias("mine")) for f in fields])
    x = j.select("id", F.explode(rows).alias("r")).select("id", "r.*").filter(~F.col("mine").eqNullSafe(F.col("original")))
    return x.withColumn("clash", ~F.col("latest").eqNullSafe(F.col("original")) & ~F.col("latest").eqNullSafe(F.col("mine"))) \
        .withColumn("merged", F.col("mine"))


def rebased(base: DataFrame, mine: DataFrame, latest: DataFrame, fields: list[str]) -> DataFrame:
    """The user's edits on top of the latest contact: (id, expected_version, fields and their ``_set``), an update
    command per contact that the user changed. A field that the user did not touch keeps what the others made of it."""
    j = _three_sides(base, mine, latest, fields).join(latest.select("id", F.col("version").cast("int").alias("expected_version")), "id")
    touched = {f: ~F.col(f"m_{f}").eqNullSafe(F.col(f"b_{f}")) for f in fields}
    changed = F.lit(False)
    for t in touched.values():
        changed = changed | t
    return j.filter(changed).select("id", "expected_version", *[F.when(t, F.col(f"m_{f}")).otherwise(F.col(f"l_{f}")).alias(f) for f, t in touched.items()], *[t.alias(f"{f}_set") for f, t in touched.items()])


def _three_sides(base: DataFrame, mine: DataFrame, latest: DataFrame, fields: list[str]) -> DataFrame:
    def side(df, tag):
        return df.select("id", *[F.col(f).alias(f"{tag}_{f}") for f in fields])
    return side(base, "b").join(side(mine, "m"), "id").join(side(latest, "l"), "id")


def union_all_pick(named: DataFrame, others: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The named rows UNION ALL a seeded hash-ordered sample of others."""
    pick = others.orderBy(seeded_order("id", seed), "id").limit(n)
    return named.select("id").unionByName(pick.select("id"))


def distinct_ids(ids: DataFrame) -> DataFrame:
    """U2."""
    return ids.select("id").distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in ``a`` but not in ``b`` (set semantics)."""
    return a.select("id").subtract(b.select("id"))
