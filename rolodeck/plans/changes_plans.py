"""Registered change-application queries (M1–M12, J7, J12, U1–U3, A18, F24) and oracles.

Command batches are derived from the test tables: ``events`` rows become
update / delete / restore / create / tag commands (``seq`` = event id, the
contact = the event's user), ``orders`` become bulk requests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rolodeck.functions import rules
from rolodeck.functions.jsonpayload import json_object
from rolodeck.operators import changes as C
from rolodeck.plans.oracle_fixtures import with_fixtures
from rolodeck.sources.fixtures import AS_OF, load_model, raw

FIELDS = ["first_name", "last_name", "email", "phone", "company"]


def _events(spark, sf):
    return raw(spark, sf, "events").select("event_id", "user_id", "event_type")


def _with_account(spark, sf, df, m):
    acc = m.contacts.select(F.col("id").alias("user_id"), F.col("account_id").alias("_acc"))
    # a few commands come from the other tenant: those must be NOT_FOUND
    return df.join(acc.hint("merge"), "user_id").withColumn(
        "account_id", F.when(F.col("event_id") % 17 == 0, 1 - F.col("_acc")).otherwise(F.col("_acc")).cast("int")).drop("_acc")


def commands(spark, sf, m):
    """Mixed update / delete / restore batch (see module doc)."""
    e = _events(spark, sf).filter(F.col("event_type").isin("click", "error", "purchase"))
    e = _with_account(spark, sf, e, m)
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "delete").otherwise("restore")
    upd = kind == "update"
    return e.select(
        k.alias("seq"), "account_id", F.col("user_id").alias("contact_id"), kind.alias("kind"),
        (1 + k % 4).cast("int").alias("expected_version"),
        F.lit(None).cast("string").alias("first_name"), F.lit(False).alias("first_name_set"),
        F.when(upd & (k % 11 == 0), F.lit("  Renamed ")).alias("last_name"), (upd & (k % 11 == 0)).alias("last_name_set"),
        F.when(upd & (k % 7 == 0), F.concat(F.lit(" Shared"), (k % 3).cast("string"), F.lit("@Mail.TEST "))).alias("email"),
        (upd & (k % 7 == 0)).alias("email_set"),
        F.when(upd & (k % 5 == 0), F.concat(F.lit(" +1 555 "), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone"),
        (upd & (k % 5 == 0)).alias("phone_set"),
        F.when(upd & (k % 2 == 0), F.concat(F.lit("Co "), (k % 4).cast("string"))).alias("company"),
        (upd & (k % 2 == 0)).alias("company_set"),
    )


def _applied(spark, sf):
    m = load_model(spark, sf)
    return C.apply_commands(m.contacts, commands(spark, sf, m), AS_OF)


def _outcomes(kind):
    def q(spark, sf):
        return _applied(spark, sf)["outcomes"].filter(F.col("kind") == kind).select("seq", "contact_id", "outcome", "version")
    return q


def q_apply_next_contacts(spark, sf):
    return _applied(spark, sf)["next_contacts"].select("id", "account_id", "version", "email", "phone", "company", "last_name",
                                                       F.col("deleted_at").isNotNull().alias("trashed"))


def q_activity_emit(spark, sf):
    return _applied(spark, sf)["activity"].select("contact_id", "type", "payload")


def create_commands(spark, sf, m):
    e = _with_account(spark, sf, _events(spark, sf).filter(F.col("event_type") == "signup"), m)
    part = raw(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    known = m.contacts.select(F.col("id").alias("user_id"), F.col("email").alias("_known"))
    k = F.col("event_id")
    e = e.join(part, e.event_id == part.p_partkey, "left").join(known, "user_id", "left")
    email = (
        F.when((k % 5 == 0) & F.col("_known").isNotNull(), F.concat(F.lit(" "), F.upper("_known")))
        .when(k % 7 == 0, F.concat(F.lit("batch"), (k % 3).cast("string"), F.lit("@dup.test")))
        .when(k % 9 == 0, F.lit("   "))
        .otherwise(F.concat(F.lit("new."), k.cast("string"), F.lit("@signup.test")))
    )
    first = F.when(k % 31 == 0, F.repeat(F.lit("x"), 101)).when(k % 37 == 0, F.lit("  ")).otherwise(F.coalesce(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("Ann")))
    lead = F.concat(F.lit("Lead"), (k % 3).cast("string"))
    tags = F.when(k % 23 == 0, F.array(F.lit("a,b"), F.lit("VIP"))).when(k % 29 == 0, F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: F.concat(F.lit("t"), i.cast("string")))) \
        .when(k % 2 == 0, F.array(F.lit(" VIP "), F.lit("vip"), lead, F.lit("  "), F.lit("Urgent")))
    return e.select(
        k.alias("seq"), "account_id", (-(k + 1)).alias("new_id"), first.alias("first_name"),
        F.concat(F.lit(" "), F.coalesce(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("Lee"))).alias("last_name"),
        email.alias("email"), F.when(k % 19 == 0, F.lit("12-34")).when(k % 4 == 0, F.lit("+1 (555) 010-0100")).alias("phone"),
        F.when(k % 41 == 0, F.repeat(F.lit("c"), 151)).otherwise(F.col("p_brand")).alias("company"), tags.alias("tags"),
    )


def q_apply_create(spark, sf):
    m = load_model(spark, sf)
    out = C.apply_create(m.contacts, create_commands(spark, sf, m), AS_OF, m.tags)["outcomes"]
    return out.withColumn("errors", rules.errors_text("errors"))


def q_apply_create_writes(spark, sf):
    """All that the creates write: contacts, tags, links (by the tag's name) and events."""
    m = load_model(spark, sf)
    out = C.apply_create(m.contacts, create_commands(spark, sf, m), AS_OF, m.tags)
    names = m.tags.select(F.col("id").cast("long").alias("tag_id"), "name").unionByName(out["new_tags"].select(F.col("id").alias("tag_id"), "name"))
    null = F.lit(None).cast("string")
    rows = [
        out["new_contacts"].select(F.lit("contact").alias("what"), "account_id", F.col("id").alias("contact_id"), F.concat_ws("|", "first_name", "last_name", F.coalesce("email", F.lit("-")), F.coalesce("phone", F.lit("-")), F.coalesce("company", F.lit("-")), "version").alias("detail")),
        out["new_tags"].select(F.lit("tag").alias("what"), "account_id", F.lit(None).cast("long").alias("contact_id"), F.col("name").alias("detail")),
        out["new_links"].join(names, "tag_id").select(F.lit("link").alias("what"), F.lit(None).cast("int").alias("account_id"), "contact_id", F.col("name").alias("detail")),
        out["activity"].select(F.col("type").alias("what"), "account_id", "contact_id", F.coalesce(F.get_json_object("payload", "$.tag.name"), F.get_json_object("payload", "$.fields.firstName"), null).alias("detail")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def bulk_requests(spark, sf):
    """Bulk requests from all orders: each 500 order keys make a request per account, of the orders' customers and of ids that
    no contact has; each 5,000 keys make one more that names too many ids."""
    o, key = raw(spark, sf, "orders"), F.col("o_orderkey")
    acc = (key % 2).cast("int")

    def request(kind: str, keys: int, id):
        rid = F.concat(F.lit(kind), acc.cast("string"), F.lit(":"), F.floor(key / keys).cast("string"))
        return o.select(rid.alias("request_id"), acc.alias("account_id"), id.alias("id"))

    ghost = key + 1_000_000_000
    return request("r", 500, F.col("o_custkey")).unionByName(request("r", 500, F.when(key % 10 == 7, ghost).otherwise(F.col("o_custkey")))).unionByName(request("big", 5000, ghost)).withColumn("tag_name", F.when(F.col("account_id") == 0, "urgent").otherwise("Big Spender"))


def _with_refused(out):
    return out["report"].withColumn("outcome", F.lit(C.APPLIED)).unionByName(out["refused"], allowMissingColumns=True)


def q_bulk_delete(spark, sf):
    m = load_model(spark, sf)
    return _with_refused(C.bulk_delete(m.contacts, bulk_requests(spark, sf), AS_OF))


def q_bulk_tag(spark, sf):
    m = load_model(spark, sf)
    return _with_refused(C.bulk_tag(m.contacts, m.tags, m.contact_tags, bulk_requests(spark, sf), AS_OF))


def q_bulk_not_found(spark, sf):
    return C.bulk_not_found(load_model(spark, sf).contacts, bulk_requests(spark, sf))


def q_bulk_result_sets(spark, sf):
    r = C.bulk_result_sets(load_model(spark, sf).contacts, bulk_requests(spark, sf))
    return r.select("request_id", "account_id", "requested", "refused",
                    F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "affected")


def tag_commands(spark, sf, m):
    e = _with_account(spark, sf, _events(spark, sf).filter(F.col("event_type") == "view"), m)
    k = F.col("event_id")
    return e.select(k.alias("seq"), "account_id", F.col("user_id").alias("contact_id"),
                    F.array(F.lit(" VIP"), F.lit("vip"), F.concat(F.lit("Lead"), (k % 3).cast("string")), F.lit("urgent")).alias("names"))


def q_add_tags(spark, sf):
    m = load_model(spark, sf)
    out = C.add_tags(m.contacts, m.tags, m.contact_tags, tag_commands(spark, sf, m), AS_OF)
    # the tag id of a new tag is a hash id; the check reads the contact and the tag's name from each TAG_ADDED event
    return out["activity"].select("contact_id", F.get_json_object("payload", "$.tag.name").alias("tag_name"))


def remove_commands(spark, sf, m):
    e = _with_account(spark, sf, _events(spark, sf).filter(F.col("event_type") == "purchase"), m)
    return e.select(F.col("event_id").alias("seq"), "account_id", F.col("user_id").alias("contact_id"),
                    (F.col("account_id") * 10 + F.col("event_id") % 5 + 1).cast("int").alias("tag_id"))


def q_remove_tag(spark, sf):
    m = load_model(spark, sf)
    out = C.remove_tag(m.contacts, m.tags, m.contact_tags, remove_commands(spark, sf, m), AS_OF)
    return out["activity"].select("contact_id", "payload")


def q_bulk_writes(spark, sf):
    """All that the bulk requests write: trashed contacts, links (by the tag's name) and events."""
    m = load_model(spark, sf)
    req = bulk_requests(spark, sf)
    deleted, tagged = C.bulk_delete(m.contacts, req, AS_OF), C.bulk_tag(m.contacts, m.tags, m.contact_tags, req, AS_OF)
    names = m.tags.select(F.col("id").cast("long").alias("tag_id"), "name").unionByName(tagged["new_tags"].select(F.col("id").alias("tag_id"), "name"))
    name = F.get_json_object("payload", "$.tag.name")
    return deleted["next_contacts"].filter("deleted_at IS NOT NULL").select(F.lit("trashed").alias("what"), F.col("id").alias("contact_id"), F.col("version").cast("string").alias("detail")).unionByName(
        tagged["new_links"].join(names, "tag_id").select(F.lit("link").alias("what"), "contact_id", F.col("name").alias("detail"))).unionByName(
        deleted["activity"].unionByName(tagged["activity"]).select(F.col("type").alias("what"), "contact_id", F.coalesce(name, "payload").alias("detail")))


def q_tag_outcomes(spark, sf):
    """What became of each add and remove command."""
    m = load_model(spark, sf)
    added = C.add_tags(m.contacts, m.tags, m.contact_tags, tag_commands(spark, sf, m), AS_OF)["outcomes"]
    removed = C.remove_tag(m.contacts, m.tags, m.contact_tags, remove_commands(spark, sf, m), AS_OF)["outcomes"]
    return added.unionByName(removed.withColumn("added_count", F.lit(None).cast("long")))


def q_email_conflicts(spark, sf):
    m = load_model(spark, sf)
    naive = C.normalise_fields(create_commands(spark, sf, m)).select("account_id", "email", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return C.email_conflicts(m.contacts.select("account_id", "email", "deleted_at").unionByName(naive))


def q_email_owner(spark, sf):
    m = load_model(spark, sf)
    o = raw(spark, sf, "orders").select((2 * F.col("o_orderkey")).alias("id"))
    emails = m.contacts.join(o, "id", "left_semi").select("account_id", "email")
    return C.email_owner(m.contacts, emails)


def _merge_sides(m):
    base = m.contacts
    latest = base.withColumn("company", F.when(F.col("id") % 5 == 0, F.concat(F.coalesce("company", F.lit("")), F.lit(" Ltd"))).otherwise(F.col("company")))
    mine = base.withColumn("company", F.when(F.col("id") % 3 == 0, F.concat(F.coalesce("company", F.lit("")), F.lit(" Ltd"))).otherwise(F.col("company"))) \
        .withColumn("phone", F.when(F.col("id") % 4 == 0, F.lit("+1 555 0100")).otherwise(F.col("phone")))
    return base, mine, latest


def q_three_way_merge(spark, sf):
    base, mine, latest = _merge_sides(load_model(spark, sf))
    return C.three_way_merge(base, mine, latest, FIELDS)


def q_rebased_record(spark, sf):
    """The user's edits as update commands on the latest contacts."""
    base, mine, latest = _merge_sides(load_model(spark, sf))
    return C.rebased(base, mine, latest.withColumn("version", F.col("version") + 1), FIELDS).select("id", "expected_version", "first_name", "phone", "company", "phone_set", "company_set", "email_set")


def q_changed_fields(spark, sf):
    base, mine, _ = _merge_sides(load_model(spark, sf))
    b = base.select("id", *[F.col(f).alias(f"b_{f}") for f in FIELDS])
    n = mine.select("id", *[F.col(f).alias(f"n_{f}") for f in FIELDS])
    j = b.join(n, "id")
    chg = C.changed_fields({f: F.col(f"b_{f}") for f in FIELDS}, {f: F.col(f"n_{f}") for f in FIELDS}, {f: F.lit(True) for f in FIELDS})
    return j.select("id", json_object(chg).alias("changes")).filter(F.col("changes") != "{}")


def q_union_all_pick(spark, sf):
    c = load_model(spark, sf).contacts
    return C.union_all_pick(c.filter(F.col("first_name") == "red"), c.filter(F.col("first_name") != "red"), 20)


def q_distinct_ids(spark, sf):
    return C.distinct_ids(bulk_requests(spark, sf))


def q_set_difference(spark, sf):
    m = load_model(spark, sf)
    return C.set_difference(bulk_requests(spark, sf), m.contacts.filter(F.col("deleted_at").isNull()))


QUERIES = {
    "apply_update": _outcomes("update"),
    "apply_soft_delete": _outcomes("delete"),
    "apply_restore": _outcomes("restore"),
    "apply_next_contacts": q_apply_next_contacts,
    "activity_emit": q_activity_emit,
    "apply_create": q_apply_create,
    "apply_create_writes": q_apply_create_writes,
    "bulk_delete": q_bulk_delete,
    "bulk_tag": q_bulk_tag,
    "bulk_not_found": q_bulk_not_found,
    "bulk_result_sets": q_bulk_result_sets,
    "add_tags": q_add_tags,
    "remove_tag": q_remove_tag,
    "bulk_writes": q_bulk_writes,
    "tag_outcomes": q_tag_outcomes,
    "email_conflicts": q_email_conflicts,
    "email_owner": q_email_owner,
    "three_way_merge": q_three_way_merge,
    "rebased_record": q_rebased_record,
    "changed_fields": q_changed_fields,
    "union_all_pick": q_union_all_pick,
    "distinct_ids": q_distinct_ids,
    "set_difference": q_set_difference,
}

_TRIM = "regexp_replace({x}, '^[\\t\\n\\x0B\\f\\r\\p{{Z}}\\x{{FEFF}}]+|[\\t\\n\\x0B\\f\\r\\p{{Z}}\\x{{FEFF}}]+$', '', 'g')"

_REQ = """
requests AS (
  SELECT 'r' || CAST(o_orderkey % 2 AS VARCHAR) || ':' || CAST(o_orderkey // 500 AS VARCHAR) AS request_id,
         CAST(o_orderkey % 2 AS INTEGER) AS account_id, u.id
  FROM orders, LATERAL (SELECT unnest([o_custkey, CASE WHEN o_orderkey % 10 = 7 THEN o_orderkey + 1000000000 ELSE o_custkey END]) AS id) u
  UNION ALL
  SELECT 'big' || CAST(o_orderkey % 2 AS VARCHAR) || ':' || CAST(o_orderkey // 5000 AS VARCHAR), CAST(o_orderkey % 2 AS INTEGER), o_orderkey + 1000000000 FROM orders
),
req AS (SELECT DISTINCT account_id, id FROM requests),
small AS (SELECT DISTINCT request_id, account_id, id FROM requests
          WHERE request_id IN (SELECT request_id FROM requests GROUP BY 1 HAVING count(DISTINCT id) <= 1000))
"""

_ACC = """
ev AS (
  SELECT e.event_id, e.user_id, e.event_type,
         CAST(CASE WHEN e.event_id % 17 = 0 THEN 1 - c.account_id ELSE c.account_id END AS INTEGER) AS account_id
  FROM events e JOIN contacts c ON c.id = e.user_id
)
"""

_CREATE = f"""
cc AS (
  SELECT ev.event_id AS seq, ev.account_id, -(ev.event_id + 1) AS new_id,
         nullif({_TRIM.format(x="""CASE WHEN ev.event_id % 31 = 0 THEN repeat('x', 101) WHEN ev.event_id % 37 = 0 THEN '  ' ELSE coalesce(split_part(p.p_name, ' ', 1), 'Ann') END""")}, '') AS first_name,
         nullif({_TRIM.format(x="coalesce(split_part(p.p_name, ' ', 2), 'Lee')")}, '') AS last_name,
         CASE WHEN ev.event_id % 19 = 0 THEN '12-34' WHEN ev.event_id % 4 = 0 THEN '+1 (555) 010-0100' END AS phone,
         CASE WHEN ev.event_id % 41 = 0 THEN repeat('c', 151) ELSE p.p_brand END AS company,
         CASE WHEN ev.event_id % 23 = 0 THEN ['a,b', 'VIP'] WHEN ev.event_id % 29 = 0 THEN list_transform(range(1, 22), lambda i: 't' || i)
              WHEN ev.event_id % 2 = 0 THEN ['VIP', 'vip', 'Lead' || ev.event_id % 3, 'Urgent'] ELSE [] END AS names,
         lower(nullif({_TRIM.format(x='''CASE WHEN ev.event_id % 5 = 0 AND k.email IS NOT NULL THEN ' ' || upper(k.email)
                    WHEN ev.event_id % 7 = 0 THEN 'batch' || CAST(ev.event_id % 3 AS VARCHAR) || '@dup.test'
                    WHEN ev.event_id % 9 = 0 THEN '   '
                    ELSE 'new.' || CAST(ev.event_id AS VARCHAR) || '@signup.test' END''')}, '')) AS email
  FROM ev LEFT JOIN part p ON p.p_partkey = ev.event_id LEFT JOIN contacts k ON k.id = ev.user_id
  WHERE ev.event_type = 'signup'
),
cv AS (
  SELECT *, array_to_string(list_filter([
           CASE WHEN first_name IS NULL THEN 'firstName: firstName should not be empty' END,
           CASE WHEN length(first_name) > 100 THEN 'firstName: firstName must be shorter than or equal to 100 characters' END,
           CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) NOT BETWEEN 7 AND 15 THEN 'phone: phone must be 7-15 digits and may contain + ( ) - . and spaces' END,
           CASE WHEN length(company) > 150 THEN 'company: company must be shorter than or equal to 150 characters' END,
           CASE WHEN len(names) > 20 THEN 'tags: tags must contain no more than 20 elements' END,
           CASE WHEN len(list_filter(names, lambda x: contains(x, ','))) > 0 THEN 'tags: tag names cannot contain commas' END], lambda x: x IS NOT NULL), '; ') AS errors
  FROM cc
),
co AS (
  SELECT cv.*, CASE WHEN cv.errors <> '' THEN 'VALIDATION_ERROR' WHEN cv.email IS NULL OR cv.seq = f.first_seq THEN 'APPLIED' ELSE 'EMAIL_TAKEN' END AS outcome
  FROM cv LEFT JOIN (
    SELECT account_id, email, min(seq) AS first_seq FROM cv
    WHERE errors = '' AND email IS NOT NULL AND NOT EXISTS (SELECT 1 FROM contacts c WHERE c.deleted_at IS NULL AND c.account_id = cv.account_id AND c.email = cv.email)
    GROUP BY 1, 2) f ON f.account_id = cv.account_id AND f.email = cv.email
),
cn AS (
  SELECT w.account_id, w.new_id, w.key, coalesce(t.name, f.first) AS name, t.id IS NULL AS is_new
  FROM (SELECT DISTINCT account_id, new_id, lower(n) AS key FROM (SELECT account_id, new_id, unnest(names) AS n FROM co WHERE outcome = 'APPLIED')) w
  JOIN (SELECT account_id, lower(n) AS key, arg_min(n, (seq, i)) AS first
        FROM (SELECT account_id, seq, unnest(names) AS n, unnest(range(len(names))) AS i FROM co WHERE outcome = 'APPLIED') GROUP BY 1, 2) f ON f.account_id = w.account_id AND f.key = w.key
  LEFT JOIN tags t ON t.account_id = w.account_id AND lower(t.name) = w.key
)
"""

# bulk requests apply in request order: the first request naming an active contact trashes it / adds the link
_BULK_DEL = """
rq AS (SELECT * FROM small),
ex AS (SELECT q.request_id, q.account_id, q.id, c.deleted_at IS NULL AS active
       FROM rq q JOIN contacts c ON c.account_id = q.account_id AND c.id = q.id),
fr AS (SELECT account_id, id, min(request_id) AS first FROM ex WHERE active GROUP BY 1, 2)
"""
_BULK_TAG = """
rqt AS (SELECT *, CASE WHEN account_id = 0 THEN 'urgent' ELSE 'Big Spender' END AS tag_name FROM small),
tgt AS (SELECT q.request_id, q.account_id, q.id, lower(q.tag_name) AS key, t.id AS tag_id
        FROM rqt q JOIN contacts c ON c.id = q.id AND c.account_id = q.account_id AND c.deleted_at IS NULL
        LEFT JOIN tags t ON t.account_id = q.account_id AND lower(t.name) = lower(q.tag_name)),
fresh AS (SELECT * FROM tgt x
          WHERE x.tag_id IS NULL OR NOT EXISTS (SELECT 1 FROM contact_tags ct WHERE ct.contact_id = x.id AND ct.tag_id = x.tag_id))
"""

ORACLE = {
    "apply_create": with_fixtures("SELECT seq, new_id AS contact_id, outcome, errors FROM co", extra_ctes=_ACC + "," + _CREATE),
    "apply_create_writes": with_fixtures("""
        SELECT 'contact' AS what, account_id, new_id AS contact_id, first_name || '|' || last_name || '|' || coalesce(email, '-') || '|' || coalesce(phone, '-') || '|' || coalesce(company, '-') || '|1' AS detail
        FROM co WHERE outcome = 'APPLIED'
        UNION ALL SELECT DISTINCT 'tag', account_id, CAST(NULL AS BIGINT), name FROM cn WHERE is_new
        UNION ALL SELECT 'link', CAST(NULL AS INTEGER), new_id, name FROM cn
        UNION ALL SELECT 'CONTACT_CREATED', account_id, new_id, first_name FROM co WHERE outcome = 'APPLIED'
        UNION ALL SELECT 'TAG_ADDED', account_id, new_id, name FROM cn""", extra_ctes=_ACC + "," + _CREATE),
    "rebased_record": with_fixtures("""
        SELECT id, CAST(version + 1 AS INTEGER) AS expected_version, first_name, CASE WHEN id % 4 = 0 THEN '+1 555 0100' ELSE phone END AS phone,
               CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN coalesce(company, '') || ' Ltd' ELSE company END AS company,
               id % 4 = 0 AND phone IS DISTINCT FROM '+1 555 0100' AS phone_set, id % 3 = 0 AS company_set, false AS email_set
        FROM contacts WHERE id % 3 = 0 OR id % 4 = 0 AND phone IS DISTINCT FROM '+1 555 0100'"""),
    "bulk_delete": with_fixtures("""
        SELECT request_id, account_id, count(DISTINCT id) AS requested, CAST(NULL AS BIGINT) AS deleted, CAST(NULL AS BIGINT) AS already_in_trash, CAST(NULL AS BIGINT) AS not_found,
               'TOO_MANY_IDS' AS outcome FROM requests GROUP BY 1, 2 HAVING count(DISTINCT id) > 1000
        UNION ALL
        SELECT r.request_id, r.account_id, r.requested, coalesce(e.deleted, 0) AS deleted,
               coalesce(e.existing, 0) - coalesce(e.deleted, 0) AS already_in_trash, r.requested - coalesce(e.existing, 0) AS not_found, 'APPLIED' AS outcome
        FROM (SELECT request_id, account_id, count(*) AS requested FROM rq GROUP BY 1, 2) r
        LEFT JOIN (SELECT ex.request_id, count(*) AS existing,
                          count(*) FILTER (WHERE ex.active AND ex.request_id = fr.first) AS deleted
                   FROM ex LEFT JOIN fr ON fr.account_id = ex.account_id AND fr.id = ex.id GROUP BY 1) e
          ON e.request_id = r.request_id""", extra_ctes=_REQ + "," + _BULK_DEL),
    "bulk_tag": with_fixtures("""
        SELECT request_id, account_id, count(DISTINCT id) AS requested, CAST(NULL AS BIGINT) AS matched, CAST(NULL AS BIGINT) AS added, CAST(NULL AS BIGINT) AS already_tagged,
               CAST(NULL AS BIGINT) AS not_found, 'TOO_MANY_IDS' AS outcome FROM requests GROUP BY 1, 2 HAVING count(DISTINCT id) > 1000
        UNION ALL
        SELECT r.request_id, r.account_id, r.requested, coalesce(m.matched, 0) AS matched, coalesce(a.added, 0) AS added,
               coalesce(m.matched, 0) - coalesce(a.added, 0) AS already_tagged, r.requested - coalesce(m.matched, 0) AS not_found, 'APPLIED' AS outcome
        FROM (SELECT request_id, account_id, count(*) AS requested FROM rqt GROUP BY 1, 2) r
        LEFT JOIN (SELECT request_id, count(*) AS matched FROM tgt GROUP BY 1) m ON m.request_id = r.request_id
        LEFT JOIN (SELECT f.request_id, count(*) AS added FROM fresh f
                   JOIN (SELECT account_id, id, key, min(request_id) AS first FROM fresh GROUP BY 1, 2, 3) x
                     ON x.account_id = f.account_id AND x.id = f.id AND x.key = f.key AND x.first = f.request_id
                   GROUP BY 1) a ON a.request_id = r.request_id""", extra_ctes=_REQ + "," + _BULK_TAG),
    "bulk_writes": with_fixtures("""
        SELECT 'trashed' AS what, c.id AS contact_id, CAST(c.version + 1 AS VARCHAR) AS detail FROM fr JOIN contacts c ON c.id = fr.id
        UNION ALL SELECT 'CONTACT_DELETED', id, '{"bulk":true}' FROM fr
        UNION ALL
        SELECT w.what, x.id, x.name FROM (
          SELECT DISTINCT f.id, coalesce(t.name, CASE WHEN f.account_id = 0 THEN 'urgent' ELSE 'Big Spender' END) AS name FROM fresh f LEFT JOIN tags t ON t.id = f.tag_id) x,
          (VALUES ('link'), ('TAG_ADDED')) w(what)""", extra_ctes=_REQ + "," + _BULK_DEL + "," + _BULK_TAG),
    "bulk_not_found": with_fixtures("""
        SELECT DISTINCT account_id, id FROM req q
        WHERE NOT EXISTS (SELECT 1 FROM contacts c WHERE c.account_id = q.account_id AND c.id = q.id)""", extra_ctes=_REQ),
    "bulk_result_sets": with_fixtures("""
        SELECT s.request_id, s.account_id, s.requested, s.requested > 1000 AS refused,
               CASE WHEN s.requested <= 1000 THEN coalesce(h.ids, '') END AS ids,
               CASE WHEN s.requested <= 1000 THEN coalesce(h.affected, 0) END AS affected
        FROM (SELECT request_id, account_id, count(*) AS requested
              FROM (SELECT DISTINCT request_id, account_id, id FROM requests) GROUP BY 1, 2) s
        LEFT JOIN (SELECT q.request_id, string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.id) AS ids,
                          count(*) FILTER (WHERE c.deleted_at IS NULL) AS affected
                   FROM (SELECT DISTINCT request_id, account_id, id FROM requests) q
                   JOIN contacts c ON c.account_id = q.account_id AND c.id = q.id GROUP BY 1) h ON h.request_id = s.request_id""",
        extra_ctes=_REQ),
    "remove_tag": with_fixtures("""
        SELECT ct.contact_id, '{"tag":{"id":' || CAST(t.id AS VARCHAR) || ',"name":"' || t.name || '"}}' AS payload
        FROM contact_tags ct JOIN tags t ON t.id = ct.tag_id
        JOIN contacts c ON c.id = ct.contact_id AND c.account_id = t.account_id AND c.deleted_at IS NULL
        WHERE EXISTS (SELECT 1 FROM ev WHERE event_type = 'purchase' AND ev.user_id = ct.contact_id AND ev.account_id = t.account_id
                      AND ev.account_id * 10 + ev.event_id % 5 + 1 = t.id)""", extra_ctes=_ACC),
    "email_conflicts": with_fixtures("""
        SELECT account_id, email, count(*) AS n FROM (
          SELECT account_id, email FROM contacts WHERE deleted_at IS NULL AND email IS NOT NULL
          UNION ALL SELECT account_id, email FROM cc WHERE email IS NOT NULL) x
        GROUP BY 1, 2 HAVING count(*) > 1""", extra_ctes=_ACC + "," + _CREATE),
    "email_owner": with_fixtures("""
        SELECT DISTINCT q.account_id, q.email, c.id, c.first_name || ' ' || c.last_name AS name
        FROM (SELECT account_id, email FROM contacts WHERE id IN (SELECT 2 * o_orderkey FROM orders)) q
        JOIN contacts c ON c.deleted_at IS NULL AND c.account_id = q.account_id AND c.email = q.email"""),
    "three_way_merge": with_fixtures("""
        SELECT id, field, original, latest, mine, latest IS DISTINCT FROM original AND latest IS DISTINCT FROM mine AS clash, mine AS merged
        FROM (
          SELECT id, 'company' AS field, company AS original,
                 CASE WHEN id % 5 = 0 THEN coalesce(company, '') || ' Ltd' ELSE company END AS latest,
                 CASE WHEN id % 3 = 0 THEN coalesce(company, '') || ' Ltd' ELSE company END AS mine FROM contacts
          UNION ALL
          SELECT id, 'phone', phone, phone, CASE WHEN id % 4 = 0 THEN '+1 555 0100' ELSE phone END FROM contacts
        ) x WHERE mine IS DISTINCT FROM original"""),
    "changed_fields": with_fixtures("""
        SELECT id, '{' || array_to_string(list_filter([
                 CASE WHEN id % 4 = 0 AND phone IS DISTINCT FROM '+1 555 0100'
                      THEN '"phone":{"from":' || CASE WHEN phone IS NULL THEN 'null' ELSE '"' || phone || '"' END || ',"to":"+1 555 0100"}' END,
                 CASE WHEN id % 3 = 0 THEN '"company":{"from":' || CASE WHEN company IS NULL THEN 'null' ELSE '"' || company || '"' END
                      || ',"to":"' || coalesce(company, '') || ' Ltd"}' END], lambda x: x IS NOT NULL), ',') || '}' AS changes
        FROM contacts WHERE id % 4 = 0 OR id % 3 = 0"""),
    "union_all_pick": with_fixtures("""
        SELECT id FROM contacts WHERE first_name = 'red'
        UNION ALL SELECT id FROM (SELECT id FROM contacts WHERE first_name <> 'red' ORDER BY md5('42:' || id), id LIMIT 20) x"""),
    "distinct_ids": with_fixtures("SELECT DISTINCT id FROM requests", extra_ctes=_REQ),
    "set_difference": with_fixtures("SELECT DISTINCT id FROM requests EXCEPT SELECT id FROM contacts WHERE deleted_at IS NULL",
                                    extra_ctes=_REQ),
}


# ---------------------------------------------------------------- DuckDB twin of the command fold (M2–M4)

_FIELDS_SQL = ["first_name", "last_name", "email", "phone", "company"]
_CHG = " + ".join(f"CAST(c.{f}_set AND s.{f} IS DISTINCT FROM c.{f} AS INTEGER)" for f in _FIELDS_SQL)
_OUTCOME = f"""CASE WHEN c.kind = 'update' THEN (CASE WHEN s.deleted THEN 'CONTACT_DELETED' WHEN c.expected_version <> s.version THEN 'VERSION_CONFLICT'
                                              WHEN ({_CHG}) = 0 THEN 'NO_CHANGE' WHEN c.email_lost THEN 'EMAIL_TAKEN' ELSE 'APPLIED' END)
              WHEN c.kind = 'delete' THEN (CASE WHEN s.deleted THEN 'ALREADY_DELETED' WHEN c.expected_version <> s.version THEN 'VERSION_CONFLICT'
                                              ELSE 'APPLIED' END)
              ELSE (CASE WHEN NOT s.deleted THEN 'ALREADY_ACTIVE' WHEN c.expected_version <> s.version THEN 'VERSION_CONFLICT'
                         WHEN c.email_lost THEN 'EMAIL_TAKEN' ELSE 'APPLIED' END) END"""
_APPLIED = f"(({_OUTCOME}) = 'APPLIED')"
_STEP = "{" + ", ".join([
    f"'version': CASE WHEN {_APPLIED} THEN s.version + 1 ELSE s.version END",
    f"'deleted': CASE WHEN {_APPLIED} AND c.kind = 'delete' THEN true WHEN {_APPLIED} AND c.kind = 'restore' THEN false ELSE s.deleted END",
    *[f"'{f}': CASE WHEN {_APPLIED} AND c.kind = 'update' AND c.{f}_set THEN c.{f} ELSE s.{f} END" for f in _FIELDS_SQL],
    f"'log': list_append(s.log, {{'seq': c.seq, 'outcome': {_OUTCOME}, "
    f"'version': CASE WHEN {_APPLIED} THEN s.version + 1 ELSE s.version END, 'kind': c.kind, "
    + ", ".join(f"'b_{f}': s.{f}, 'n_{f}': c.{f}, 'p_{f}': c.{f}_set" for f in _FIELDS_SQL) + "})",
]) + "}"
_LOG_T = "STRUCT(seq BIGINT, outcome VARCHAR, version INTEGER, kind VARCHAR, " + ", ".join(
    f"b_{f} VARCHAR, n_{f} VARCHAR, p_{f} BOOLEAN" for f in _FIELDS_SQL) + ")"

#: E-mails by rounds: the fold with the claims that are refused so far, the intervals in which contacts then hold e-mails, and
#: from these the claims that come while another contact holds theirs. Where a round changes nothing this is the batch applied
#: one command after another; the test data settle within ``_ROUNDS``. (SQL needs a fixed number; the engine goes on until
#: nothing changes.)
_ROUNDS = 9


def _mail_round(k: int) -> str:
    last = k == _ROUNDS
    folded = "folded" if last else f"folded{k}"
    refused = f"f.seq IN (SELECT seq FROM refused{k - 1})" if k else "false"
    sql = f"""
{folded} AS MATERIALIZED (
  SELECT j.contact_id, ct.account_id,
         list_reduce(j.cs, lambda s, c: {_STEP},
                     {{'version': ct.version, 'deleted': ct.deleted_at IS NOT NULL, 'first_name': ct.first_name, 'last_name': ct.last_name,
                       'email': ct.email, 'phone': ct.phone, 'company': ct.company,
                       'log': []::{_LOG_T}[]}}) AS s
  FROM (SELECT contact_id, list({{'seq': seq, 'kind': kind, 'expected_version': expected_version, 'email_lost': {refused},
                                  'first_name': first_name, 'first_name_set': first_name_set, 'last_name': last_name,
                                  'last_name_set': last_name_set, 'email': email, 'email_set': email_set, 'phone': phone,
                                  'phone_set': phone_set, 'company': company, 'company_set': company_set}} ORDER BY seq) AS cs
        FROM found f GROUP BY contact_id) j
  JOIN contacts ct ON ct.id = j.contact_id
)"""
    return sql if last else sql + f""",
entry{k} AS (SELECT f.account_id, f.contact_id, unnest(f.s.log) AS e FROM {folded} f),
got{k} AS (
  SELECT account_id, contact_id, e.seq AS seq, e.outcome AS outcome, CASE WHEN e.kind = 'restore' THEN e.b_email ELSE e.n_email END AS email
  FROM entry{k} WHERE e.outcome IN ('APPLIED', 'EMAIL_TAKEN') AND (e.kind = 'restore' OR e.kind = 'update' AND e.p_email)
),
hold{k} AS (
  SELECT account_id, contact_id, email, seq AS since FROM got{k} WHERE outcome = 'APPLIED' AND email IS NOT NULL
  UNION ALL SELECT account_id, id, email, -1 FROM contacts WHERE deleted_at IS NULL AND email IS NOT NULL
),
gave{k} AS (
  SELECT account_id, contact_id, e.seq AS seq, e.b_email AS email FROM entry{k}
  WHERE e.outcome = 'APPLIED' AND (e.kind = 'delete' OR e.kind = 'update' AND e.p_email AND e.b_email IS DISTINCT FROM e.n_email)
),
refused{k} AS MATERIALIZED (
  SELECT DISTINCT c.seq FROM got{k} c JOIN hold{k} h ON h.account_id = c.account_id AND h.email = c.email AND h.contact_id <> c.contact_id AND h.since < c.seq
  WHERE NOT EXISTS (SELECT 1 FROM gave{k} g WHERE g.contact_id = h.contact_id AND g.email = h.email AND g.seq > h.since AND g.seq < c.seq)
)"""


_FOLD_CTES = f"""
cmd_raw AS (
  SELECT ev.event_id AS seq, ev.account_id, ev.user_id AS contact_id,
         CASE WHEN ev.event_type = 'click' THEN 'update' WHEN ev.event_type = 'error' THEN 'delete' ELSE 'restore' END AS kind,
         CAST(1 + ev.event_id % 4 AS INTEGER) AS expected_version,
         CAST(NULL AS VARCHAR) AS first_name, false AS first_name_set,
         CASE WHEN ev.event_type = 'click' AND ev.event_id % 11 = 0 THEN '  Renamed ' END AS last_name,
         ev.event_type = 'click' AND ev.event_id % 11 = 0 AS last_name_set,
         CASE WHEN ev.event_type = 'click' AND ev.event_id % 7 = 0 THEN ' Shared' || CAST(ev.event_id % 3 AS VARCHAR) || '@Mail.TEST ' END AS email,
         ev.event_type = 'click' AND ev.event_id % 7 = 0 AS email_set,
         CASE WHEN ev.event_type = 'click' AND ev.event_id % 5 = 0 THEN ' +1 555 ' || lpad(CAST(ev.event_id % 10000 AS VARCHAR), 4, '0') END AS phone,
         ev.event_type = 'click' AND ev.event_id % 5 = 0 AS phone_set,
         CASE WHEN ev.event_type = 'click' AND ev.event_id % 2 = 0 THEN 'Co ' || CAST(ev.event_id % 4 AS VARCHAR) END AS company,
         ev.event_type = 'click' AND ev.event_id % 2 = 0 AS company_set
  FROM ev WHERE ev.event_type IN ('click', 'error', 'purchase')
),
cmds AS (
  SELECT * REPLACE (nullif({_TRIM.format(x='first_name')}, '') AS first_name, nullif({_TRIM.format(x='last_name')}, '') AS last_name,
                    lower(nullif({_TRIM.format(x='email')}, '')) AS email, nullif({_TRIM.format(x='phone')}, '') AS phone,
                    nullif({_TRIM.format(x='company')}, '') AS company)
  FROM cmd_raw
),
found AS (
  SELECT k.* FROM cmds k JOIN contacts c ON c.id = k.contact_id AND c.account_id = k.account_id
),
{','.join(_mail_round(k) for k in range(_ROUNDS + 1))},
outcomes AS (
  SELECT u.e.seq AS seq, f.contact_id, u.e.outcome AS outcome, u.e.version AS version
  FROM folded f, LATERAL (SELECT unnest(f.s.log) AS e) u
  UNION ALL
  SELECT k.seq, k.contact_id, 'NOT_FOUND', CAST(NULL AS INTEGER) FROM cmds k
  WHERE NOT EXISTS (SELECT 1 FROM contacts c WHERE c.id = k.contact_id AND c.account_id = k.account_id)
)
"""

for _kind, _name in [("update", "apply_update"), ("delete", "apply_soft_delete"), ("restore", "apply_restore")]:
    ORACLE[_name] = with_fixtures(f"""
        SELECT o.seq, o.contact_id, o.outcome, o.version FROM outcomes o JOIN cmds k ON k.seq = o.seq WHERE k.kind = '{_kind}'""",
                                  extra_ctes=_ACC + "," + _FOLD_CTES)

# the next snapshot rows and the activity of the applied commands, from the same fold
_API = [("firstName", "first_name"), ("lastName", "last_name"), ("email", "email"), ("phone", "phone"), ("company", "company")]
_JSTR = "CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || {x} || '\"' END"
_CHANGES = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN e.p_{f} AND e.b_{f} IS DISTINCT FROM e.n_{f} THEN "
    f"'\"{api}\":{{\"from\":' || {_JSTR.format(x=f'e.b_{f}')} || ',\"to\":' || {_JSTR.format(x=f'e.n_{f}')} || '}}' END"
    for api, f in _API) + "], lambda x: x IS NOT NULL), ',')"
ORACLE["apply_next_contacts"] = with_fixtures("""
    SELECT f.contact_id AS id, ct.account_id, f.s.version AS version, f.s.email AS email, f.s.phone AS phone, f.s.company AS company,
           f.s.last_name AS last_name, f.s.deleted AS trashed
    FROM folded f JOIN contacts ct ON ct.id = f.contact_id WHERE f.s.version <> ct.version""", extra_ctes=_ACC + "," + _FOLD_CTES)
APPLIED_ACTIVITY_SQL = f"""
    SELECT contact_id,
           CASE e.kind WHEN 'update' THEN 'CONTACT_UPDATED' WHEN 'delete' THEN 'CONTACT_DELETED' ELSE 'CONTACT_RESTORED' END AS type,
           CASE WHEN e.kind = 'update' THEN '{{"changes":{{' || {_CHANGES} || '}},"version":' || CAST(e.version AS VARCHAR) || '}}'
                ELSE '{{"version":' || CAST(e.version AS VARCHAR) || '}}' END AS payload
    FROM (SELECT f.contact_id, unnest(f.s.log) AS e FROM folded f) x WHERE e.outcome = 'APPLIED'"""
ORACLE["activity_emit"] = with_fixtures(APPLIED_ACTIVITY_SQL, extra_ctes=_ACC + "," + _FOLD_CTES)

_TAG_CMDS = f"""
per_cmd AS (
  SELECT seq, account_id, contact_id, lower(name) AS key, arg_min(name, pos) AS name, min(pos) AS pos
  FROM (SELECT x.seq, x.account_id, x.contact_id, u.pos, nullif({_TRIM.format(x='u.name')}, '') AS name
        FROM (SELECT v.event_id AS seq, v.account_id, v.user_id AS contact_id,
                     [' VIP', 'vip', 'Lead' || CAST(v.event_id % 3 AS VARCHAR), 'urgent'] AS names
              FROM ev v JOIN contacts c ON c.id = v.user_id AND c.account_id = v.account_id AND c.deleted_at IS NULL
              WHERE v.event_type = 'view') x,
             LATERAL (SELECT unnest(x.names[1:{C.MAX_TAGS}]) AS name, unnest(generate_series(0, len(x.names) - 1)) AS pos) u)
  WHERE name IS NOT NULL GROUP BY 1, 2, 3, 4
),
firsts AS (SELECT account_id, key, arg_min(name, (seq, pos)) AS first FROM per_cmd GROUP BY 1, 2)
"""
ORACLE["add_tags"] = with_fixtures("""
    SELECT contact_id, tag_name FROM (
      SELECT l.contact_id, coalesce(t.name, fs.first) AS tag_name,
             row_number() OVER (PARTITION BY l.contact_id, l.key ORDER BY l.seq, l.pos) AS k
      FROM per_cmd l
      JOIN firsts fs ON fs.account_id = l.account_id AND fs.key = l.key
      LEFT JOIN tags t ON t.account_id = l.account_id AND lower(t.name) = l.key
      WHERE t.id IS NULL OR NOT EXISTS (SELECT 1 FROM contact_tags ct WHERE ct.contact_id = l.contact_id AND ct.tag_id = t.id)
    ) WHERE k = 1""", extra_ctes=_ACC + "," + _TAG_CMDS)
ORACLE["tag_outcomes"] = with_fixtures("""
    SELECT ev.event_id AS seq, ev.user_id AS contact_id, CASE WHEN c.id IS NULL THEN 'NOT_FOUND' WHEN c.deleted_at IS NOT NULL THEN 'CONTACT_DELETED' ELSE 'APPLIED' END AS outcome,
           CASE WHEN ev.event_type = 'view' THEN coalesce(a.n, 0) END AS added_count
    FROM ev LEFT JOIN contacts c ON c.id = ev.user_id AND c.account_id = ev.account_id
    LEFT JOIN (SELECT seq, count(*) AS n FROM (
                 SELECT l.seq, row_number() OVER (PARTITION BY l.contact_id, l.key ORDER BY l.seq, l.pos) AS k
                 FROM per_cmd l LEFT JOIN tags t ON t.account_id = l.account_id AND lower(t.name) = l.key
                 WHERE t.id IS NULL OR NOT EXISTS (SELECT 1 FROM contact_tags ct WHERE ct.contact_id = l.contact_id AND ct.tag_id = t.id)) WHERE k = 1 GROUP BY seq) a ON a.seq = ev.event_id
    WHERE ev.event_type IN ('view', 'purchase')""", extra_ctes=_ACC + "," + _TAG_CMDS)
