"""Data-quality and activity metrics (A1–A14, A17, A19, W4, W5) for all tenants at once.

Every count is a grouped aggregate keyed by ``account_id`` (map-side partial
aggregation, so a tenant holding a third of the rows still shuffles one row
per map task). Windows only run over already-aggregated rows (≤ days × tags
per account) or with a rank limit that Spark applies before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolodeck.operators import predicates as P

# Fixed values
RANGES = (7, 30, 90)
TOP_TAGS = 10
ACTIVITY_TYPES = ("CONTACT_CREATED", "CONTACT_UPDATED", "CONTACT_DELETED", "CONTACT_RESTORED", "TAG_ADDED", "TAG_REMOVED")


def window_bounds(as_of: dt.datetime, range_days: int) -> tuple[dt.datetime, dt.datetime, dt.date, dt.date]:
    """(start, previous start, first day, last day): start is midnight UTC of
    ``as_of`` minus (range − 1) days; the previous window is [start − range, start)."""
    if range_days not in RANGES:
        raise ValueError(f"range must be one of {RANGES}")
    today = dt.datetime(as_of.year, as_of.month, as_of.day)
    start = today - dt.timedelta(days=range_days - 1)
    prev = start - dt.timedelta(days=range_days)
    return start, prev, start.date(), today.date()


def round1(x: Column) -> Column:
    """JavaScript Math.round(x·1000)/10 (halves toward +∞)."""
    return F.floor(x * 1000 + 0.5) / 10


def pct_or_zero(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; 0 when the denominator is 0."""
    return F.when(whole > 0, round1(part / whole)).otherwise(F.lit(0.0))


def utc_day(c) -> Column:
    """the UTC calendar day as 'yyyy-MM-dd' text."""
    return F.date_format(F.to_date(c), "yyyy-MM-dd")


# ---------------------------------------------------------------- A1 / A7


QUALITY_ORDER = ["active", "new_in_range", "new_prev", "with_email", "with_phone", "with_company", "no_contact", "untagged", "stale"]


def _quality_flags(contacts: DataFrame, contact_tags: DataFrame, as_of: dt.datetime, range_days: int,
                   include_trash: bool, *extra: Column) -> tuple[DataFrame, list[str]]:
    """Each contact reduced to its account, the boolean tests of the quality
    pack and ``_tagged``, so the join with the distinct linked ids (broadcast
    by AQE when small, else shuffled) moves a few bytes per contact, not the
    contact row. Returns the frame and the names of the tests."""
    start, prev, _, _ = window_bounds(as_of, range_days)
    active = P.is_active()
    tests = {
        "active": active,
        "new_in_range": active & (F.col("created_at") >= P.ts_lit(start)),
        "new_prev": active & (F.col("created_at") >= P.ts_lit(prev)) & (F.col("created_at") < P.ts_lit(start)),
        "with_email": active & F.col("email").isNotNull(),
        "with_phone": active & F.col("phone").isNotNull(),
        "with_company": active & F.col("company").isNotNull(),
        "no_contact": active & P.no_contact_info(),
        "stale": active & P.stale(as_of),
    }
    if include_trash:
        tests["in_trash"] = P.is_trashed()
    flags = contacts.select("id", "account_id", *extra, *[v.alias(f"_{k}") for k, v in tests.items()])
    tagged = contact_tags.select(F.col("contact_id").alias("id")).distinct().withColumn("_tagged", F.lit(True))
    out = flags.join(tagged, "id", "left").withColumn("_untagged", F.col("_active") & F.col("_tagged").isNull())
    names = [k for k in QUALITY_ORDER] + (["in_trash"] if include_trash else [])
    return out, names


def quality_pack(contacts: DataFrame, contact_tags: DataFrame, as_of: dt.datetime, range_days: int = 30,
                 include_trash: bool = False) -> DataFrame:
    """A1 (and A7 when ``include_trash``): one pass over contacts per account;
    the counts are map-side partial ``count_if`` over the boolean tests."""
    flags, names = _quality_flags(contacts, contact_tags, as_of, range_days, include_trash)
    out = flags.groupBy("account_id").agg(*[F.count_if(F.col(f"_{k}")).alias(k) for k in names])
    return out if include_trash else out.filter(F.col("active") > 0)


def trash_count(contacts: DataFrame) -> DataFrame:
    """Trashed contacts per account (accounts with none report 0)."""
    return contacts.groupBy("account_id").agg(F.count_if(P.is_trashed()).alias("n"))


# ---------------------------------------------------------------- A2 / A3 / A4


def created_by_day(contacts: DataFrame, as_of: dt.datetime, range_days: int = 30) -> DataFrame:
    """A2: active contacts created per UTC day since the range start."""
    start, _, _, _ = window_bounds(as_of, range_days)
    return (
        contacts.filter(P.is_active() & (F.col("created_at") >= P.ts_lit(start)))
        .groupBy("account_id", utc_day("created_at").alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def edits_by_day(activity: DataFrame, as_of: dt.datetime, range_days: int = 30) -> DataFrame:
    """A3: CONTACT_UPDATED events per UTC day (events of trashed contacts count)."""
    start, _, _, _ = window_bounds(as_of, range_days)
    return (
        activity.filter((F.col("type") == "CONTACT_UPDATED") & (F.col("created_at") >= P.ts_lit(start)))
        .groupBy("account_id", utc_day("created_at").alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def activity_by_type(activity: DataFrame, as_of: dt.datetime, range_days: int = 30) -> DataFrame:
    """A4: events per type in the range, ranked by count descending (ties by type)."""
    start, _, _, _ = window_bounds(as_of, range_days)
    counts = (
        activity.filter(F.col("created_at") >= P.ts_lit(start))
        .groupBy("account_id", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("account_id").orderBy(F.col("n").desc(), F.col("type"))
    return counts.withColumn("rank", F.row_number().over(w))


# ---------------------------------------------------------------- A5 / A6


def tag_link_join(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame) -> DataFrame:
    """Links of active contacts with their tag (tags are a small dimension)."""
    active_ids = contacts.filter(P.is_active()).select(F.col("id").alias("contact_id"))
    t = tags.select(F.col("id").alias("tag_id"), "account_id", "name")
    return contact_tags.select("contact_id", "tag_id").join(active_ids, "contact_id").join(t, "tag_id").select(
        "account_id", "tag_id", "name", "contact_id"
    )


def top_tags(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, k: int = TOP_TAGS) -> DataFrame:
    """A5: top ``k`` tags by active contact count; ties by lower(name), then id."""
    counts = (
        contact_tags.select("contact_id", "tag_id")
        .join(contacts.filter(P.is_active()).select(F.col("id").alias("contact_id")), "contact_id")
        .groupBy("tag_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    t = tags.select(F.col("id").alias("tag_id"), "account_id", "name")
    ranked = counts.join(t, "tag_id").withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("n").desc(), F.lower("name"), F.col("tag_id"))),
    )
    return ranked.filter(F.col("rank") <= k).select("account_id", "tag_id", "name", "n", "rank")


def duplicate_phone_groups(contacts: DataFrame) -> DataFrame:
    """Per account, groups of active contacts sharing phone digits and their size sum."""
    return P.shared_phone_keys(contacts).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("contacts")
    )


# ---------------------------------------------------------------- A8 / A9


def import_rollup(jobs: DataFrame, as_of: dt.datetime, range_days: int = 30) -> DataFrame:
    """Jobs created in range; sums over completed jobs (0 when none)."""
    start, _, _, _ = window_bounds(as_of, range_days)
    done = F.col("status") == "completed"

    def done_sum(c: str) -> Column:
        return F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long")

    return (
        jobs.filter(F.col("created_at") >= P.ts_lit(start))
        .groupBy("account_id")
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.count_if(done).alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            done_sum("created_count").alias("created"),
            done_sum("updated_count").alias("updated"),
            done_sum("unchanged_count").alias("unchanged"),
            done_sum("error_rows").alias("rejected"),
            done_sum("total_rows").alias("submitted"),
        )
    )


def metrics_ratios(quality: DataFrame, imports: DataFrame) -> DataFrame:
    """Change %, reachable, accept rate (null on a zero denominator) and
    completeness % (0 on a zero denominator)."""
    q = quality.alias("q")
    i = imports.select("account_id", "created", "updated", "unchanged", "submitted")
    j = q.join(i, "account_id", "left")
    accepted = F.col("created") + F.col("updated") + F.col("unchanged")
    return j.select(
        "account_id",
        F.when(F.col("new_prev") > 0, round1((F.col("new_in_range") - F.col("new_prev")) / F.col("new_prev"))).alias("change_pct"),
        (F.col("active") - F.col("no_contact")).alias("reachable"),
        F.when(F.coalesce(F.col("submitted"), F.lit(0)) > 0, round1(accepted / F.col("submitted"))).alias("accept_rate"),
        pct_or_zero(F.col("with_email"), F.col("active")).alias("email_pct"),
        pct_or_zero(F.col("with_phone"), F.col("active")).alias("phone_pct"),
        pct_or_zero(F.col("with_company"), F.col("active")).alias("company_pct"),
    )


# ---------------------------------------------------------------- A10 / A11 / W4


def daily_series(contacts: DataFrame, activity: DataFrame, as_of: dt.datetime, range_days: int = 30,
                 accounts: DataFrame | None = None) -> DataFrame:
    """A10: zero-filled days [as_of − (range − 1) … as_of] with created and edits.

    One pass per table: counts per (account, day in range), every other row
    in a null day so each account is listed, then per account a day → count
    map (≤ range days); the days are generated per account row and read off
    the two maps. Accounts are those with contacts or activity, or the given
    ``accounts``."""
    start, _, first, last = window_bounds(as_of, range_days)
    last_day = F.lit(last.isoformat())
    in_range = F.col("created_at") >= P.ts_lit(start)

    def day_map(df: DataFrame, counted: Column, name: str) -> DataFrame:
        per_day = df.groupBy("account_id", F.when(counted & in_range, utc_day("created_at")).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
        keep = F.col("_d").isNotNull() & (F.col("_d") <= last_day)
        return per_day.groupBy("account_id").agg(F.map_from_entries(F.collect_list(F.when(keep, F.struct("_d", "_n")))).alias(name))

    base = day_map(contacts, P.is_active(), "_cm").join(day_map(activity, F.col("type") == "CONTACT_UPDATED", "_em"), "account_id", "full")
    if accounts is not None:
        base = accounts.select("account_id").distinct().join(base, "account_id", "left")
    days = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return base.select("account_id", "_cm", "_em", F.explode(days).alias("date")).select(
        "account_id", "date",
        F.coalesce(F.col("_cm")[F.col("date")], F.lit(0)).cast("long").alias("created"),
        F.coalesce(F.col("_em")[F.col("date")], F.lit(0)).cast("long").alias("edits"),
    )


def trash_metrics(contacts: DataFrame, activity: DataFrame, as_of: dt.datetime, range_days: int = 30) -> DataFrame:
    """Current trash size; deleted and restored events in the range."""
    start, _, _, _ = window_bounds(as_of, range_days)
    ev = (
        activity.filter(F.col("created_at") >= P.ts_lit(start))
        .groupBy("account_id")
        .agg(
            F.count_if(F.col("type") == "CONTACT_DELETED").alias("deleted"),
            F.count_if(F.col("type") == "CONTACT_RESTORED").alias("restored"),
        )
    )
    cur = trash_count(contacts).withColumnRenamed("n", "current")
    return cur.join(ev, "account_id", "full").select(
        "account_id",
        F.coalesce("current", F.lit(0)).alias("current"),
        F.coalesce("deleted", F.lit(0)).alias("deleted"),
        F.coalesce("restored", F.lit(0)).alias("restored"),
    )


def active_trend(contacts: DataFrame, activity: DataFrame, as_of: dt.datetime, range_days: int = 30) -> DataFrame:
    """Active contacts at the end of each day = active now minus contacts
    created on later days (window over ≤ 90 aggregated rows per account)."""
    series = daily_series(contacts, activity, as_of, range_days)
    active = contacts.groupBy("account_id").agg(F.count_if(P.is_active()).alias("active_now"))
    later = Window.partitionBy("account_id").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    return series.join(active, "account_id").select(
        "account_id",
        "date",
        (F.col("active_now") - F.coalesce(F.sum("created").over(later), F.lit(0))).alias("active"),
    )


# ---------------------------------------------------------------- A12


def _activity_rollup(activity: DataFrame, start: dt.datetime) -> DataFrame:
    """One pass over activity: counts per (account, type, UTC day) in the range;
    events before the range collapse into one (account, type, null) row, so
    every account with activity is still listed."""
    in_range = F.col("created_at") >= P.ts_lit(start)
    return activity.groupBy("account_id", "type", F.when(in_range, utc_day("created_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


def _jobs_rollup(jobs: DataFrame, start: dt.datetime) -> DataFrame:
    """A8 over all accounts that have jobs (0 when none fall in the range)."""
    in_range = F.col("created_at") >= P.ts_lit(start)
    done = in_range & (F.col("status") == "completed")

    def done_sum(c: str) -> Column:
        return F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long")

    return jobs.groupBy("account_id").agg(
        F.count_if(in_range).alias("jobs"), F.count_if(done).alias("completed"),
        F.count_if(in_range & (F.col("status") == "failed")).alias("failed"),
        done_sum("created_count").alias("created"), done_sum("updated_count").alias("updated"),
        done_sum("unchanged_count").alias("unchanged"), done_sum("error_rows").alias("rejected"),
        done_sum("total_rows").alias("submitted"),
    )


def metrics_document(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, activity: DataFrame,
                     jobs: DataFrame, as_of: dt.datetime, range_days: int = 30) -> DataFrame:
    """The whole dashboard payload, one row per account.

    Each rollup has one consumer, so neither column pruning nor a pushed
    filter gives a branch its own scan: activity is scanned once (rolled up
    per account, type and day, then A3/A4/A11 are read off one per-account
    aggregate), jobs once, and contacts for the quality pack with the
    created-per-day map (A1+A7+A2), duplicate phones (A6) and the top tags
    (A5). The list of accounts is a full outer join of those aggregates, and
    the daily series is generated per account row from the window's day
    sequence and day → count maps. Arrays are built from already-aggregated
    rows (≤ 6 types × 90 days, ≤ 10 tags per account).
    """
    start, _, first, last = window_bounds(as_of, range_days)
    last_day = F.lit(last.isoformat())
    in_window = lambda day: day.isNotNull() & (day <= last_day)

    # contacts: the quality counts per (account, created day in range), then per account; the
    # created-per-day map (A2) comes from the same pass
    flags, names = _quality_flags(contacts, contact_tags, as_of, range_days, True,
                                  F.when(P.is_active() & (F.col("created_at") >= P.ts_lit(start)), utc_day("created_at")).alias("_day"))
    per_day = flags.groupBy("account_id", "_day").agg(*[F.count_if(F.col(f"_{k}")).alias(k) for k in names])
    q = per_day.groupBy("account_id").agg(
        *[F.sum(k).alias(k) for k in names],
        F.map_from_entries(F.collect_list(F.when(in_window(F.col("_day")), F.struct("_day", "active")))).alias("_cm"))

    # activity: one rollup per (account, type, day in range), read by one per-account aggregate; the
    # per-type counts, the edits map and the trash counts come off bounded arrays (types × days)
    roll = _activity_rollup(activity, start)
    in_range = F.col("day").isNotNull()
    act = roll.groupBy("account_id").agg(
        F.collect_list(F.when(in_range, F.struct("type", "n"))).alias("_tn"),
        F.map_from_entries(F.collect_list(F.when((F.col("type") == "CONTACT_UPDATED") & in_window(F.col("day")),
                                                 F.struct("day", "n")))).alias("_em"))

    def type_total(t) -> Column:
        return F.aggregate(F.filter("_tn", lambda x: x["type"] == t), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])

    types = F.array_distinct(F.transform("_tn", lambda x: x["type"]))
    # by count descending, then type: sort on (−count, type)
    ranked = F.array_sort(F.transform(types, lambda t: F.struct((-type_total(t)).alias("k"), t.alias("type"))))
    act = act.select(
        "account_id", "_em",
        F.transform(ranked, lambda r: F.struct(r["type"].alias("type"), (-r["k"]).alias("count"))).alias("_a"),
        type_total(F.lit("CONTACT_DELETED")).alias("_del"), type_total(F.lit("CONTACT_RESTORED")).alias("_res"))

    dup = duplicate_phone_groups(contacts)
    imp = _jobs_rollup(jobs, start)
    # every account with contacts, activity or jobs
    base = q.join(imp, "account_id", "full").join(act, "account_id", "full")

    # the zero-filled daily series, read along the window's days from the two day → count maps
    days = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda d: F.date_format(d, "yyyy-MM-dd"))
    daily = F.transform(days, lambda d: F.struct(
        d.alias("date"), F.coalesce(F.col("_cm")[d], F.lit(0)).cast("long").alias("created"),
        F.coalesce(F.col("_em")[d], F.lit(0)).cast("long").alias("edits")))
    tt = top_tags(contacts, tags, contact_tags).groupBy("account_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", F.col("n").alias("count")))).alias("_t")
    )

    j = base.join(dup, "account_id", "left").join(tt, "account_id", "left").withColumn("daily", daily)

    def z(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("long")

    accepted = z("created") + z("updated") + z("unchanged")
    return j.select(
        "account_id",
        F.lit(range_days).alias("range"),
        F.struct(
            z("active").alias("active"),
            z("new_in_range").alias("newInRange"),
            z("new_prev").alias("newPrevRange"),
            F.when(z("new_prev") > 0, round1((z("new_in_range") - z("new_prev")) / z("new_prev"))).alias("changePct"),
            z("in_trash").alias("inTrash"),
        ).alias("contacts"),
        F.struct(
            z("with_email").alias("withEmail"),
            z("with_phone").alias("withPhone"),
            z("with_company").alias("withCompany"),
            z("no_contact").alias("noContactInfo"),
            (z("active") - z("no_contact")).alias("reachable"),
            z("untagged").alias("untagged"),
            z("stale").alias("stale"),
            F.lit(P.STALE_DAYS).alias("staleDays"),
            z("contacts").alias("duplicatePhoneContacts"),
            z("groups").alias("duplicatePhoneGroups"),
        ).alias("quality"),
        F.coalesce(F.transform("_t", lambda s: F.struct(s["name"].alias("name"), s["count"].alias("count"))),
                   F.array().cast("array<struct<name:string,count:bigint>>")).alias("tags"),
        "daily",
        F.coalesce(F.transform("_a", lambda s: F.struct(s["type"].alias("type"), s["count"].alias("count"))),
                   F.array().cast("array<struct<type:string,count:bigint>>")).alias("activity"),
        F.struct(z("in_trash").alias("current"), z("_del").alias("deletedInRange"), z("_res").alias("restoredInRange")).alias("trash"),
        F.struct(
            z("jobs").alias("jobs"),
            z("completed").alias("completed"),
            z("failed").alias("failed"),
            z("created").alias("rowsCreated"),
            z("updated").alias("rowsUpdated"),
            z("rejected").alias("rowsRejected"),
            z("submitted").alias("rowsSubmitted"),
            F.when(z("submitted") > 0, round1(accepted / z("submitted"))).alias("acceptRate"),
        ).alias("imports"),
    )


# ---------------------------------------------------------------- A13 / A14 / A17 / A19


def bounded_count(df: DataFrame, cap: int = 10_000) -> DataFrame:
    """Count capped at ``cap`` with a flag; reads at most cap + 1 rows."""
    n = df.select(F.lit(1).alias("one")).limit(cap + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least(F.col("n"), F.lit(cap)).cast("long").alias("total"), (F.col("n") > cap).alias("total_capped"))


def attention_counts(contacts: DataFrame, contact_tags: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The four attention counts, from the same predicates as the lists."""
    q = quality_pack(contacts, contact_tags, as_of, 30)
    dup = duplicate_phone_groups(contacts)
    per = q.join(dup, "account_id", "left").select(
        "account_id",
        F.col("no_contact"),
        F.col("untagged"),
        F.col("stale"),
        F.coalesce(F.col("contacts"), F.lit(0)).cast("long").alias("duplicate_phone"),
    )
    return per.select(
        "account_id",
        F.explode(
            F.array(
                F.struct(F.lit("no_contact_info").alias("filter"), F.col("no_contact").alias("n")),
                F.struct(F.lit("untagged").alias("filter"), F.col("untagged").alias("n")),
                F.struct(F.lit("stale").alias("filter"), F.col("stale").alias("n")),
                F.struct(F.lit("duplicate_phone").alias("filter"), F.col("duplicate_phone").alias("n")),
            )
        ).alias("x"),
    ).select("account_id", "x.filter", "x.n")


def accounts_overview(contacts: DataFrame) -> DataFrame:
    """Rows per account."""
    return contacts.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))


def saved_view_counts(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Chip counts – All, the top 3 tags, Untagged, No contact info."""
    q = quality_pack(contacts, contact_tags, as_of, 30)
    base = q.select(
        "account_id",
        F.explode(
            F.array(
                F.struct(F.lit("All").alias("view"), F.col("active").alias("n")),
                F.struct(F.lit("Untagged").alias("view"), F.col("untagged").alias("n")),
                F.struct(F.lit("No contact info").alias("view"), F.col("no_contact").alias("n")),
            )
        ).alias("x"),
    ).select("account_id", "x.view", "x.n")
    tag_views = top_tags(contacts, tags, contact_tags, 3).select("account_id", F.col("name").alias("view"), "n")
    return base.unionByName(tag_views)


# ---------------------------------------------------------------- W5


def latest_activity_per_contact(activity: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` events per contact (created_at desc, id desc).

    ``row_number() <= n`` lets Spark insert a per-partition group limit before
    the shuffle, so a contact with millions of events ships only ``n`` rows
    per map task.
    """
    n = min(max(n, 1), 100)
    w = Window.partitionBy("contact_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (
        activity.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select("contact_id", "rank", "id", "type", "payload", "created_at")
    )
