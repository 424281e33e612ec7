"""Import jobs: confirm, cancel, and runs that break off."""

import datetime as dt
import tempfile

from conftest import make_contacts, make_links, make_tags
from pyspark.sql import functions as F

from rolodeck.operators import importing as I
from rolodeck.operators import importjobs as J

NOW = dt.datetime(2025, 1, 1, 12)
T0 = dt.datetime(2024, 12, 1)


def _judge(spark, jobs, requests):
    j = spark.createDataFrame(jobs, "id long, account_id int, status string, valid_rows int")
    r = spark.createDataFrame(requests, "seq long, account_id int, job_id long, action string")
    out = J.judge_requests(j, r)
    return {x.seq: (x.outcome, x.message) for x in out["outcomes"].collect()}, {x.id: x.status for x in out["jobs"].collect()}


def test_requests_by_the_table_of_transitions(spark):
    jobs = [(1, 0, "ready", 5), (2, 0, "validating", 0), (3, 0, "ready", 0), (4, 0, "completed", 5), (5, 0, "importing", 5), (6, 0, "ready", 5)]
    got, changed = _judge(spark, jobs, [
        (1, 0, 1, "confirm"), (2, 0, 1, "confirm"), (3, 0, 1, "cancel"),      # once, then it is importing
        (4, 0, 2, "confirm"), (5, 0, 2, "cancel"), (6, 0, 2, "cancel"),       # too early, then cancelled
        (7, 0, 3, "confirm"), (8, 0, 3, "cancel"), (9, 0, 3, "confirm"),
        (10, 0, 4, "cancel"), (11, 0, 5, "confirm"), (12, 1, 6, "confirm"), (13, 0, 99, "cancel"), (14, 0, None, "confirm")])
    assert changed == {1: "importing", 2: "cancelled", 3: "cancelled"}
    assert got == {
        1: ("APPLIED", None), 2: ("IMPORT_NOT_READY", "This import is importing, so it can't be started"), 3: ("IMPORT_NOT_CANCELLABLE", "This import is importing, so it can't be cancelled"),
        4: ("IMPORT_NOT_READY", "This import is validating, so it can't be started"), 5: ("APPLIED", None), 6: ("IMPORT_NOT_CANCELLABLE", "This import is cancelled, so it can't be cancelled"),
        7: ("NOTHING_TO_IMPORT", "There are no valid rows to import"), 8: ("APPLIED", None), 9: ("IMPORT_NOT_READY", "This import is cancelled, so it can't be started"),
        10: ("IMPORT_NOT_CANCELLABLE", "This import is completed, so it can't be cancelled"), 11: ("IMPORT_NOT_READY", "This import is importing, so it can't be started"),
        12: ("NOT_FOUND", None), 13: ("NOT_FOUND", None), 14: ("NOT_FOUND", None)}


def test_requests_as_one_after_another(spark):
    import random

    rng = random.Random(5)
    jobs = [(i, i % 2, rng.choice(["ready", "validating", "failed", "completed", "importing", "cancelled"]), rng.choice([0, 3])) for i in range(60)]
    requests = [(s, rng.choice([0, 1, 1]), rng.choice([0, rng.randrange(70)]), rng.choice(["confirm", "cancel"])) for s in range(600)]  # job 0 is hot
    state, want = {i: [a, s, v] for i, a, s, v in jobs}, {}
    for seq, account, job, action in requests:
        s = state.get(job)
        if s is None or s[0] != account:
            want[seq] = "NOT_FOUND"
        elif action == "confirm" and s[1] == "ready":
            want[seq] = "APPLIED" if s[2] else "NOTHING_TO_IMPORT"
            s[1] = "importing" if s[2] else s[1]
        elif action == "cancel" and s[1] in ("ready", "validating"):
            want[seq], s[1] = "APPLIED", "cancelled"
        else:
            want[seq] = {"confirm": "IMPORT_NOT_READY", "cancel": "IMPORT_NOT_CANCELLABLE"}[action]
    got, changed = _judge(spark, jobs, requests)
    assert {k: o for k, (o, _) in got.items()} == want
    assert changed == {i: state[i][1] for i, _, s, _ in jobs if state[i][1] != s}


def _inputs(spark):
    contacts = make_contacts(spark, [dict(id=i, first="F", last=str(i), email=f"c{i}@x.io", company="Old", created=T0) for i in range(30)])
    tags, links = make_tags(spark, [(1, 0, "VIP")]), make_links(spark, [(0, 1)])
    files = [("a.csv", 1, 0, "create", ["first name", "last name", "email", "tags"]), ("b.csv", 2, 0, "create", ["first name", "last name", "email", "tags"]), ("u.csv", 3, 0, "update", ["email", "company", "tags"])]
    rows = [("a.csv", 1, 0, "create", n, ["A", str(n), f"a{n}@x.io" if n % 5 else f"c{n}@x.io" if n % 2 else "bad", "vip;New"]) for n in range(1, 26)]
    rows += [("b.csv", 2, 0, "create", n, ["B", str(n), f"a{n + 10}@x.io", f"New;t{n % 3}"]) for n in range(1, 26)]  # some are the first job's
    rows += [("u.csv", 3, 0, "update", n, [f"c{n}@x.io", "Old" if n % 4 == 0 else "Newer", "VIP" if n % 3 else ""]) for n in range(1, 26)]
    f = spark.createDataFrame([(*x, x[0], False) for x in files], "file string, job_id long, account_id int, mode string, header array<string>, filename string, invalid boolean")
    r = spark.createDataFrame([(*x, False) for x in rows], "file string, job_id long, account_id int, mode string, row_number long, cells array<string>, invalid boolean")
    rev = I.review(r, f, contacts).checkpoint()
    summary = I.job_summary(rev, f, r).withColumn("status", F.lit("importing"))
    return rev, summary, contacts, tags, links


def _end(runs, rev, summary, contacts, tags, links):
    names = {i: n for i, n in runs.over("tags", tags.withColumn("id", F.col("id").cast("long")), ["id"]).select("id", "name").collect()}
    now = runs.over("contacts", contacts, ["id"])
    linked = runs.over("links", links.withColumn("tag_id", F.col("tag_id").cast("long")), ["contact_id", "tag_id"])
    return (sorted(map(tuple, J.job_counters(runs, summary).collect())), sorted(map(tuple, now.select("id", "email", "company", "version").collect())),
            sorted((r.contact_id, names[r.tag_id]) for r in linked.collect()), sorted(map(tuple, runs.read("activity").select("contact_id", "type").collect())),
            sorted(map(tuple, runs.read("errors").select("job_id", "row_number", "message").collect())))


def test_an_interrupted_import_ends_like_an_uninterrupted_one(spark):
    rev, summary, contacts, tags, links = _inputs(spark)
    once = J.Runs(spark, tempfile.mkdtemp(prefix="runs-"))
    assert J.run(once, rev, summary, contacts, tags, links, NOW, chunk=7) and not J.run(once, rev, summary, contacts, tags, links, NOW, chunk=7)
    broken = J.Runs(spark, tempfile.mkdtemp(prefix="runs-"))
    n = 0
    J.run(broken, rev, summary, contacts, tags, links, NOW, max_chunks=3, chunk=7, commit=False)  # breaks off: nothing of it counts
    assert broken.committed() == [] and broken.read("ledger") is None
    while J.run(broken, rev, summary, contacts, tags, links, NOW, max_chunks=5, chunk=7):
        n += 1
        counters = {r.job_id: (r.processed, r.status) for r in J.job_counters(broken, summary).collect()}
        assert sum(p for p, _ in counters.values()) == min(75, {1: 32, 2: 64}.get(n, 75))
    assert n == 3 and _end(broken, rev, summary, contacts, tags, links) == _end(once, rev, summary, contacts, tags, links)
    counters = {r.job_id: r for r in J.job_counters(once, summary).collect()}
    assert all(c.status == "completed" and c.processed == 25 == c.created + c.updated + c.unchanged + c.error_rows for c in counters.values())
    assert counters[2].error_rows > 0 and counters[3].unchanged > 0


def test_only_importing_jobs_are_applied(spark):
    rev, summary, contacts, tags, links = _inputs(spark)
    runs = J.Runs(spark, tempfile.mkdtemp(prefix="runs-"))
    held = summary.withColumn("status", F.when(F.col("job_id") == 2, "cancelled").otherwise("ready"))
    assert not J.run(runs, rev, held, contacts, tags, links, NOW)
    got = {r.job_id: (r.processed, r.status) for r in J.job_counters(runs, held).collect()}
    assert got == {1: (0, "ready"), 2: (0, "cancelled"), 3: (0, "ready")}
