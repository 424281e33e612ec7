"""Command batches: version race, delete/restore rules, bulk operations, tags, merge."""

import datetime as dt
import random

from conftest import make_contacts, make_links, make_tags
from pyspark.sql import functions as F

from rolodeck.operators import changes as C

NOW = dt.datetime(2025, 1, 1, 12)
T0 = dt.datetime(2024, 12, 1)
CMD_SCHEMA = ("seq long, account_id int, contact_id long, kind string, expected_version int, "
              "first_name string, first_name_set boolean, last_name string, last_name_set boolean, email string, email_set boolean, "
              "phone string, phone_set boolean, company string, company_set boolean")


def cmd(seq, contact, kind, version, account=0, **fields):
    row = [seq, account, contact, kind, version]
    for f in ["first_name", "last_name", "email", "phone", "company"]:
        row += [fields.get(f), f in fields]
    return tuple(row)


def outcomes(spark, contacts, cmds):
    out = C.apply_commands(contacts, spark.createDataFrame(cmds, CMD_SCHEMA), NOW)
    return {r.seq: (r.outcome, r.version) for r in out["outcomes"].collect()}, out


def test_four_racing_updates_one_wins(spark):
    c = make_contacts(spark, [dict(id=1, first="Ada", last="L", company="A", created=T0)])
    got, out = outcomes(spark, c, [cmd(i, 1, "update", 1, company=f"Co{i}") for i in range(1, 5)])
    assert [got[i][0] for i in range(1, 5)] == ["APPLIED", "VERSION_CONFLICT", "VERSION_CONFLICT", "VERSION_CONFLICT"]
    row = out["next_contacts"].first()
    assert row.version == 2 and row.company == "Co1"
    ev = out["activity"].first()
    assert ev.type == "CONTACT_UPDATED" and ev.payload == '{"changes":{"company":{"from":"A","to":"Co1"}},"version":2}'


def test_chained_versions_and_noop(spark):
    c = make_contacts(spark, [dict(id=1, first="Ada", last="L", phone="555 0101", created=T0)])
    got, _ = outcomes(spark, c, [cmd(1, 1, "update", 1, phone="555 0102"), cmd(2, 1, "update", 2, phone="555 0102"), cmd(3, 1, "update", 2, phone="555 0103"),
                                 cmd(4, 1, "update", 3, phone=" 555 0103 ")])
    assert got == {1: ("APPLIED", 2), 2: ("NO_CHANGE", 2), 3: ("APPLIED", 3), 4: ("NO_CHANGE", 3)}


def test_delete_restore_rules(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="L", email="a@x.io", created=T0),
                              dict(id=2, first="B", last="L", email="b@x.io", created=T0, deleted=T0, version=2)])
    got, out = outcomes(spark, c, [
        cmd(1, 1, "delete", 1), cmd(2, 1, "delete", 5),     # second delete is idempotent before the version check
        cmd(3, 1, "update", 2, company="X"),                # trashed: refused
        cmd(4, 2, "restore", 9),                            # version conflict
        cmd(5, 2, "restore", 2), cmd(6, 2, "restore", 3),   # applied, then already active
        cmd(7, 9, "delete", 1), cmd(8, 1, "delete", 1, account=1),  # missing / other tenant
    ])
    assert got[1] == ("APPLIED", 2) and got[2] == ("ALREADY_DELETED", 2) and got[3] == ("CONTACT_DELETED", 2)
    assert got[4] == ("VERSION_CONFLICT", 2) and got[5] == ("APPLIED", 3) and got[6] == ("ALREADY_ACTIVE", 3)
    assert got[7][0] == "NOT_FOUND" and got[8][0] == "NOT_FOUND"
    types = sorted(r.type for r in out["activity"].collect())
    assert types == ["CONTACT_DELETED", "CONTACT_RESTORED"]


def test_restore_refused_while_email_is_taken(spark):
    c = make_contacts(spark, [dict(id=1, first="Old", last="One", email="same@x.io", created=T0, deleted=T0, version=2),
                              dict(id=2, first="New", last="One", email="same@x.io", created=T0)])
    got, _ = outcomes(spark, c, [cmd(1, 1, "restore", 2)])
    assert got[1][0] == "EMAIL_TAKEN"
    c2 = make_contacts(spark, [dict(id=1, first="Old", last="One", email="same@x.io", created=T0, deleted=T0, version=2),
                               dict(id=2, first="New", last="One", email="same@x.io", created=T0, deleted=T0, version=2)])
    got, _ = outcomes(spark, c2, [cmd(1, 1, "restore", 2), cmd(2, 2, "restore", 2)])
    assert sorted(v[0] for v in got.values()) == ["APPLIED", "EMAIL_TAKEN"]  # two racing restores: one wins


def test_update_email_taken(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="L", email="a@x.io", created=T0),
                              dict(id=2, first="B", last="L", email="b@x.io", created=T0)])
    got, _ = outcomes(spark, c, [cmd(1, 1, "update", 1, email=" B@X.io ")])
    assert got[1][0] == "EMAIL_TAKEN"


def test_create_arbitration(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="L", email="a@x.io", created=T0)])
    cmds = spark.createDataFrame([(1, 0, -1, "X", "Y", "A@x.io ", None, None), (2, 0, -2, "X", "Y", "n@x.io", None, None),
                                  (3, 0, -3, "X", "Y", "N@x.io", None, None), (4, 0, -4, " X ", "Y", "  ", None, None)],
                                 "seq long, account_id int, new_id long, first_name string, last_name string, email string, phone string, company string")
    out = C.apply_create(c, cmds, NOW)
    got = {r.seq: r.outcome for r in out["outcomes"].collect()}
    assert got == {1: "EMAIL_TAKEN", 2: "APPLIED", 3: "EMAIL_TAKEN", 4: "APPLIED"}
    assert {r.id: (r.first_name, r.email) for r in out["new_contacts"].collect()} == {-2: ("X", "n@x.io"), -4: ("X", None)}


def test_bulk_tag_counts(spark):
    own = [dict(id=i, first="A", last=str(i), created=T0) for i in range(1, 6)]
    c = make_contacts(spark, own + [dict(id=6, first="F", last="F", created=T0, account=1)])
    t = make_tags(spark, [(1, 0, "VIP")])
    ct = make_links(spark, [(1, 1)])
    req = spark.createDataFrame([(0, i, "vip") for i in [1, 2, 3, 4, 5, 6, 99, 1]], "account_id int, id long, tag_name string")
    rep = C.bulk_tag(c, t, ct, req, NOW)["report"].first().asDict()
    assert rep == dict(account_id=0, requested=7, matched=5, added=4, already_tagged=1, not_found=2)


def test_bulk_tag_returns_new_tags(spark):
    c = make_contacts(spark, [dict(id=i, first="A", last=str(i), created=T0) for i in (1, 2)])
    t = make_tags(spark, [(1, 0, "VIP")])
    req = spark.createDataFrame([(1, 0, 1, "vip"), (2, 0, 1, "Lead"), (3, 0, 2, "LEAD"), (4, 0, 99, "Ghost")],
                                "request_id int, account_id int, id long, tag_name string")
    out = C.bulk_tag(c, t, make_links(spark, []), req, NOW)
    new = {r.name: r.id for r in out["new_tags"].collect()}
    assert set(new) == {"Lead", "Ghost"}  # the first spelling; a request without a contact still creates its tag
    assert sorted((r.contact_id, r.tag_id) for r in out["new_links"].collect()) == sorted([(1, 1), (1, new["Lead"]), (2, new["Lead"])])


def test_bulk_delete_twice(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="1", created=T0), dict(id=2, first="A", last="2", created=T0),
                              dict(id=3, first="A", last="3", created=T0), dict(id=4, first="A", last="4", created=T0, deleted=T0),
                              dict(id=5, first="F", last="5", created=T0, account=1)])
    req = spark.createDataFrame([(0, i) for i in [1, 2, 3, 4, 5, 99, 1]], "account_id int, id long")
    out = C.bulk_delete(c, req, NOW)
    assert out["report"].first().asDict() == dict(account_id=0, requested=6, deleted=3, already_in_trash=1, not_found=2)
    nxt = c.join(out["next_contacts"].select("id"), "id", "left_anti").unionByName(out["next_contacts"])
    again = C.bulk_delete(nxt, req, NOW)["report"].first().asDict()
    assert (again["deleted"], again["already_in_trash"]) == (0, 4)


def test_add_and_remove_tags(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="1", created=T0), dict(id=2, first="B", last="2", created=T0, deleted=T0)])
    t = make_tags(spark, [(1, 0, "VIP")])
    ct = make_links(spark, [(1, 1)])
    cmds = spark.createDataFrame([(1, 0, 1, [" vip", "Lead", "LEAD", "new"]), (2, 0, 2, ["x"])],
                                 "seq long, account_id int, contact_id long, names array<string>")
    out = C.add_tags(c, t, ct, cmds, NOW)
    got = {r.seq: (r.outcome, r.added_count) for r in out["outcomes"].collect()}
    assert got == {1: ("APPLIED", 2), 2: ("CONTACT_DELETED", 0)}
    assert sorted(r.name for r in out["new_tags"].collect()) == ["Lead", "new"]
    rm = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 1, 1), (3, 1, 1, 1)], "seq long, account_id int, contact_id long, tag_id int")
    res = C.remove_tag(c, t, ct, rm, NOW)
    assert res["contact_tags"].count() == 0
    assert [r.contact_id for r in res["activity"].collect()] == [1]  # one event per link that was there, not per command
    assert {r.seq: r.outcome for r in res["outcomes"].collect()} == {1: "APPLIED", 2: "APPLIED", 3: "NOT_FOUND"}


def test_remove_tag_of_a_trashed_contact_is_refused(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="1", created=T0, deleted=T0)])
    res = C.remove_tag(c, make_tags(spark, [(1, 0, "VIP")]), make_links(spark, [(1, 1)]),
                       spark.createDataFrame([(1, 0, 1, 1)], "seq long, account_id int, contact_id long, tag_id int"), NOW)
    assert res["contact_tags"].count() == 1 and res["activity"].count() == 0
    assert [r.outcome for r in res["outcomes"].collect()] == ["CONTACT_DELETED"]


def test_more_than_twenty_names_are_refused_whole(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="1", created=T0)])
    cmds = spark.createDataFrame([(1, 0, 1, [f"t{i}" for i in range(21)]), (2, 0, 1, [f"u{i}" for i in range(20)])],
                                 "seq long, account_id int, contact_id long, names array<string>")
    out = C.add_tags(c, make_tags(spark, [(1, 0, "VIP")]), make_links(spark, [(1, 1)]), cmds, NOW)
    assert {r.seq: (r.outcome, r.added_count) for r in out["outcomes"].collect()} == {1: ("TOO_MANY_TAGS", 0), 2: ("APPLIED", 20)}
    assert out["new_links"].count() == 20


def test_three_way_merge(spark):
    base = make_contacts(spark, [dict(id=1, first="A", last="L", phone="1", company="Old", created=T0)])
    mine = make_contacts(spark, [dict(id=1, first="A", last="L", phone="2", company="Mine", created=T0)])
    latest = make_contacts(spark, [dict(id=1, first="A", last="L", phone="2", company="Theirs", created=T0)])
    got = {r.field: (r.original, r.latest, r.mine, r.clash) for r in C.three_way_merge(base, mine, latest, ["phone", "company"]).collect()}
    assert got == {"phone": ("1", "2", "2", False), "company": ("Old", "Theirs", "Mine", True)}


def test_hot_contact_chain_streams_across_batches(spark):
    # one contact with 3,000 commands (every version read by three racing clients)
    # and a second contact interleaved; Arrow batches of 64 rows split both chains
    c = make_contacts(spark, [dict(id=1, first="A", last="L", company="A", created=T0),
                              dict(id=2, first="B", last="L", company="B", created=T0)])
    cmds = [cmd(i + 1, 1, "update", 1 + i // 3, company=f"C{i}") for i in range(3000)]
    cmds += [cmd(10_000 + i, 2, "delete" if i % 2 == 0 else "restore", 1 + i) for i in range(50)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got, out = outcomes(spark, c, cmds)
        nxt = {r.id: r for r in out["next_contacts"].collect()}
        n_events = out["activity"].count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for i in range(3000):
        want = ("APPLIED", 2 + i // 3) if i % 3 == 0 else ("VERSION_CONFLICT", 2 + i // 3)
        assert got[i + 1] == want, (i, got[i + 1])
    assert all(got[10_000 + i] == ("APPLIED", 2 + i) for i in range(50))
    assert nxt[1].version == 1001 and nxt[1].company == "C2997" and nxt[1].deleted_at is None
    assert nxt[2].version == 51 and nxt[2].deleted_at is None
    assert n_events == 1000 + 50


def test_foreign_account_commands_do_not_touch_the_chain(spark):
    # contact 1 is in account 0; account 1's commands for it are NOT_FOUND, sit inside the
    # chain without breaking it, and their e-mail claim does not beat contact 2's
    c = make_contacts(spark, [dict(id=1, first="A", last="L", company="A", created=T0),
                              dict(id=2, first="B", last="L", created=T0)])
    got, out = outcomes(spark, c, [
        cmd(1, 1, "update", 1, company="X"),
        cmd(2, 1, "update", 2, account=1, email="new@x.io"),
        cmd(3, 1, "update", 2, company="Y"),
        cmd(4, 2, "update", 1, email="new@x.io"),
    ])
    assert got == {1: ("APPLIED", 2), 2: ("NOT_FOUND", None), 3: ("APPLIED", 3), 4: ("APPLIED", 2)}
    assert {r.id: (r.version, r.company, r.email) for r in out["next_contacts"].collect()} == {1: (3, "Y", None), 2: (2, None, "new@x.io")}


def test_bulk_result_sets_per_request(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="L", created=T0), dict(id=2, first="B", last="L", created=T0, deleted=T0),
                              dict(id=3, first="C", last="L", created=T0, account=1)])
    reqs = [("r1", 0, 1), ("r1", 0, 2), ("r1", 0, 2), ("r1", 0, 3), ("r2", 0, 9)] + [("big", 0, i) for i in range(1001)]
    out = C.bulk_result_sets(c, spark.createDataFrame(reqs, "request_id string, account_id int, id long"))
    got = {r.request_id: (r.requested, r.refused, r.ids, r.affected) for r in out.collect()}
    # id 3 belongs to another account; r2 matches nothing; a request of more than 1,000 ids is refused
    assert got == {"r1": (3, False, [1, 2], 1), "r2": (1, False, [], 0), "big": (1001, True, None, None)}


def test_bulk_requests_apply_in_request_order(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="1", created=T0), dict(id=2, first="A", last="2", created=T0),
                              dict(id=3, first="A", last="3", created=T0, deleted=T0)])
    req = spark.createDataFrame([("a", 0, 1), ("a", 0, 3), ("b", 0, 1), ("b", 0, 2), ("b", 0, 9)], "request_id string, account_id int, id long")
    out = C.bulk_delete(c, req, NOW)
    rep = {r.request_id: (r.requested, r.deleted, r.already_in_trash, r.not_found) for r in out["report"].collect()}
    # request a trashes 1; b finds 1 already in the trash, trashes 2 and does not find 9
    assert rep == {"a": (2, 1, 1, 0), "b": (3, 1, 1, 1)}
    assert sorted(r.id for r in out["next_contacts"].collect()) == [1, 2] and out["activity"].count() == 2
    t, ct = make_tags(spark, [(1, 0, "VIP")]), make_links(spark, [(2, 1)])
    treq = spark.createDataFrame([("a", 0, 1, "vip"), ("b", 0, 1, "VIP"), ("b", 0, 2, "vip")],
                                 "request_id string, account_id int, id long, tag_name string")
    tout = C.bulk_tag(c, t, ct, treq, NOW)
    trep = {r.request_id: (r.requested, r.matched, r.added, r.already_tagged) for r in tout["report"].collect()}
    assert trep == {"a": (1, 1, 1, 0), "b": (2, 2, 0, 2)}


VALUES = ("first_name", "last_name", "email", "phone", "company")


def serially(contacts, cmds):
    """The batch command by command: (outcome, version) by seq, and the states left. contacts: id -> [version, deleted, fields]."""
    state = {i: [v[0], v[1], dict(v[2])] for i, v in contacts.items()}
    got = {}
    for seq, account, i, kind, version, *values in sorted(cmds, key=lambda c: c[0]):
        new = {f: values[2 * k] for k, f in enumerate(VALUES) if values[2 * k + 1]}
        if i not in state or account:
            got[seq] = ("NOT_FOUND", None)
            continue
        s = state[i]
        wanted = new.get("email") if kind == "update" else s[2]["email"] if kind == "restore" else None
        if kind != "restore" and s[1]:
            out = "CONTACT_DELETED" if kind == "update" else "ALREADY_DELETED"
        elif kind == "restore" and not s[1]:
            out = "ALREADY_ACTIVE"
        elif version != s[0]:
            out = "VERSION_CONFLICT"
        elif kind == "update" and all(s[2][f] == v for f, v in new.items()):
            out = "NO_CHANGE"
        elif wanted and any(j != i and not o[1] and o[2]["email"] == wanted for j, o in state.items()):
            out = "EMAIL_TAKEN"
        else:
            out = "APPLIED"
            s[0] += 1
            s[1] = kind == "delete" if kind != "update" else s[1]
            s[2].update(new)
        got[seq] = (out, s[0])
    return got, state


def check_serial(spark, people, cmds, **sizes):
    """people: id -> [version, deleted, fields]; the batch gives the outcomes, states and events of the serial replay."""
    c = make_contacts(spark, [dict(id=i, first="A", last=str(i), created=T0, version=v[0], email=v[2].get("email"), company=v[2].get("company"), **(dict(deleted=T0) if v[1] else {}))
                              for i, v in people.items()])
    start = {i: [v[0], v[1], {"first_name": "A", "last_name": str(i), "email": None, "phone": None, "company": None, **v[2]}] for i, v in people.items()}
    want, states = serially(start, cmds)
    out = C.apply_commands(c, spark.createDataFrame(cmds, CMD_SCHEMA), NOW, **sizes)
    assert {r.seq: (r.outcome, r.version) for r in out["outcomes"].collect()} == want
    nxt = {r.id: [r.version, r.deleted_at is not None, {f: r[f] for f in VALUES}] for r in out["next_contacts"].collect()}
    assert nxt == {i: s for i, s in states.items() if s[0] != start[i][0]}
    assert out["activity"].count() == sum(o == "APPLIED" for o, _ in want.values())
    return want


def test_failed_command_claims_no_email(spark):
    c = make_contacts(spark, [dict(id=i, first="A", last=str(i), created=T0) for i in (1, 2, 3)])
    cmds = [cmd(1, 1, "update", 9, email="new@x.io"),   # stale: must not block the next one
            cmd(2, 2, "update", 1, email="new@x.io"),
            cmd(3, 3, "update", 1, email="new@x.io"),   # loses, so its contact stays at version 1
            cmd(4, 3, "update", 2, email="b@x.io"),     # stale for that reason
            cmd(5, 1, "update", 1, email="b@x.io")]
    got, _ = outcomes(spark, c, cmds)
    assert got == {1: ("VERSION_CONFLICT", 1), 2: ("APPLIED", 2), 3: ("EMAIL_TAKEN", 1), 4: ("VERSION_CONFLICT", 1), 5: ("APPLIED", 2)}


def test_email_released_and_retaken_in_one_batch(spark):
    people = {i: [1, False, {"email": f"p{i}@x.io"}] for i in range(1, 6)}
    cmds = [cmd(1, 2, "update", 1, email="p1@x.io"),     # still held
            cmd(2, 1, "update", 1, email="new@x.io"),    # releases p1
            cmd(3, 2, "update", 1, email="p1@x.io"),     # takes it
            cmd(4, 1, "update", 2, email="p1@x.io"),     # its first owner comes too late
            cmd(5, 2, "delete", 2),                      # releases it again
            cmd(6, 3, "update", 1, email="p1@x.io"),
            cmd(7, 2, "restore", 3),                     # wants p1 back, which 3 holds now
            cmd(8, 3, "update", 2, email=None),          # 3 gives it up
            cmd(9, 2, "restore", 3),
            cmd(10, 4, "delete", 1), cmd(11, 5, "update", 1, email="p4@x.io"), cmd(12, 4, "restore", 2)]
    want = check_serial(spark, people, cmds)
    assert [want[k][0] for k in (1, 3, 4, 6, 7, 9, 12)] == ["EMAIL_TAKEN", "APPLIED", "EMAIL_TAKEN", "APPLIED", "EMAIL_TAKEN", "APPLIED", "EMAIL_TAKEN"]


def _random_batch(seed, people, n, hot=0.0):
    rng = random.Random(seed)
    start = {i: [1, i % 3 == 0, {"email": f"own{i}@x.io"} if i % 2 else {}] for i in range(1, people + 1)}
    at = {i: 1 for i in start}
    cmds = []
    for seq in range(n):
        i = 1 if rng.random() < hot else rng.randrange(1, people + 1)
        kind = rng.choice(["update", "update", "update", "delete", "restore"])
        fields = rng.choice([{"email": f"e{rng.randrange(4)}@x.io"}, {"email": f"own{rng.randrange(1, people + 1)}@x.io"}, {"email": None}, {"company": f"C{rng.randrange(2)}"},
                             {"company": f"C{rng.randrange(2)}", "phone": f"555 010{rng.randrange(2)}"}, {}]) if kind == "update" else {}
        cmds.append(cmd(seq, i, kind, at[i] + rng.choice([0, 0, 0, -1, 1]), account=int(rng.random() < 0.05), **fields))
        at[i] += rng.random() < 0.4
    return start, cmds


def test_contested_emails_as_one_after_another(spark):
    for seed, rows in ((0, 1 << 20), (1, 1 << 20), (2, 7), (3, 30)):  # also with an e-mail's events over many ranges
        check_serial(spark, *_random_batch(seed, 8, 120), range_rows=rows)


def test_long_chains_in_chunks_as_one_after_another(spark):
    for seed, chain in ((10, 3), (11, 8), (12, 1)):
        check_serial(spark, *_random_batch(seed, 5, 150, hot=0.5), chain=chain, range_rows=50)


def test_half_of_all_commands_on_one_contact_spread_over_tasks(spark):
    from rolodeck.operators import versionscan

    # a client that always knows the version, and rivals that do not: 4,000 commands, half of them on contact 1
    people = {i: [1, False, {"company": "C"}] for i in range(1, 200)}
    cmds = [cmd(2 * k, 1, "update", 1 + k // 2, company=f"C{k}") for k in range(2000)] + [cmd(2 * k + 1, 1 + k % 199, "update", 1, company="D") for k in range(2000)]
    want = check_serial(spark, people, cmds, chain=64)
    assert sum(o == "APPLIED" for o, _ in want.values()) > 1000
    rows = spark.createDataFrame(cmds, CMD_SCHEMA).withColumn("seq", F.col("seq").cast("long"))
    chunks = versionscan.chunked(rows, 2011, 64).filter("contact_id = 1")
    assert chunks.count() == 32 and chunks.select(F.max(F.size("cmds"))).first()[0] == 64


def test_commands_on_nothing(spark):
    check_serial(spark, {1: [1, False, {}]}, [])
    check_serial(spark, {1: [1, False, {}]}, [cmd(k, 99, "update", 1, email="x@x.io") for k in range(20)], chain=4)


def test_no_python_judges_versions(spark):
    import inspect

    from rolodeck.operators import versionscan

    source = inspect.getsource(versionscan)
    assert "mapIn" not in source and "udf" not in source.lower() and ".collect()" not in source


CREATE = "seq long, account_id int, new_id long, first_name string, last_name string, email string, phone string, company string, tags array<string>"


def _create(spark, contacts, tags, cmds):
    out = C.apply_create(contacts, spark.createDataFrame(cmds, CREATE), NOW, tags)
    names = {r.id: r.name for r in out["new_tags"].collect()} | {r.id: r.name for r in tags.collect()}
    return out, {r.seq: (r.outcome, [(e.field, e.message) for e in r.errors]) for r in out["outcomes"].collect()}, sorted((r.contact_id, names[r.tag_id]) for r in out["new_links"].collect())


def test_create_with_tags(spark):
    c, t = make_contacts(spark, [dict(id=1, first="A", last="L", email="a@x.io", created=T0)]), make_tags(spark, [(1, 0, "VIP"), (2, 1, "lead")])
    out, got, links = _create(spark, c, t, [
        (1, 0, -1, "Ada", "Byron", "Ada.B@X.io", None, None, ["vip", " lead ", "VIP", " "]),
        (2, 0, -2, "Al", "B", None, None, None, ["LEAD", "New"]), (3, 0, -3, "No", "Tags", None, None, None, None)])
    assert {k: o for k, (o, _) in got.items()} == {1: "APPLIED", 2: "APPLIED", 3: "APPLIED"}
    assert links == [(-2, "New"), (-2, "lead"), (-1, "VIP"), (-1, "lead")]  # the tag keeps its casing, a new one the first spelling; the other account's is another
    assert sorted(r.name for r in out["new_tags"].collect()) == ["New", "lead"]
    assert sorted((r.contact_id, r.type) for r in out["activity"].collect()) == [(-3, "CONTACT_CREATED"), (-2, "CONTACT_CREATED"), (-2, "TAG_ADDED"), (-2, "TAG_ADDED"), (-1, "CONTACT_CREATED"), (-1, "TAG_ADDED"), (-1, "TAG_ADDED")]
    assert len({r.id for r in out["activity"].collect()}) == 7


def test_a_refused_create_writes_nothing(spark):
    c, t = make_contacts(spark, [dict(id=1, first="Ada", last="Lovelace", email="ada@x.io", created=T0)]), make_tags(spark, [])
    out, got, links = _create(spark, c, t, [
        (1, 0, -1, "Ada", "Byron", "ADA@x.io", None, None, ["Ghost"]), (2, 0, -2, "A", "B", None, None, None, ["a,b"]), (3, 0, -3, "A", "B", None, None, None, ["x" * 51]),
        (4, 0, -4, "A", "B", None, None, None, [f"t{i}" for i in range(21)]), (5, 0, -5, " ", "y" * 101, "n@x.io", "12", "c" * 151, None), (6, 0, -6, "A", "B", "nobody", None, None, []),
        (7, 0, -7, "A", "B", "n@x.io", "+1 (555) 010-0100", None, None)])
    assert {k: o for k, (o, _) in got.items()} == {1: "EMAIL_TAKEN", **{k: "VALIDATION_ERROR" for k in range(2, 7)}, 7: "APPLIED"}  # 5 claims no e-mail
    assert [f for f, _ in got[5][1]] == ["firstName", "lastName", "phone", "company"] and got[6][1] == [("email", "email must be an email")]
    assert got[2][1] == [("tags", "tag names cannot contain commas")] and [f for f, _ in got[4][1]] == ["tags"]
    assert [r.id for r in out["new_contacts"].collect()] == [-7] and not links and out["new_tags"].count() == 0 and out["activity"].count() == 1


def test_update_rules_apply_to_given_fields_only(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="L", created=T0), dict(id=2, first="B", last="L", created=T0)])
    got, out = outcomes(spark, c, [cmd(1, 1, "update", 1, last_name="  "), cmd(2, 1, "update", 1, phone="12", email="x"), cmd(3, 1, "update", 1, phone=" ", company="New"),
                                   cmd(4, 9, "update", 1, first_name=""), cmd(5, 2, "update", 1, email="nobody@x")])
    assert got == {1: ("VALIDATION_ERROR", None), 2: ("VALIDATION_ERROR", None), 3: ("APPLIED", 2), 4: ("VALIDATION_ERROR", None), 5: ("VALIDATION_ERROR", None)}
    assert [(r.id, r.company, r.last_name) for r in out["next_contacts"].collect()] == [(1, "New", "L")]


def test_oversize_bulk_requests_write_nothing(spark):
    c = make_contacts(spark, [dict(id=i, first="A", last=str(i), created=T0) for i in (1, 2)])
    rows = [("big", 0, i) for i in range(1, 1002)] + [("ok", 0, 2)] + [("repeats", 0, 2)] * 1500
    out = C.bulk_delete(c, spark.createDataFrame(rows, "request_id string, account_id int, id long"), NOW)
    assert [r.id for r in out["next_contacts"].collect()] == [2] and out["activity"].count() == 1
    assert [tuple(r) for r in out["refused"].collect()] == [("big", 0, 1001, "TOO_MANY_IDS")]
    assert {r.request_id: (r.deleted, r.already_in_trash) for r in out["report"].collect()} == {"ok": (1, 0), "repeats": (0, 1)}
    tagged = C.bulk_tag(c, make_tags(spark, []), make_links(spark, []), spark.createDataFrame([(*r, "T" + r[0]) for r in rows], "request_id string, account_id int, id long, tag_name string"), NOW)
    assert sorted(r.name for r in tagged["new_tags"].collect()) == ["Tok", "Trepeats"] and [r.request_id for r in tagged["refused"].collect()] == ["big"]


def test_events_of_two_batches_differ_and_of_one_batch_agree(spark):
    c = make_contacts(spark, [dict(id=1, first="A", last="1", created=T0)])
    req = spark.createDataFrame([(0, 1)], "account_id int, id long")
    ids = [C.bulk_delete(c, req, at)["activity"].first().id for at in (NOW, NOW, NOW + dt.timedelta(days=1))]
    assert ids[0] == ids[1] != ids[2]


def test_rebased_edits_apply_to_the_latest_contact(spark):
    base = make_contacts(spark, [dict(id=i, first="A", last="L", phone="+1 555 0100", company="Old", created=T0) for i in (1, 2)])
    mine = base.withColumn("phone", F.when(F.col("id") == 1, "+1 555 0199").otherwise(F.col("phone")))
    latest = base.withColumn("company", F.lit("Theirs")).withColumn("version", F.lit(4))
    edits = C.rebased(base, mine, latest, ["first_name", "last_name", "email", "phone", "company"])
    cmds = edits.select(F.lit(1).cast("long").alias("seq"), F.lit(0).alias("account_id"), F.col("id").alias("contact_id"), F.lit("update").alias("kind"), *[x for x in edits.columns if x != "id"])
    out = C.apply_commands(latest, cmds, NOW)
    assert [(r.id, r.phone, r.company, r.version) for r in out["next_contacts"].collect()] == [(1, "+1 555 0199", "Theirs", 5)]
