"""Row validation, header mapping and the review/apply steps on small files (reference cases)."""

import datetime as dt

from conftest import make_contacts, make_links, make_tags
from rolodeck.operators import importing as I

NOW = dt.datetime(2025, 1, 1)
T0 = dt.datetime(2024, 1, 1)


def files_df(spark, specs):
    """specs: (file, mode, header)."""
    return spark.createDataFrame([(f, i, 0, m, f, h, False) for i, (f, m, h) in enumerate(specs)],
                                 "file string, job_id long, account_id int, mode string, filename string, header array<string>, invalid boolean")


def rows_df(spark, file, mode, rows, job=0):
    return spark.createDataFrame([(file, job, 0, mode, i + 1, r, False) for i, r in enumerate(rows)],
                                 "file string, job_id long, account_id int, mode string, row_number long, cells array<string>, invalid boolean")


def validate(spark, mode, header, cells_list):
    f = files_df(spark, [("f.csv", mode, header)])
    r = rows_df(spark, "f.csv", mode, cells_list)
    return {x.row_number: x for x in I.validate_rows(r, I.header_map(f), mode).collect()}


CREATE_H = ["first_name", "last_name", "email", "phone", "company", "tags"]
UPDATE_H = ["email", "first_name", "phone", "company", "tags"]


def test_create_good_row(spark):
    v = validate(spark, "create", CREATE_H, [[" Ada ", "Lovelace", " ADA@X.IO ", "+1 415 555 0172", "Acme", "VIP; vip ;Lead"]])[1]
    assert v.errors == []
    assert (v.v.first_name, v.v.last_name, v.v.email, v.v.phone, v.v.company, v.v.tags) == \
        ("Ada", "Lovelace", "ada@x.io", "+1 415 555 0172", "Acme", ["VIP", "Lead"])


def test_create_blank_optional_cells_are_null(spark):
    v = validate(spark, "create", CREATE_H, [["A", "B", "", "", "", ""]])[1]
    assert (v.v.email, v.v.phone, v.v.company, v.v.tags, v.errors) == (None, None, None, [], [])


def test_create_every_problem(spark):
    v = validate(spark, "create", CREATE_H, [["", "B" * 101, "nope", "12", "C" * 151, "x" * 51]])[1]
    by = {e.field: e.message for e in v.errors}
    assert sorted(by) == ["company", "email", "first_name", "last_name", "phone", "tags"]
    assert by["first_name"] == "First name is required" and by["email"] == "Not a valid email address"
    assert by["phone"] == "Phone must be 7 to 15 digits" and by["tags"] == 'Tag "xxxxxxxxxxxxxxxxxxxx…" is longer than 50 characters'


def test_create_tag_limits(spark):
    v = validate(spark, "create", CREATE_H, [["A", "B", "", "", "", ";".join(f"t{i}" for i in range(21))], ["A", "B", "", "", "", "a,b"]])
    assert v[1].errors[0].message == "A contact can get at most 20 tags per row"
    assert v[2].errors[0].message == 'Tag "a,b" cannot contain commas'


def test_update_tri_state(spark):
    v = validate(spark, "update", UPDATE_H, [["ada@x.io", "", "[CLEAR]", "New Co", ""]])[1]
    assert v.errors == []
    assert (v.v.first_name_set, v.v.phone_set, v.v.phone, v.v.company, v.v.email) == (False, True, None, "New Co", "ada@x.io")


def test_update_messages(spark):
    v = validate(spark, "update", UPDATE_H, [["", "A", "", "", ""], ["a@x.io", "[clear]", "", "", ""], ["a@x.io", "", "", "", "[clear]"]])
    assert "Email is required to find the contact" in [e.message for e in v[1].errors]
    assert v[2].errors[0].message == "First name can't be cleared"
    assert v[3].errors[0].message == "Import only adds tags; remove tags in the app"


def test_update_absent_columns_untouched(spark):
    v = validate(spark, "update", ["email", "company"], [["a@x.io", "Co"]])[1]
    assert (v.v.email, v.v.company, v.v.first_name_set, v.v.phone_set, v.v.tags) == ("a@x.io", "Co", False, False, [])


def test_header_problems(spark):
    f = files_df(spark, [
        ("a.csv", "create", ["First Name", "LASTNAME", "E-mail", "Favourite colour", "Company"]),
        ("b.csv", "create", ["first_name", "email"]),
        ("c.csv", "create", ["email"]),
        ("d.csv", "create", ["first_name", "last_name", "Surname"]),
        ("e.csv", "update", ["email"]),
        ("f.csv", "update", ["company", "phone"]),
    ])
    h = {r.file: r for r in I.header_map(f).collect()}
    assert h["a.csv"].problem is None and h["a.csv"].ignored == ["Favourite colour"]
    assert h["a.csv"]["index"] == {"first_name": 0, "last_name": 1, "email": 2, "company": 4}
    assert h["b.csv"].problem == "Missing required column: last_name"
    assert h["c.csv"].problem == "Missing required columns: first_name, last_name"
    assert h["d.csv"].problem == 'The column "last_name" appears twice in the header'
    assert h["e.csv"].problem == "An update file needs the email column plus at least one column to change"
    assert h["f.csv"].problem == "Missing required column: email"


def test_update_review_messages_in_order(spark):
    """Six update rows: unknown e-mail, trashed owner, bad phone, blank key, ok, duplicate of row 3."""
    c = make_contacts(spark, [dict(id=1, first="Ada", last="L", email="ada@x.io", created=T0),
                              dict(id=2, first="Tom", last="T", email="tom@x.io", created=T0, deleted=T0),
                              dict(id=3, first="Bo", last="B", email="bo@x.io", created=T0)])
    f = files_df(spark, [("u.csv", "update", ["email", "phone"])])
    r = rows_df(spark, "u.csv", "update", [["nobody@x.io", "555 0100 123"], ["tom@x.io", "555 0100 123"], ["bo@x.io", "12"],
                                           ["", "555 0100 123"], ["ada@x.io", "555 0100 123"], ["BO@x.io", "555 0100 124"]])
    rev = {x.row_number: [e.message for e in x.errors] for x in I.review(r, f, c).collect()}
    assert rev == {1: ["No contact has this email"], 2: ["This contact is in the trash"], 3: ["Phone must be 7 to 15 digits"],
                   4: ["Email is required to find the contact"], 5: [], 6: ["Duplicate of row 3 in this file"]}


def test_create_review_and_apply(spark):
    c = make_contacts(spark, [dict(id=1, first="Ada", last="L", email="ada@x.io", created=T0)])
    t = make_tags(spark, [(1, 0, "VIP")])
    ct = make_links(spark, [])
    f = files_df(spark, [("c.csv", "create", CREATE_H)])
    r = rows_df(spark, "c.csv", "create", [["New", "One", "new@x.io", "", "", "vip;Lead"], ["Dup", "Two", "ADA@x.io", "", "", ""],
                                           ["", "Three", "", "", "", ""], ["Four", "F", "new@x.io", "", "", ""]], job=7)
    rev = I.review(r, f, c)
    msgs = {x.row_number: [e.message for e in x.errors] for x in rev.collect()}
    assert msgs == {1: [], 2: ["Already used by Ada L"], 3: ["First name is required"], 4: ["Duplicate of row 1 in this file"]}
    out = I.apply_create(rev, c, t, ct, NOW)
    new = out["new_contacts"].collect()
    assert [(x.id, x.email) for x in new] == [(-7000001, "new@x.io")]
    assert sorted((x.name, x.is_new) for x in I.ensure_tags(t, spark.createDataFrame(
        [(0, "vip", (1,)), (0, "Lead", (2,))], "account_id int, name string, order struct<o:int>")).collect()) == [("Lead", True), ("VIP", False)]
    assert sorted(r.type for r in out["activity"].collect()) == ["CONTACT_CREATED", "TAG_ADDED", "TAG_ADDED"]
    # taken between review and import: becomes an import-phase error
    c2 = c.unionByName(make_contacts(spark, [dict(id=2, first="Late", last="R", email="new@x.io", created=T0)]))
    out2 = I.apply_create(rev, c2, t, ct, NOW)
    assert out2["new_contacts"].count() == 0 and [e.message for e in out2["errors"].collect()] == ["Already used by another contact"]


def test_update_apply_changes_and_unchanged(spark):
    c = make_contacts(spark, [dict(id=1, first="Ada", last="L", email="ada@x.io", phone="1", company="Old", created=T0),
                              dict(id=2, first="Bo", last="B", email="bo@x.io", company="Same", created=T0)])
    t, ct = make_tags(spark, []), make_links(spark, [])
    f = files_df(spark, [("u.csv", "update", ["email", "company", "phone"])])
    r = rows_df(spark, "u.csv", "update", [["ada@x.io", "New", "[clear]"], ["bo@x.io", "Same", ""]])
    out = I.apply_update(I.review(r, f, c), c, t, ct, NOW)
    assert {x.row_number: x.outcome for x in out["outcomes"].collect()} == {1: "updated", 2: "unchanged"}
    up = out["updated_contacts"].first()
    assert (up.id, up.version, up.company, up.phone) == (1, 2, "New", None)
    ev = out["activity"].first()
    assert ev.payload == '{"changes":{"phone":{"from":"1","to":null},"company":{"from":"Old","to":"New"}},"version":2,"import":"0"}'


def test_chunks_and_rejected_file(spark):
    f = files_df(spark, [("c.csv", "create", CREATE_H)])
    r = rows_df(spark, "c.csv", "create", [[f"N{i}", "X", "", "", "", ""] for i in range(6)] + [["", "X", "bad", "", "=1+1", ""]])
    rev = I.review(r, f, make_contacts(spark, []))
    chunks = [(x.chunk, x.rows, x.processed) for x in I.chunk_progress(rev, 2).orderBy("chunk").collect()]
    assert chunks == [(0, 2, 2), (1, 2, 4), (2, 2, 6), (3, 1, 7)]
    lines = [x.line for x in I.rejected_rows_csv(I.import_errors(rev), f).orderBy("line_no").collect()]
    assert lines == ["first_name,last_name,email,phone,company,tags,error",
                     ",X,bad,,'=1+1,,first_name: First name is required; email: Not a valid email address"]


def test_update_jobs_apply_one_after_another(spark):
    # three update jobs touch one contact: each row is judged on the state the earlier jobs left
    c = make_contacts(spark, [dict(id=1, first="Ada", last="L", email="ada@x.io", phone="1", company="Old", created=T0)])
    t, ct = make_tags(spark, []), make_links(spark, [])
    h = ["email", "company", "phone", "tags"]
    f = files_df(spark, [("a.csv", "update", h), ("b.csv", "update", h), ("c.csv", "update", h)])
    r = rows_df(spark, "a.csv", "update", [["ada@x.io", "New", "", "vip"]], job=0) \
        .unionByName(rows_df(spark, "b.csv", "update", [["ada@x.io", "New", "+1 555 0100", "VIP"]], job=1)) \
        .unionByName(rows_df(spark, "c.csv", "update", [["ada@x.io", "New", "", "Vip"]], job=2))
    out = I.apply_update(I.review(r, f, c), c, t, ct, NOW)
    assert {x.file: x.outcome for x in out["outcomes"].collect()} == {"a.csv": "updated", "b.csv": "updated", "c.csv": "unchanged"}
    up = out["updated_contacts"].collect()
    assert [(x.id, x.version, x.company, x.phone) for x in up] == [(1, 3, "New", "+1 555 0100")]
    ev = sorted((x.type, x.payload) for x in out["activity"].collect())
    assert ev[0] == ("CONTACT_UPDATED", '{"changes":{"company":{"from":"Old","to":"New"}},"version":2,"import":"0"}')
    assert ev[1] == ("CONTACT_UPDATED", '{"changes":{"phone":{"from":"1","to":"+1 555 0100"}},"version":3,"import":"1"}')
    assert ev[2][0] == "TAG_ADDED" and ev[2][1].endswith('"name":"vip"},"import":"0"}') and len(ev) == 3


def test_create_jobs_claiming_one_email(spark):
    # the earlier job creates the contact; the later one finds the e-mail taken
    c = make_contacts(spark, [])
    t, ct = make_tags(spark, []), make_links(spark, [])
    f = files_df(spark, [("a.csv", "create", CREATE_H), ("b.csv", "create", CREATE_H)])
    r = rows_df(spark, "a.csv", "create", [["A", "One", "x@x.io", "", "", ""]], job=0) \
        .unionByName(rows_df(spark, "b.csv", "create", [["B", "Two", "", "", "", ""], ["B", "Three", "X@x.io", "", "", ""]], job=1))
    out = I.apply_create(I.review(r, f, c), c, t, ct, NOW)
    assert sorted((x.last_name, x.email) for x in out["new_contacts"].collect()) == [("One", "x@x.io"), ("Two", None)]
    assert [(e.file, e.row_number, e.message) for e in out["errors"].collect()] == [("b.csv", 2, "Already used by another contact")]


def test_rows_of_failed_files_are_not_applied(spark):
    # invalid CSV in one row fails the whole file, as do a bad header and a file without rows; the good file is applied
    c = make_contacts(spark, [])
    t, ct = make_tags(spark, []), make_links(spark, [])
    f = files_df(spark, [("bad.csv", "create", CREATE_H), ("head.csv", "create", ["email"]), ("none.csv", "create", CREATE_H),
                         ("good.csv", "create", CREATE_H)])
    bad = rows_df(spark, "bad.csv", "create", [["A", "One", "a@x.io", "", "", ""], ["B", "Two", "b@x.io", "", "", ""]], job=0)
    r = bad.withColumn("invalid", bad.row_number == 2) \
        .unionByName(rows_df(spark, "head.csv", "create", [["c@x.io"]], job=1)) \
        .unionByName(rows_df(spark, "good.csv", "create", [["D", "Four", "d@x.io", "", "", ""]], job=2))
    rev = I.review(r, f, c)
    assert {x.file for x in rev.collect()} == {"good.csv"}
    out = I.apply_create(rev, c, t, ct, NOW)
    assert [x.email for x in out["new_contacts"].collect()] == ["d@x.io"]
    status = {x.file: x.status for x in I.job_summary(rev, f, r).collect()}
    assert status == {"bad.csv": "failed", "head.csv": "failed", "none.csv": "failed", "good.csv": "ready"}
