"""What grows with the tables is not broadcast, and what is read several times is derived once."""

import os

import pytest
from conftest import SF, make_contacts

from rolodeck.operators import changes as C
from rolodeck.operators import importing as I
from rolodeck.operators import versionscan
from rolodeck.plans import changes_plans, import_plans, streaming_plans
from rolodeck.session import checkpoint_dir
from rolodeck.sources import fixtures, store
from rolodeck.sources.fixtures import AS_OF, load_model
from rolodeck.sources.import_fixture import import_files, import_rows
from rolodeck.streaming import rollups as S

COMMAND = "seq long, account_id int, contact_id long, kind string, expected_version int, " + ", ".join(f"{f} string, {f}_set boolean" for f in versionscan.FIELDS)
ROW = "file string, job_id long, account_id int, mode string, row_number long, cells array<string>, invalid boolean"
FILE = "file string, job_id long, account_id int, mode string, filename string, header array<string>, invalid boolean"


def _broadcasts(df) -> bool:
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def _left_over(spark, name):
    d = checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(d) if x.startswith(name)}


def _batch(spark):
    contacts = make_contacts(spark, [{"id": i, "first": f"f{i}", "last": "l", "email": f"m{i}@x.test"} for i in range(1, 5)])
    no = [None, False] * 4
    rows = [(1, 0, 1, "update", 1, "new", True, *no), (2, 0, 1, "delete", 2, None, False, *no), (3, 0, 2, "update", 9, "b", True, *no), (4, 0, 7, "delete", 1, None, False, *no)]
    return contacts, spark.createDataFrame(rows, COMMAND)


def test_commands_are_joined_with_the_contacts_without_a_broadcast(spark, monkeypatch):
    plans = {}
    kept = versionscan.staged
    monkeypatch.setattr(versionscan, "staged", lambda df, name: (plans.setdefault(name, _broadcasts(df)), kept(df, name))[1])
    contacts, commands = _batch(spark)
    out = C.apply_commands(contacts, commands, AS_OF)
    assert plans["chunks"] is False
    assert {r.seq: r.outcome for r in out["outcomes"].collect()} == {1: C.APPLIED, 2: C.APPLIED, 3: C.CONFLICT, 4: C.NOT_FOUND}


def test_next_contacts_are_joined_without_a_broadcast(spark):
    out = C.apply_commands(*_batch(spark), AS_OF)["next_contacts"]
    assert not _broadcasts(out)
    assert [(r.id, r.first_name, r.version, r.deleted_at) for r in out.collect()] == [(1, "new", 3, AS_OF)]


def test_commands_get_their_account_without_a_broadcast(spark):
    assert not _broadcasts(changes_plans.commands(spark, SF, load_model(spark, SF)))


def test_import_rows_are_joined_with_the_contacts_without_a_broadcast(spark):
    assert not _broadcasts(import_rows(spark, SF, load_model(spark, SF).contacts))


def test_a_review_reads_its_rows_once(spark, tmp_path):
    rows = [("a.csv", 1, 0, "create", 1, ["Ann", "Lee", "a@x.test"], False), ("a.csv", 1, 0, "create", 2, ["", "Lee", "A@x.test"], False),
            ("b.csv", 2, 0, "update", 1, ["m1@x.test", "Co"], False), ("b.csv", 2, 0, "update", 2, ["m9@x.test", "Co"], False), ("c.csv", 3, 0, "create", 1, ["x"], True)]
    spark.createDataFrame(rows, ROW).write.parquet(f"{tmp_path}/rows")
    files = spark.createDataFrame([("a.csv", 1, 0, "create", "a.csv", ["first_name", "last_name", "email"], False), ("b.csv", 2, 0, "update", "b.csv", ["email", "company"], False),
                                   ("c.csv", 3, 0, "create", "c.csv", ["first_name", "last_name"], False)], FILE)
    contacts = make_contacts(spark, [{"id": 1, "first": "f", "last": "l", "email": "m1@x.test"}])
    written = []
    out = I.review(spark.read.parquet(f"{tmp_path}/rows"), files, contacts, written)
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    got = {(r.file, r.row_number): [e.message for e in r.errors] for r in out.collect()}
    assert got == {("a.csv", 1): [], ("a.csv", 2): ["First name is required", "Duplicate of row 1 in this file"], ("b.csv", 1): [], ("b.csv", 2): ["No contact has this email"]}
    for table in written:
        table.drop()


def test_rows_are_validated_where_they_lie(spark, monkeypatch):
    plans, kept = {}, I.Staged
    monkeypatch.setattr(I, "Staged", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    rows = [("a.csv", 1, 0, "create", 1, ["Ann", "Lee"], False), ("a.csv", 1, 0, "create", 2, ["", "Lee"], False),
            ("b.csv", 2, 0, "update", 1, ["m1@x.test", "Co"], False), ("c.csv", 3, 0, "create", 1, ["x"], True)]
    files = spark.createDataFrame([("a.csv", 1, 0, "create", "a.csv", ["first_name", "last_name"], False), ("b.csv", 2, 0, "update", "b.csv", ["email", "company"], False),
                                   ("c.csv", 3, 0, "create", "c.csv", ["first_name", "last_name"], False)], FILE)
    contacts = make_contacts(spark, [{"id": 1, "first": "f", "last": "l", "email": "m1@x.test"}])
    written = []
    got = {(r.file, r.row_number): [e.message for e in r.errors] for r in I.review(spark.createDataFrame(rows, ROW), files, contacts, written).collect()}
    assert got == {("a.csv", 1): [], ("a.csv", 2): ["First name is required"], ("b.csv", 1): []}
    assert "hashpartitioning" not in plans["import-validated"]
    for table in written:
        table.drop()


def test_import_cells_stand_once_in_the_plan(spark):
    rows = import_rows(spark, SF, load_model(spark, SF).contacts)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("not-an-email") == 1
    sizes = {r.n: r.k for r in rows.filter("mode = 'create'").selectExpr("size(cells) AS n").groupBy("n").agg({"n": "count"}).toDF("n", "k").collect()}
    parts = [k for (k,) in fixtures.raw(spark, SF, "part").select("p_partkey").collect() if k % 6 < 4]
    extra, short = [k for k in parts if k % 43 == 0], [k for k in parts if k % 47 == 0 and k % 43]
    assert sizes == {8: len(extra), 3: len(short), 7: len(parts) - len(extra) - len(short)}


def test_the_store_derives_its_contacts_once_and_broadcasts_none(spark, monkeypatch, tmp_path):
    seen = {}
    for name in ("tags", "contact_tags", "contact_activity"):
        derive = getattr(fixtures, name)
        monkeypatch.setattr(fixtures, name, lambda *args, name=name, derive=derive: seen.setdefault(name, derive(*args)))
    store.build(spark, SF, str(tmp_path / "attempt"))
    assert len(seen) == 3
    for df in seen.values():
        assert not [f for f in df.inputFiles() if "part.parquet" in f or "customer.parquet" in f] and not _broadcasts(df)


def test_a_run_keeps_the_review_alone(spark):
    before = _left_over(spark, "import-")
    run = import_plans._Run(spark, SF)
    n = run.reviewed().count()
    assert n == run.rows.count() > 0 and _left_over(spark, "import-") == before


def test_the_stream_reviews_each_file_and_keeps_no_scratch_tables(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for k in range(3):
        (src / f"f{k}.csv").write_text(f"first_name,last_name,email\r\nAnn,Lee,n{k}@x.test\r\nBob,,m1@x.test\r\nEve,Ray,m1@x.test\r\nEve,Ray,n{k}@x.test\r\n")
    files = sorted(r.path for r in spark.read.format("binaryFile").load(str(src)).select("path").collect())
    modes = spark.createDataFrame([(f, k, 0, "create") for k, f in enumerate(files)], "file string, job_id long, account_id int, mode string")
    contacts = make_contacts(spark, [{"id": 1, "first": "f", "last": "l", "email": "m1@x.test"}])
    before = _left_over(spark, "import-")
    S.import_files_stream(spark, str(src), modes, contacts, f"{tmp_path}/out", f"{tmp_path}/ck", files_per_trigger=2).awaitTermination()
    rev = spark.read.parquet(f"{tmp_path}/out")
    want = {1: "[]", 2: '[{"field":"last_name","message":"Last name is required"}]', 3: '[{"field":"email","message":"Duplicate of row 2 in this file"}]', 4: '[{"field":"email","message":"Duplicate of row 1 in this file"}]'}
    assert {(r.job_id, r.row_number): r.errors for r in rev.collect()} == {(k, n): e for k in range(3) for n, e in want.items()}
    assert rev.select("batch_id").distinct().count() == 2 and _left_over(spark, "import-") == before


class _Stop(Exception):
    pass


def test_the_job_table_is_derived_once_for_all_batches(spark, monkeypatch):
    seen = []

    def start(spark, source, modes, *args, **kwargs):
        seen.append(modes)
        raise _Stop

    monkeypatch.setattr(streaming_plans.S, "import_files_stream", start)
    with pytest.raises(_Stop):
        streaming_plans.q_stream_import_files(spark, SF)
    assert not [f for f in seen[0].inputFiles() if "part.parquet" in f or f.endswith(".txt")]
    assert seen[0].count() == import_files(spark, SF).count()
