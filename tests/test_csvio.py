"""CSV fidelity (S2, S3, S5) on small files written to a scratch folder."""

import os
import tempfile

from pyspark.sql import functions as F

from rolodeck.sources import csvio


def _write(d, name, data: bytes):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def _records(spark, d):
    rows = csvio.read_csv_records(spark, d).orderBy("file", "record_no").collect()
    return [(os.path.basename(r.file), r.record_no, list(r.cells), r.too_long) for r in rows]


def test_quotes_newlines_bom_ragged(spark):
    d = tempfile.mkdtemp(prefix="csvt-")
    _write(d, "a.csv", '﻿First Name,Last,Note\r\n"Ada","Love, lace","multi\nline"\r\n\r\nGrace,"say ""hi""",x,extra,\r\nAlan,,\r\n'.encode())
    recs = _records(spark, d)
    assert recs[0][2] == ["First Name", "Last", "Note"]
    assert recs[1][2] == ["Ada", "Love, lace", "multi\nline"]
    # blank line skipped; surplus and trailing empty cells kept
    assert recs[2][2] == ["Grace", 'say "hi"', "x", "extra", ""]
    assert recs[3][2] == ["Alan", "", ""]
    assert [r[1] for r in recs] == [1, 2, 3, 4]


def test_unterminated_quote_is_invalid(spark):
    d = tempfile.mkdtemp(prefix="csvt-")
    _write(d, "bad.csv", b'first_name,last_name\n"Ada,Lovelace\n')
    _write(d, "good.csv", b'first_name,last_name\n"Ada","Lovelace"\n')
    got = {os.path.basename(r.file): r.invalid for r in csvio.parsed(csvio.file_texts(spark, d)).collect()}
    assert got == {"bad.csv": True, "good.csv": False}


def test_misplaced_quotes_are_invalid(spark):
    d = tempfile.mkdtemp(prefix="csvt-")
    texts = {"inside.csv": b'A"b"c,D\n', "after.csv": b'"A"b,D\n', "blank.csv": b'"A" ,D\n', "lead.csv": b'a,b\n "A",D\n', "doubled.csv": b'"A""",""\n',
             "bom.csv": '\ufeff"A",b\n'.encode(), "end.csv": b'a,"b"', "nul.csv": b"a\0,b\n"}
    for name, data in texts.items():
        _write(d, name, data)
    got = {os.path.basename(r.file): r.invalid for r in csvio.parsed(csvio.file_texts(spark, d)).collect()}
    assert got == {n: n in ("inside.csv", "after.csv", "blank.csv", "lead.csv", "nul.csv") for n in texts}


def test_any_number_of_columns(spark):
    d = tempfile.mkdtemp(prefix="csvt-")
    for n in (70, 300):
        _write(d, f"w{n}.csv", (",".join(f"h{i}" for i in range(n)) + "\n" + ",".join(f'"v,{i}"' for i in range(n)) + "\n").encode())
    recs = _records(spark, d)
    assert [(r[0], len(r[2]), r[3]) for r in recs] == [("w300.csv", 300, False)] * 2 + [("w70.csv", 70, False)] * 2
    assert recs[1][2] == [f"v,{i}" for i in range(300)]


def test_records_as_the_csv_module_reads_them(spark):
    import csv
    import io
    import random

    rng, d, texts = random.Random(7), tempfile.mkdtemp(prefix="csvt-"), {}
    for k in range(40):
        rows = [["".join(rng.choice('ab,"\n\r é') for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 8))]
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL if k % 2 else csv.QUOTE_MINIMAL, lineterminator=rng.choice(["\r\n", "\n", "\r"])).writerows(rows)
        texts[f"{k:02}.csv"] = rows
        _write(d, f"{k:02}.csv", out.getvalue().encode())
    got = {n: [] for n in texts}
    for name, _, cells, _ in _records(spark, d):
        got[name].append(cells)
    assert got == texts
    assert not any(r.invalid for r in csvio.parsed(csvio.file_texts(spark, d)).collect())


def test_mixed_line_ends_and_long_records(spark):
    d = tempfile.mkdtemp(prefix="csvt-")
    _write(d, "m.csv", b'a,b\r1,2\n3,4\r\n\r\n""\n' + b"x" * 20_001 + b",5")
    recs = _records(spark, d)
    assert [r[2] for r in recs[:4]] == [["a", "b"], ["1", "2"], ["3", "4"], [""]]
    assert [r[3] for r in recs] == [False] * 4 + [True]


def test_large_files_are_not_read(spark):
    d = tempfile.mkdtemp(prefix="csvt-")
    _write(d, "big.csv", b"a,b\n" * 600)
    _write(d, "ok.csv", b"a,b\n")
    assert {os.path.basename(r.file): r.text for r in csvio.file_texts(spark, d, max_bytes=1024).collect()} == {"big.csv": None, "ok.csv": "a,b\n"}


def test_intake_screen(spark):
    d = tempfile.mkdtemp(prefix="csvt-")
    _write(d, "ok.csv", b"first_name,last_name\nA,B\n")
    _write(d, "notes.txt", b"hello")
    _write(d, "empty.csv", b"")
    _write(d, "bin.csv", b"a,b\n\x00\x01")
    _write(d, "big.csv", b"x" * 2048)
    names = ["ok.csv", "notes.txt", "empty.csv", "bin.csv", "big.csv"]
    expected = spark.createDataFrame([("file:" + os.path.join(d, n),) for n in names], "path string")
    got = {os.path.basename(r.file): r.reason for r in csvio.intake_screen(spark, d, max_bytes=1024, expected=expected).collect()}
    assert got == {
        "ok.csv": None,
        "notes.txt": "Upload a .csv file",
        "empty.csv": "The file is empty",
        "bin.csv": "This does not look like a text CSV file",
        "big.csv": "File too large",
    }


def test_import_pipeline_from_files(spark):
    """Aliases, BOM, CRLF and quotes: 2 rows valid, one ignored column noted."""
    from rolodeck.operators import importing as I
    from rolodeck.sources.fixtures import AS_OF  # noqa: F401

    d = tempfile.mkdtemp(prefix="csvt-")
    p = _write(d, "people.csv", '﻿First Name,LASTNAME,E-mail,Favourite colour,Company\r\n'
               'Ada,Lovelace,ADA@example.com,blue,"Analytical, Ltd"\r\nGrace,Hopper,grace@navy.mil,red,\r\n'.encode())
    modes = spark.createDataFrame([(p if p.startswith("file:") else "file:" + p, 1, 0, "create")], "file string, job_id long, account_id int, mode string")
    files, rows = csvio.read_import_files(spark, d, modes)
    contacts = spark.createDataFrame([], "id long, account_id int, first_name string, last_name string, email string, deleted_at timestamp_ntz")
    rev = I.review(rows, files, contacts)
    out = {r.row_number: (r.v.email, r.v.company, len(r.errors)) for r in rev.collect()}
    assert out == {1: ("ada@example.com", "Analytical, Ltd", 0), 2: ("grace@navy.mil", None, 0)}
    summary = I.job_summary(rev, files, rows).collect()[0]
    assert summary.notes == "Ignored columns: Favourite colour"
    assert summary.valid_rows == 2 and summary.status == "ready"


def _by_the_csv_module(data: bytes):
    import csv
    import io

    return [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")) if r]


def test_a_large_file_is_read_by_many_tasks(spark):
    """Quoted line breaks, doubled quotes and mixed line ends everywhere, so that they fall on split borders too."""
    import random

    rng, d = random.Random(11), tempfile.mkdtemp(prefix="csvt-")
    lines = ['\ufeffa,b,c']
    for k in range(30_000):
        kind = rng.randrange(12)
        cell = 'x' * rng.randrange(30) if kind < 6 else f'"l{k}\nm\r\n{k}"' if kind == 6 else '"say ""hi"", é"' if kind == 7 else f'"{chr(10) * rng.randrange(1, 4)}"' if kind == 8 else '""' if kind == 9 else "é,ü" if kind == 10 else '"a,b"'
        lines.append(f"{k},{cell},{k % 7}" + rng.choice(["", "\r"]) + rng.choice(["", "\n", "\n\r"]) * (rng.random() < 0.1))
    data = "\n".join(lines).encode()
    _write(d, "large.csv", data)
    _write(d, "small.csv", b'p,q\r1,"2\r3"\r')
    _write(d, "open.csv", b'p,q\n1,"2\n3\n4,5\n')
    _write(d, "bin.csv", b"p,q\n1,2\n\0,3\n")
    _write(d, "inside.csv", b'p,q\n1,2\n3,x"y"\n')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert csvio._lines(spark, d).select("split").distinct().count() > 30
        files, records = csvio.read_csv(spark, d)
        got = {}
        for r in records.orderBy("file", "record_no").collect():
            got.setdefault(os.path.basename(r.file), []).append((r.record_no, list(r.cells)))
        assert {os.path.basename(r.file): r.invalid for r in files.collect()} == {"large.csv": False, "small.csv": False, "open.csv": True, "bin.csv": True, "inside.csv": True}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = _by_the_csv_module(data)
    assert [n for n, _ in got["large.csv"]] == list(range(1, len(want) + 1))
    assert [c for _, c in got["large.csv"]] == want
    assert got["small.csv"] == [(1, ["p", "q"]), (2, ["1", "2\r3"])] and "bin.csv" not in got
