"""Licence scans against SQL and small texts."""

import re

import duckdb
import pytest

from rolodeck.llm import licence_index as L
from rolodeck.llm.op13_queries import COLUMNS, ORACLE_13, op13_licence_index

SF = "/root/testdata/sf0.001"
FILLER = " ".join(f"word{i}" for i in range(400))


def _rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def _by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.sql(ORACLE_13).fetchall(), key=str)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _labels(spark, text):
    # among enough other texts that licence words are rare
    rows = [(0, text)] + [(i, f"the of and to in this is or by {FILLER}") for i in range(1, 30)]
    return next(r for r in L.scanned(_docs(spark, rows)).collect() if r["doc_id"] == 0)


@pytest.mark.parametrize("text, label", [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("# Released under the\n# MIT License", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("LICENSED UNDER CC BY-NC 4.0", "cc-by-nc-4.0"), ("licensed under cc-by 4.0", "cc-by-4.0"), *[(text, label) for label, text, _ in L.TEMPLATES],
])
def test_each_notice_is_found_where_it_stands(spark, text, label):
    r = _labels(spark, f"{FILLER} {text} {FILLER}")
    mine = [x for x in r["licences"] if x["label"] == label]
    assert mine and mine[0]["first"] <= 400 + 3 and mine[0]["score"] >= 0.8 and 0 < r["score"] <= 1
    assert label in r["labels"].split(",")


def test_key_phrases_are_mandatory_and_bound_to_the_alignment(spark):
    assert _labels(spark, "Licensed under CC BY-NC 4.0")["labels"] == "cc-by,cc-by-nc-4.0"  # not cc-by-4.0, though all its words stand there in order
    assert _labels(spark, "Released under the license of MIT")["labels"] == ""
    assert _labels(spark, "mit und mit der Lizenz, license mit")["labels"] == ""
    assert _labels(spark, f"Licensed under the Apache {FILLER} License, {FILLER} Version 2.0")["labels"] == ""  # words too far apart
    assert _labels(spark, "Permission is hereby gladly granted, free of charge, to any person obtaining a copy of this software and associated documentation files")["labels"] == ""
    near = _labels(spark, "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and its associated documentation files")
    assert near["labels"] == "mit" and near["score"] >= 0.8


def test_base_places(spark):
    text = "CC-BY cc by. General\nPublic License; all RIGHTS reserved general public license cc by cc by"
    r = _labels(spark, text)
    words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), 6, 0, len(words) - 2, "cc-by,gpl,reserved")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " .,;"), (4, "cc by"), (4, "cc by"), (None, "All rights reserved"), (6, "ccby cc bye KK İ  "), (7, "é" * 5000 + " cc by " + "x " * 30000 + "cc by"), (8, "a.b cc.by")]
    got = _rows(L.scanned(_docs(spark, rows)))
    assert got == _by_sql(rows)
    assert (1, 0, 0, None, None, "", "", 0.0) in got and got.count((4, 2, 1, 0, 0, "cc-by", "cc-by", 0.0)) == 2
    clash = _docs(spark, rows).selectExpr("doc_id", "text", "1 AS code", "2 AS row", "3 AS words", "4 AS `a.b`", "5 AS found")
    assert _rows(L.scanned(clash)) == got
    empty = L.scanned(_docs(spark, rows).where("false"))
    assert empty.count() == 0 and empty.columns == [*COLUMNS, "licences"]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = _rows(op13_licence_index(spark, SF))
    assert got == sorted(con.sql(ORACLE_13).fetchall(), key=str) and {r[6] for r in got} > {""}
