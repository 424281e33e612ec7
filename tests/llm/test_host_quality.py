"""Operator 3 against a plain-Python count, and its defined cases."""

import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rolodeck.llm import host_quality as Q

SCHEMA = "doc_id long, text string, source string"


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spots = defaultdict(list)
    for i in range(len(words) - 4):
        spots[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), sum(n - 1 for n in Counter(lines).values()), len(covered))


TEXTS = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 40, "\n".join(["same line here"] * 5 + ["other"]), "## $$ a|b <c>",
         "é ü ß   z", "\x0b\x0ca\rb\n\n b", " ".join(f"w{i % 7}" for i in range(60)), " ".join(map(str, range(50_000)))]


def rows(spark, texts):
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], SCHEMA)
    got = Q.measured(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect()
    return {r[0]: tuple(r[1:]) for r in got}


def test_measures_equal_the_count_by_hand(spark):
    got = rows(spark, TEXTS)
    assert {i: by_hand(t) for i, t in enumerate(TEXTS)} == got


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=80), min_size=1, max_size=40))
def test_measures_of_any_texts(spark, texts):
    assert rows(spark, texts) == {i: by_hand(t) for i, t in enumerate(texts)}


GOOD = " ".join(f"word{i}" for i in range(30))


def test_hosts_are_shrunk_and_rejected(spark):
    # one host fails on most of its many documents, a small one on its only document, the others seldom
    data = [(i, "x" if i % 10 else GOOD, "bad") for i in range(200)] + [(1000, "x", "small"), (1001, GOOD, "small")]
    data += [(2000 + i, GOOD if i % 50 else "x", f"good{i % 8}") for i in range(400)]
    df = spark.createDataFrame(data, SCHEMA)
    rates = {(r["host"], r["rule"]): r for r in Q.host_rates(Q.measured(df).drop("text"), "source").collect()}
    assert rates["bad", "short"]["rate"] == 0.9 and rates["small", "short"]["rate"] == 0.5
    assert rates["small", "short"]["shrunk"] < 0.5 < rates["bad", "short"]["shrunk"] < 0.9
    kept = {r["doc_id"]: r["kept"] for r in Q.quality(df).collect()}
    assert not any(kept[i] for i in range(200)) and kept[1001] and not kept[1000]
    assert all(kept[2000 + i] == bool(i % 50) for i in range(400))


def test_null_host_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, GOOD, None, 7, "k"), (1, GOOD, None, 7, "k"), (None, GOOD, "h", 8, None), (2, None, "h", 9, "m")], f"{SCHEMA}, n_words int, kept string")
    out = Q.keep_good(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted([r for r in df.collect() if r["text"]], key=str)


def test_measures_beside_columns_of_their_names(spark):
    plain = spark.createDataFrame([(1, GOOD, "h"), (2, "x", "h"), (3, GOOD, None)], SCHEMA)
    clashing = plain.selectExpr("doc_id", "7 AS N_WORDS", "text", "8 AS _words", "9 AS _bad", "10 AS `a.b`", "source", "'k' AS kept", "true AS base_failed", "1 AS given_kept", "2 AS doc", "3 AS host_rejected", "4 AS _host")
    got, want = Q.quality(clashing), Q.quality(plain)
    results = want.columns[2:]
    assert got.columns == ["doc_id", "given_N_WORDS", "_words", "_bad", "a.b", "source", "given_given_kept", "given_base_failed", "given_kept", "doc", "given_host_rejected", "_host", *results]
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "source", *results).collect()))
    assert pick(got) == pick(want)
    given = [c for c in got.columns[1:12] if c != "source"]
    assert {tuple(r) for r in got.select(*[f"`{c}`" for c in given]).collect()} == {(7, 8, 9, 10, "k", True, 1, 2, 3, 4)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Q.quality(df).collect() == [] and Q.keep_good(df).collect() == []


@pytest.mark.parametrize("cpu", [True])
def test_no_python_on_the_path(spark, cpu):
    plan = Q.quality(spark.createDataFrame([(1, GOOD, "h")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
