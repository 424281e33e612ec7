"""Operator 5: the share of each source at every slot, and every document placed once."""

from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolodeck.llm import pfair_mix as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_less_than_one_block_from_the_share(weights):
    had, total = Counter(), sum(weights)
    for t, k in enumerate(P.period(weights), 1):
        had[k] += 1
        assert all(abs(had[j] - Fraction(t * w, total)) < 1 for j, w in enumerate(weights))
    assert [had[k] for k in range(len(weights))] == weights


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=6))
def test_phases_place_every_block_once(sources):
    blocks, weights = [b for b, _ in sources], [w for _, w in sources]
    plan = P.phases(blocks, weights)
    slots = sorted(P.slot_of(plan, k, b) for k, n in enumerate(blocks) for b in range(n))
    assert slots == list(range(sum(blocks)))


def documents(spark, sizes, extra=""):
    data = [(i, s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(i * 7919 % 100_003, f"t{i}", s) for i, s in data], "doc_id long, text string, source string")


def test_positions(spark):
    sizes = {"a": 500, "b": 130, None: 40, "stray": 25, "c": 3}
    df = documents(spark, sizes)
    weights, block = {"a": 3, "b": 2, "c": 1, "absent": 5}, 8
    got = P.mixed(df, weights, other=2, block=block).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(sum(sizes.values())))
    assert Counter(r["source"] for r in got) == Counter(sizes)
    slots = [r["slot"] for r in got]
    assert slots == sorted(slots)
    # within a source by doc_id; within the first phase each source has its share to within a block at every slot
    for s in ("a", "b", "c"):
        ids = [r["doc_id"] for r in got if r["source"] == s]
        assert ids == sorted(ids)
    pools = {"a": 3, "b": 2, "c": 1, "other": 2}
    first = {r["slot"]: r["source"] if r["source"] in weights else "other" for r in got if r["phase"] == 0}
    had = Counter()
    for t in range(len(first)):
        had[first[t]] += 1
        assert all(abs(had[p] - Fraction((t + 1) * w, 8)) < 1 for p, w in pools.items())


def test_order_of_the_rows(spark):
    df = documents(spark, {"a": 50, "b": 30}).selectExpr("*", "doc_id AS position", "'x' AS pool", "1 AS row")
    out = P.in_mixed_order(df, {"a": 1, "b": 1}, other=1, block=4)
    assert out.columns == df.columns
    got = [r["source"] for r in out.collect()]
    assert Counter(got) == {"a": 50, "b": 30} and set(got[:8]) == {"a", "b"} and set(got[-16:]) == {"a"}


def test_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, "t", "a"), (None, "t", "a"), (1, None, None), (1, None, None)], "doc_id long, text string, source string")
    assert sorted(r["position"] for r in P.mixed(df, {"a": 1}, other=1, block=1).collect()) == [0, 1, 2, 3]
    none = spark.createDataFrame([], df.schema)
    assert P.mixed(none).collect() == [] and P.in_mixed_order(none).collect() == []


def test_weights_are_bounded(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    for weights, other in (({"a": 0}, 1), ({"a": P.MOST_WEIGHT}, 1), ({f"s{i}": 1 for i in range(P.MOST_SOURCES)}, 1), ({}, 0)):
        with pytest.raises(ValueError):
            P.mixed(df, weights, other)
