"""Operator 7 against all pairs compared."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rolodeck.llm import anchor_simhash as S
from rolodeck.llm.components import connected_components


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_by_hand(prints, ids, most=4):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            out[root(i)] = min(out.get(root(i), ids[i]), ids[i])
    return [out.get(root(i)) for i in range(len(prints))]


TEXTS = [None, "", " \t\n", "one", "ONE", "one two three four", "one two three four five", "Éa ÀB c d e f", "a b c\x0bd\x0ce f", "x " * 5000]


def test_fingerprints(spark):
    assert [S.simhash64(t) & (1 << 64) - 1 for t in TEXTS] == [print_by_hand(t) for t in TEXTS]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    native = df.where("text = 'one two three four'").selectExpr("xxhash64(text) AS h").first()[0]
    assert native == S.simhash64("one two three four")


def test_each_pair_meets_at_an_anchor():
    # of any two fingerprints within four bits, the home of either holds a copy of the other
    rng = np.random.default_rng(5)
    a = rng.integers(-(2**63), 2**63 - 1, 4000, dtype=np.int64)
    flips = np.zeros(4000, np.uint64)
    for _ in range(4):
        flips |= np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)
    b = (a.view(np.uint64) ^ flips).view(np.int64)

    def table(x):
        batch = next(S.anchored(iter([pa.RecordBatch.from_arrays([pa.array(x)], ["fp"])])))
        all_, home = {}, {}
        for anchor, fp, at_home in zip(*[c.to_pylist() for c in batch.columns]):
            all_.setdefault(fp, set()).add(anchor)
            if at_home:
                home.setdefault(fp, set()).add(anchor)
        return all_, home

    (all_a, home_a), (all_b, home_b) = table(a), table(b)
    assert all(home_a[x] & all_b[y] and home_b[y] & all_a[x] for x, y in zip(a.tolist(), b.tolist()))
    assert all(len(v) == 3 for v in home_a.values())


def clusters(rng, n):
    out = [0, 1, 3, 7, -1]
    for _ in range(n):
        x = int(rng.integers(0, 2**63))
        out.append(x)
        for _ in range(int(rng.integers(0, 6))):
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
            out.append(x)
    return [((x + 2**63) % 2**64) - 2**63 for x in out]


@pytest.mark.parametrize("bucket", [1 << 16, 8])
def test_components_equal_all_pairs(spark, bucket):
    rng = np.random.default_rng(3)
    prints = clusters(rng, 80)
    base = prints[40]
    prints += [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]  # a dense group
    links = S.fingerprint_links(spark.createDataFrame([(p,) for p in set(prints)], "fp long"), bucket=bucket)
    least = {r["node"]: r["component"] for r in connected_components(links).collect()}
    distinct = sorted(set(prints))
    want = least_by_hand([p & (1 << 64) - 1 for p in distinct], distinct)
    assert [least.get(p, p) for p in distinct] == want


def test_large_buckets_by_forest(monkeypatch):
    rng = np.random.default_rng(9)
    fps = np.unique(np.array(clusters(rng, 60), np.int64))
    home, starts = np.ones(len(fps), bool), np.array([0, len(fps)])
    whole = [sorted(zip(*[x.tolist() for x in p])) for p in S._linked(fps, home, starts, 4)]
    monkeypatch.setattr(S, "AT_ONCE", 1)
    (a, b), = S._linked(fps, home, starts, 4)

    def parts(pairs):
        return sorted(map(sorted, _groups(pairs)))

    assert parts([p for x in whole for p in x]) == parts(list(zip(a.tolist(), b.tolist())))


def _groups(pairs):
    at = {}
    for a, b in pairs:
        one, two = at.get(a, {a}), at.get(b, {b})
        if one is not two:
            one |= two
            for x in one:
                at[x] = one
    return list({id(g): g for g in at.values()}.values())


def documents(spark):
    text = " ".join(f"w{i}" for i in range(300))
    data = [(5, text), (3, text), (9, text.replace("w17 ", "v17 ")), (11, " ".join(f"z{i}" for i in range(300))), (12, None), (2, ""), (None, text), (None, "quite another text of words here"),
            (3, text), (14, "Upper Case Words Here"), (15, "upper case words here")]
    return spark.createDataFrame(data, "doc_id long, text string")


def test_documents(spark):
    df = documents(spark)
    rows = df.collect()
    prints = [print_by_hand(r["text"]) for r in rows]
    want = sorted(map(str, zip([r["doc_id"] for r in rows], [f"{p:016x}" for p in prints], least_by_hand(prints, [r["doc_id"] for r in rows]))))
    got = S.simhash_components(df).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_one_of_each(spark):
    df = documents(spark).selectExpr("doc_id", "text", "doc_id AS fp", "'x' AS component", "'y' AS row")
    got = S.one_of_each(df)
    assert got.columns == df.columns
    rows = df.collect()
    least = least_by_hand([print_by_hand(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(map(str, set(least)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).collect() == [] and S.one_of_each(df).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
