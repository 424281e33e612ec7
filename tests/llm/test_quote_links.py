"""Operator 4: quote levels, and threads rebuilt from mail without ids."""

from rolodeck.llm import quote_links as Q

SCHEMA = "msg_id string, sent long, author string, text string"


def test_levels():
    text = "Mine\n\nOn Monday x wrote:\n> one\n> two\n>\n>> deep\n> > deeper too\n> back\nend\n>"
    assert Q.parsed(text) == [(0, "Mine"), (1, "one\ntwo"), (2, "deep\ndeeper too"), (1, "back"), (0, "end")]
    assert Q.parsed(None) == Q.parsed("") == Q.parsed("\n \n") == []
    assert Q.passage_hash("A  b\nC") == Q.passage_hash("a b c") != Q.passage_hash("a b d") and Q.passage_hash(" \n") is None


def rebuilt(spark, rows):
    got = Q.conversations_by_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r["msg_id"]: (r["thread_id"], r["position"], r["depth"], r["parent_id"], r["body"]) for r in got}


def test_tree_with_common_words_and_partial_quotes(spark):
    got = rebuilt(spark, [
        ("a", 1, "x", "Hello"), ("b", 2, "y", "Hello"),  # two threads begin alike
        ("c", 3, "z", "Answer to b\n> hello"), ("d", 4, "z", "Yes\n> Answer to b\n>> Hello"), ("e", 5, "x", "No\n> answer\n>  to b"),
        ("f", 6, "x", "Long first.\n\nSecond paragraph."), ("g", 7, "y", "On the second\n> Second paragraph."), ("h", 8, "y", "> words of nobody\nWhy?"), ("i", 9, "y", "> Yes\n>> Answer to b\nand so"), ("j", 0, "y", "> Yes"),
    ])
    assert got == {
        "a": ("a", 1, 0, None, "Hello"), "b": ("b", 1, 0, None, "Hello"), "c": ("b", 2, 1, "b", "Answer to b"), "d": ("b", 3, 2, "c", "Yes"), "e": ("b", 4, 2, "c", "No"),
        "f": ("f", 1, 0, None, "Long first.\n\nSecond paragraph."), "g": ("f", 2, 1, "f", "On the second"), "h": ("h", 1, 0, None, "Why?"), "i": ("b", 5, 3, "d", "and so"), "j": ("j", 1, 0, None, ""),
    }


def test_conversations_come_back(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", "Same first words" if t == 0 and c % 3 == 0 else f"turn {t} of {c}\nsecond line" if t != 4 else "ok") for c in range(40) for t in range(1 + c % 9)]
    got = Q.conversations_by_quotes(Q.as_mail(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    want = {(f"{c}-0", t + 1, t, f"{c}-{t}", f"{c}-{t - 1}" if t else None, role, text) for c, t, role, text in turns}
    assert {tuple(r) for r in got} == want and len(got) == len(turns)


def test_long_chain_and_hot_parent(spark):
    chain = [("m0", 0, "x", "word 0")] + [(f"m{i}", i, "x", f"word {i}\n> word {i - 1}" + (f"\n>> word {i - 2}" if i > 1 else "")) for i in range(1, 70)]
    crowd = [(f"r{i}", 1000 + i, "y", f"reply {i}\n> word 0") for i in range(200)]
    got = rebuilt(spark, chain + crowd)
    assert all(got[f"m{i}"][:4] == ("m0", i + 1, i, f"m{i - 1}" if i else None) for i in range(70))
    assert all(got[f"r{i}"][:4] == ("m0", 71 + i, 1, "m0") for i in range(200))


def test_nulls_repeats_empty(spark):
    rows = [("a", 1, None, None), ("a", 1, None, None), (None, 2, "x", "no id"), ("b", None, "x", "> a"), ("c", 3, "x", "")]
    got = Q.conversations_by_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["msg_id"]), str(r["thread_id"]), r["body"]) for r in got) == [("None", "None", "no id"), ("a", "a", ""), ("b", "None", ""), ("c", "c", "")]
    assert rebuilt(spark, []) == {}
    mail = Q.as_mail(spark.createDataFrame([(None, 0, "u", "t"), (1, None, "u", "t"), (1, 0, "u", None)], "conv_id long, turn long, role string, text string"))
    assert Q.conversations_by_quotes(mail).count() == 3
