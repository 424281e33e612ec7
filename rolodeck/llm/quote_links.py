"""Operator 4, quotation linking of message threads.

Messages in mail style quote what they answer with ``>`` marks, nested by
level. Each text is parsed into its own words and its quoted passages;
passages are normalised and hashed, and joined to the messages whose own words
(whole, or one paragraph) have that hash. A reply quotes its parent's words at
level one and the parent's own quote at level two, so the pair of hashes names
the parent even where many messages have the same words; replies that keep one
level fall back on it. Of several candidates the latest earlier message is
meant, by an as-of lookup that spreads a frequent passage over many tasks (see
asof.py) and never pairs all who wrote it with all who quote it. Threads follow
the parent links by pointer doubling and are ordered by time, each reply after
what it answers, without the quotes.

Messages: msg_id (unique string), sent (any ordered type), author, text.

Defined cases: null and empty texts have no words and cannot be quoted; a
message that quotes nothing known begins a thread; rows that repeat a msg_id
are one message (the least of them); messages without msg_id or sent are
threads of their own without thread_id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolodeck.llm.asof import latest_earlier
from rolodeck.llm.staging import Staged, staged
from rolodeck.operators.ranking import position_within

_MARKS = re.compile(r"[ \t]?((?:>[ \t]?)+)")
#: The line that a mail program puts before a quote.
_ATTRIBUTION = re.compile(r"^[ \t]*(On .{1,200} wrote|.{1,200} writes):[ \t]*$")


def parsed(text: str | None) -> list[tuple[int, str]]:
    """The passages of a text in order, with their quote level (0: the author's own words), without attribution lines."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        said = line[m.end() :] if m else line
        if _ATTRIBUTION.match(said):
            continue
        if out and out[-1][0] == level:
            out[-1][1].append(said)
        else:
            out.append((level, [said]))
    return [(level, "\n".join(lines).strip()) for level, lines in out if any(x.strip() for x in lines)]


def passage_hash(text: str) -> str | None:
    """128 bits of a passage, whatever its case and line breaks; None without words."""
    words = text.lower().split()
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if words else None


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """body; hashes of the body and its paragraphs; (first level-one hash, hash of what follows it at level two), per quote."""
    for batch in batches:
        bodies, own, quotes = [], [], []
        for text in batch.column("text").to_pylist():
            passages = parsed(text)
            mine = [p for level, p in passages if level == 0]
            body = "\n".join(mine)
            paragraphs = [x for p in mine for x in re.split(r"\n[ \t]*\n", p)]
            own.append([h for h in dict.fromkeys(map(passage_hash, [body, *mine, *paragraphs])) if h])
            found = []
            for k, (level, p) in enumerate(passages):
                if level == 1 and (h := passage_hash(p)):
                    below = passages[k + 1] if k + 1 < len(passages) and passages[k + 1][0] == 2 else None
                    found.append({"one": h, "two": passage_hash(below[1]) if below else None})
            bodies.append(body)
            quotes.append(found)
        kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("one", pa.string()), ("two", pa.string())])))
        rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*rest, *[pa.array(x, t) for x, t in zip((bodies, own, quotes), kinds)]], [*names, "body", "own", "quotes"])


def _parents(messages: DataFrame) -> DataFrame:
    """(msg_id, parent_id) by the first quote whose passage is known."""
    origin = F.coalesce(F.get(F.col("quotes"), F.lit(0))["one"], F.lit(""))
    asked = messages.select("msg_id", "sent", F.posexplode("quotes").alias("n", "q")).select("msg_id", "sent", "n", "q.one", "q.two")
    answers = messages.select("msg_id", "sent", F.explode("own").alias("one"), origin.alias("origin"))

    def lookup(asked_key, answer_key, rank):
        # at the same time questions come first, so that a message is not earlier than itself
        both = asked.select(asked_key.alias("key"), "sent", F.lit(False).alias("known"), "msg_id", "n", F.lit(None).cast("string").alias("found")).unionByName(
            answers.select(answer_key.alias("key"), "sent", F.lit(True).alias("known"), "msg_id", F.lit(0).alias("n"), F.col("msg_id").alias("found")))
        hit = latest_earlier(both, ["key"], ["sent", "known", "msg_id", "n"], "found", "parent_id").where("NOT known AND parent_id IS NOT NULL")
        return hit.select("msg_id", F.struct(F.lit(rank).alias("rank"), F.col("n"), F.col("parent_id")).alias("hit"))

    exact = lookup(F.concat_ws("/", "one", F.coalesce("two", F.lit(""))), F.concat_ws("/", "one", "origin"), 0)
    loose = lookup(F.col("one"), F.col("one"), 1)
    return exact.unionByName(loose).groupBy("msg_id").agg(F.min("hit").alias("hit")).select("msg_id", "hit.parent_id")


def _rooted(links: DataFrame) -> DataFrame:
    """(msg_id, parent_id, thread_id, depth): pointers to an ancestor double their reach; those at a root stand still."""
    columns = ("msg_id", "parent_id", "up", "depth", "done")
    none = F.col("parent_id").isNull()
    now = Staged(links.select("msg_id", "parent_id", F.coalesce("parent_id", "msg_id").alias("up"), (~none).cast("int").alias("depth"), none.alias("done")), "threads")
    while not now.df.where("NOT done").isEmpty():
        above = now.df.select(F.col("msg_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("top"))
        moved = now.df.where("NOT done").join(above, "up").select("msg_id", "parent_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("done"))
        after = Staged(now.df.where("done").select(*columns).unionByName(moved), "threads")
        now.drop()
        now = after
    return now.df.select("msg_id", "parent_id", F.col("up").alias("thread_id"), "depth")


def conversations_by_quotes(messages: DataFrame) -> DataFrame:
    """(thread_id, position, depth, msg_id, parent_id, author, body): threads in reply order without quotes."""
    messages = messages.select(F.col("msg_id").cast("string").alias("msg_id"), "sent", "author", "text")
    known = messages.where("msg_id IS NOT NULL AND sent IS NOT NULL").groupBy("msg_id").agg(F.min(F.struct("sent", "author", "text")).alias("m")).select("msg_id", "m.sent", "m.author", "m.text")
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    schema = f"msg_id string, sent {kinds['sent']}, author string, body string, own array<string>, quotes array<struct<one:string,two:string>>"
    described = staged(known.mapInArrow(_described, schema), "messages")
    links = described.select("msg_id").join(_parents(described.select("msg_id", "sent", "own", "quotes")), "msg_id", "left")
    told = described.select("msg_id", "sent", "author", "body").join(_rooted(links), "msg_id")
    # ranked without the texts, which are joined to the places afterwards
    placed = position_within(told.select("thread_id", "sent", "msg_id"), ["thread_id"], [F.col("sent"), F.col("msg_id")], out="position").select("msg_id", F.col("position").cast("long").alias("position"))
    columns = ["thread_id", "position", "depth", "msg_id", "parent_id", "author", "body"]
    threads = told.join(placed, "msg_id").select(*columns)
    lone = messages.where("msg_id IS NULL OR sent IS NULL").mapInArrow(_described, schema)
    none = F.lit(None).cast("string")
    return threads.unionByName(lone.select(none.alias("thread_id"), F.lit(1).cast("long").alias("position"), F.lit(0).alias("depth"), "msg_id", none.alias("parent_id"), "author", "body"))


#: Turns of a conversation have message numbers below this.
MOST_TURNS = 1 << 20


def as_mail(conversations: DataFrame) -> DataFrame:
    """The messages of an exchange by mail: each turn answers the one before it and quotes it, and that one's quote, below its words.

    Messages carry no thread or parent: (msg_id, sent, author, text). Of turns that are there twice the least counts as quoted.
    """
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    once = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def before(n):
        return once.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(f"said{n}"))

    quoted = lambda c: F.regexp_replace(c, "(?m)^", "> ")
    inner = F.when(F.col("said2") != "", F.concat(F.lit("\nOn that day they wrote:\n"), quoted(F.col("said2")))).otherwise("")
    quote = F.when(F.col("said1") != "", F.concat(F.lit("\n\nOn this day they wrote:\n"), quoted(F.concat(F.col("said1"), inner)))).otherwise("")
    rows = turns.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    sent = F.col("conv_id") * MOST_TURNS + F.col("turn")
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return rows.select(F.when(named, F.concat_ws("-", "conv_id", "turn")).alias("msg_id"), sent.alias("sent"), F.col("role").alias("author"), F.concat(F.col("text"), F.coalesce(quote, F.lit(""))).alias("text"))
