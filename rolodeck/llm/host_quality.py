"""Operator 3, quality rules per document and per host.

Every document is judged by rules on its words (repeated five-word windows,
too few words) and counted per host by further rules (symbols, repeated
lines). A host's failure rate of each rule is shrunk towards all hosts' rate
with a beta prior fitted to the hosts (empirical Bayes, method of moments), so
that a host with three documents is not condemned by two of them; a host whose
shrunk rate passes ``max_rate`` for any rule loses all its documents.

DataFrame functions only. The word and window rules are array expressions
within a row (n log n in the words of a text, nothing is exploded), the host
counts are map-side combined sums, the prior is one row per rule.

Defined cases: null or empty text has no words and fails ``short``; a null
host has no host verdict; repeated rows are judged as rows; an empty table
gives an empty result; columns of any other name are carried along. Windows are compared by a 64-bit hash inside one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolodeck.llm.staging import staged

#: Characters between words (\x20 and \x09-\x0D).
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: A rule fails when 100 * part > percent * whole.
REPEAT_PERCENT, SYMBOL_PERCENT, LINE_PERCENT = 20, 10, 30
#: Shrunk failure rate above which a host is rejected.
MAX_RATE = 0.5
#: Between-host variance below which hosts count as alike; it bounds the prior's strength.
LEAST_VARIANCE = 1e-6
RULES = ("short", "repeats", "symbols", "lines")


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long) and base_failed.

    The steps are columns of their own, each used more than once by the next, so that Catalyst evaluates an
    array once per row and not once per element of the lambda that reads it.
    """
    keep = docs.columns
    t = F.coalesce(F.col(text), F.lit(""))
    blank_free = _without(t, BLANKS)
    lines = F.filter(F.split(t, "\n"), lambda line: _without(line, BLANKS) != "")
    words = F.array_remove(F.split(F.translate(t, BLANKS, " " * len(BLANKS)), " "), "")
    d = docs.select(
        *keep,
        words.alias("_words"),
        lines.alias("_lines"),
        F.char_length(blank_free).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    window = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])
    d = d.select(
        *keep,
        "word_chars",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), window)).alias("_hashes"),
    )
    made = [*keep, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    d = d.select(*made, F.when(repeated, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    twice = F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", k + 1)["h"], F.lit(False)))
    d = d.select(*made, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_starts"))
    # each window adds the words that the window before it did not reach
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    d = d.select(*made, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def failures() -> dict[str, Column]:
    """Rule name to its test over the columns of ``measured``."""
    c = F.col
    return {
        "short": c("n_words") < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words"),
        "symbols": 100 * c("n_symbols") > SYMBOL_PERCENT * c("n_words"),
        "lines": 100 * c("n_dup_lines") > LINE_PERCENT * c("n_lines"),
    }


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """(host, rule, n, failed, rate, shrunk): one row per host and rule, with the rate shrunk by the fitted beta prior."""
    tests = failures()
    hosts = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(t.cast("long")).alias(r) for r, t in tests.items()]
    )
    long = staged(hosts.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in tests])).alias("r")).select("host", "n", "r.rule", "r.failed"), "host-rates")
    sums = long.groupBy("rule").agg(
        F.sum("n").cast("double").alias("docs"), F.count(F.lit(1)).cast("double").alias("hosts"), F.sum("failed").cast("double").alias("bad"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"),
    )
    mean = F.col("bad") / F.col("docs")
    spread = mean * (1 - mean)
    between = F.greatest(F.col("squares") / F.col("docs") - mean * mean - spread * F.col("hosts") / F.col("docs"), F.lit(LEAST_VARIANCE))
    prior = sums.select("rule", mean.alias("mean"), F.greatest(spread / between - 1, F.lit(1.0)).alias("strength"))
    # one row per rule, so at most len(RULES) rows are broadcast
    return long.join(F.broadcast(prior), "rule").select(
        "host", "rule", "n", "failed", (F.col("failed") / F.col("n")).alias("rate"),
        ((F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("shrunk"),
    )


def rejected_hosts(judged: DataFrame, host: str, max_rate: float = MAX_RATE) -> DataFrame:
    """(host): the hosts with a rule whose shrunk failure rate is above ``max_rate``."""
    return host_rates(judged, host).where(F.col("shrunk") > max_rate).select("host").distinct()


def quality(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` without ``text``, then the measures of ``measured``, base_failed, host_rejected and kept.

    The document travels as one struct, so its columns may have any names; one named like a result (in any
    case) is returned in its place as given_<name>, the results keep theirs.
    """
    columns = [c for c in docs.columns if c != text]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(text).alias("text"), F.col(host).alias("source"))
    out = _with_verdict(staged(measured(d, "text").drop("text"), "quality"), "source", max_rate)
    results = [c for c in out.columns if c not in ("doc", "source")]
    taken = {c.lower() for c in [*results, *columns]}
    names = []
    for c in columns:
        name = c
        if c.lower() in results:
            while name.lower() in taken:
                name = f"given_{name}"
            taken.add(name.lower())
        names.append(F.col("doc")[c].alias(name))
    return out.select(*names, *results)


def _with_verdict(judged: DataFrame, host: str, max_rate: float) -> DataFrame:
    # written first: its size is then known, and it is broadcast only below the session's threshold
    bad = staged(rejected_hosts(judged, host, max_rate), "rejected-hosts").select(F.col("host").alias("_host"), F.lit(True).alias("_bad"))
    out = judged.join(bad, judged[host] == bad["_host"], "left").withColumn("host_rejected", F.coalesce("_bad", F.lit(False))).drop("_host", "_bad")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that pass their own rules and whose host is not rejected; columns as given.

    The document travels as one struct, so its columns may have any names. It is measured once and written
    with its measures, as both the host counts and the verdict read them.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text).alias("text"), F.col(host).alias("source"))
    judged = staged(measured(d, "text").drop("text"), "quality-docs")
    return _with_verdict(judged, "source", max_rate).where("kept").select("doc.*")
