"""Operator 13, licence scans by a positional rare-token index.

The words of the licence templates and phrases are the vocabulary. A text is
written as its code: one character per word, that of the vocabulary's word or
a dot, so a word's place is a character's place and a phrase is a substring.
Document frequencies of the vocabulary (a count per word) give each word an
inverse document frequency; the index holds, per template, its rarest words
with their places, as many as carry ``INDEXED`` percent of the template's
weight. A file's occurrences of index words are looked up in the postings. Each
hit states where the template would begin (file place minus template place);
hits of a template whose beginnings differ by at most ``SLACK`` words from the
next one's are one alignment. An alignment that holds ``ENOUGH`` percent of
the indexed weight is a candidate; it counts when all key phrases of the
template stand in the words that it spans.

Only index hits are exploded and shuffled, keyed by row and template; the
vocabulary, its frequencies and the postings are bounded by the templates.
Phrases that are sought by themselves (``PHRASES``) are found in the code.

Defined cases: a null or empty text has no words, no places, '' as labels and
score 0; a text of any length is scanned whole; repeated rows and null doc_ids
are scanned as rows; other columns are kept out; an empty table gives an empty
result. A word that all documents hold still weighs 1, so equal weights are
taken in alphabetical order.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolodeck.llm.staging import staged

#: Notices of public licences, each with the phrases that it must hold (label, notice, key phrases).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("in compliance with the license", "apache org licenses")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "associated documentation files")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "free software foundation", "version 3")),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "free software foundation", "version 2")),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("extent possible under law", "related or neighboring rights")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "with or without modification")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Phrases that are labels wherever they stand.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Percent of a template's weight that is indexed, and of the indexed weight that an alignment must hold; words between two beginnings.
INDEXED, ENOUGH, SLACK = 60, 80, 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: all of ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER = "."


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[str, ...]


def templates(stated=TEMPLATES) -> list[Template]:
    return [Template(label, tuple(words_of(text)), tuple(keys)) for label, text, keys in stated]


def alphabet(known: list[Template], phrases=PHRASES) -> dict[str, str]:
    """A character for each word of the templates, their key phrases and ``phrases``."""
    words = {w for t in known for w in t.words} | {w for t in known for k in t.keys for w in words_of(k)} | {w for p, _ in phrases for w in words_of(p)}
    return {w: chr(0xE000 + i) for i, w in enumerate(sorted(words))}  # private use; never part of a coded text otherwise


def coded(docs: DataFrame, letters: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, code), written once: code has a character per word."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    words = docs.select(F.col(doc_id).alias("doc_id"), F.array_remove(F.split(lower, BETWEEN), "").alias("words"))
    letter = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    code = F.array_join(F.transform("words", lambda w: F.when(w.isin(list(letters)), letter[w]).otherwise(OTHER)), "")
    return staged(words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), code.alias("code")), "coded")


def document_frequencies(code: DataFrame, letters: dict[str, str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each word of the vocabulary (a row a word)."""
    total = code.count()
    each = code.select(F.explode(F.array_distinct(F.split(F.translate("code", OTHER, ""), ""))).alias("letter")).groupBy("letter").count()
    found = {r["letter"]: r["count"] for r in each.collect()}  # at most a row per word of the vocabulary
    return total, {w: found.get(c, 0) for w, c in letters.items()}


def weights(total: int, frequency: dict[str, int]) -> dict[str, int]:
    """Inverse document frequency in hundredths, 1 at least."""
    return {w: max(1, round(100 * math.log((total + 1) / (n + 1)))) for w, n in frequency.items()}


def index(known: list[Template], weight: dict[str, int]) -> list[tuple[int, str, int, int]]:
    """Postings (template, word, place, weight) of each template's rarest words."""
    out = []
    for t, template in enumerate(known):
        rest = sum(weight[w] for w in template.words) * INDEXED
        for w in sorted(set(template.words), key=lambda w: (-weight[w], w)):
            if rest <= 0:
                break
            places = [q for q, x in enumerate(template.words) if x == w]
            out += [(t, w, q, weight[w]) for q in places]
            rest -= 100 * weight[w] * len(places)
    return out


def _code_of(phrase: str, letters: dict[str, str]) -> str:
    return "".join(letters[w] for w in words_of(phrase))


def candidates(code: DataFrame, known: list[Template], letters: dict[str, str], postings: list[tuple[int, str, int, int]]) -> DataFrame:
    """(row, found): alignments (template, score, low, high) of a row that hold enough of the index; low, high: words spanned."""
    spark = code.sparkSession
    indexed = "".join(sorted({letters[w] for _, w, _, _ in postings}))
    rows = code.where(F.col("code").rlike(f"[{indexed}]")) if indexed else code.where(F.lit(False))
    place = F.filter(F.transform(F.split("code", ""), lambda c, i: F.struct(i.alias("at"), c.alias("letter"))), lambda x: x["letter"].isin(list(indexed)))
    hits = rows.select("row", F.explode(place).alias("x")).select("row", "x.at", "x.letter")
    posted = spark.createDataFrame([(letters[w], t, q, n) for t, w, q, n in postings], "letter string, template int, q int, weight long")
    starts = hits.join(F.broadcast(posted), "letter").select("row", "template", "q", "weight", (F.col("at") - F.col("q")).alias("start"))  # postings: bounded by the templates
    of = Window.partitionBy("row", "template").orderBy("start", "q")
    apart = F.coalesce((F.col("start") - F.lag("start").over(of) > SLACK).cast("int"), F.lit(1))
    chained = starts.withColumn("apart", apart).withColumn("alignment", F.sum("apart").over(of))
    held = chained.groupBy("row", "template", "alignment").agg(F.collect_set(F.struct("q", "weight")).alias("held"), F.min("start").alias("low"), F.max("start").alias("last"))
    sums = {t: sum(n for u, _, _, n in postings if u == t) for t in range(len(known))}
    whole = _by_template({t: F.lit(n).cast("long") for t, n in sums.items()})
    size = _by_template({t: F.lit(len(x.words)) for t, x in enumerate(known)})
    matched = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["weight"])
    full = held.withColumn("matched", matched).where(100 * F.col("matched") >= ENOUGH * whole)
    spans = full.select("row", F.struct("template", (F.col("matched") / whole).alias("score"), "low", (F.col("last") + size).alias("high")).alias("c"))
    return spans.groupBy("row").agg(F.collect_list("c").alias("found"))  # alignments of one text


def _by_template(of: dict[int, Column], template: Column | None = None) -> Column:
    template = F.col("template") if template is None else template
    chosen = F.lit(None)
    for t, value in of.items():
        chosen = F.when(template == t, value).otherwise(chosen)
    return chosen


def _holds_keys(c: Column, known: list[Template], letters: dict[str, str]) -> Column:
    low = F.greatest(c["low"], F.lit(0))
    span = F.substring(F.col("code"), low + 1, c["high"] - low)
    tests = {}
    for t, template in enumerate(known):
        ok = F.lit(True)
        for key in template.keys:
            ok = ok & F.contains(span, F.lit(_code_of(key, letters)))
        tests[t] = ok
    return _by_template(tests, c["template"])


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stated=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, licences), a row for each row of ``docs``.

    licences: (label, score, first, last) of every alignment that holds its key phrases.
    """
    known = templates(stated)
    letters = alphabet(known, phrases)
    code = coded(docs, letters, doc_id, text)
    postings = index(known, weights(*document_frequencies(code, letters)))
    joined = code.join(candidates(code, known, letters, postings), "row", "left")

    sought = [(_code_of(p, letters), label) for p, label in phrases]
    c, n = F.col("code"), F.char_length("code")
    held = [F.contains(c, F.lit(p)) for p, _ in sought]
    count = [F.when(h, F.regexp_count(c, F.lit(f"(?={p})"))).otherwise(0) for h, (p, _) in zip(held, sought)]
    first = [F.when(h, F.instr(c, p) - 1) for h, (p, _) in zip(held, sought)]
    last = [F.when(h, n - F.lit(len(p) - 1) - F.instr(F.reverse(c), p[::-1])) for h, (p, _) in zip(held, sought)]
    base = F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(held, sought)]))
    kept = F.filter(F.coalesce(F.col("found"), F.array().cast("array<struct<template:int,score:double,low:int,high:int>>")), lambda x: _holds_keys(x, known, letters))
    label = {t: F.lit(x.label) for t, x in enumerate(known)}
    rows = joined.select(
        "doc_id", "n_words", sum(count[1:], count[0]).cast("long").alias("n_base"),
        _extreme(F.least, first).cast("long").alias("first_word"), _extreme(F.greatest, last).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"), n.alias("size"), kept.alias("kept"),
    )
    licences = F.transform("kept", lambda x: F.struct(_by_template(label, x["template"]).alias("label"), x["score"].alias("score"), F.greatest(x["low"], F.lit(0)).alias("first"), (F.least(x["high"], F.col("size")) - 1).alias("last")))
    rows = rows.withColumn("licences", licences)
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.col("licences.label"))), ",").alias("labels"),
        F.coalesce(F.array_max("licences.score"), F.lit(0.0)).alias("score"), "licences",
    )


def _extreme(f, columns: list[Column]) -> Column:
    return f(*columns) if len(columns) > 1 else columns[0]
