"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

A block (a line of text, or a line with the next ones up to ``RUN_WORDS`` words, for wrapped notices) matches
a template when it contains at least ``THRESHOLD`` of the template's distinct words, and those that tell it
from its siblings. Template words are ordered by how many blocks of the whole corpus hold them, rarest
first. A matching block must hold one of the first ``|T| - need + 1`` words of the template (prefix),
enough words altogether (length), and enough words from its first common word on (position); what is
left is compared word by word. Everything is DataFrame work.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.shared import lower_ascii, numbered, text_or_empty

# every run of these characters separates words: ASCII but for digits and lower-case letters
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
# Words of a run of lines at most: more than the longest notice, with the rest of the lines it begins and ends in.
RUN_WORDS = 64
# A notice of fewer words needs all of them in a run of lines, where its common words meet by chance.
SHORT = 9
# words that tell a template from a sibling: a template that has one needs it
TELLING = ("lesser", "noncommercial", "nc")

# fixed values: phrase, label
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# label, notice; a notice's words are taken like a text's
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    need: int


def plain_words(text: Column) -> Column:
    """Words in lower case with one space between them."""
    return F.btrim(F.regexp_replace(lower_ascii(text), BREAK, " "))


def templates(threshold: float = THRESHOLD, notices=TEMPLATES) -> list[Template]:
    found = []
    for label, notice in notices:
        words = tuple(dict.fromkeys("".join(c if c.isalnum() else " " for c in notice.lower()).split()))
        found.append(Template(label, words, math.ceil(threshold * len(words))))
    return found


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def with_phrases(docs: DataFrame, text_column: str, id_column: str, notices: list[Template]) -> DataFrame:
    """One pass over the text: word counts, phrase places, and each line's words that some template has."""
    vocabulary = sorted({w for t in notices for w in t.words})
    least = min(t.need for t in notices)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_or_empty(text_column).alias("_text"))
    rows = rows.withColumn("_plain", plain_words(F.col("_text")))
    # each word gets a space of its own on either side, so that neighbouring places do not share one
    rows = rows.withColumn("_wide", F.concat(F.lit(" "), F.replace("_plain", F.lit(" "), F.lit("  ")), F.lit(" ")))
    pieces = [F.split("_wide", " " + phrase.replace(" ", "  ") + " ") for phrase, _ in PHRASES]
    rows = rows.select("doc_id", "_text", "_plain", *[p.alias(f"_p{i}") for i, p in enumerate(pieces)])
    n_words = F.when(F.col("_plain") == "", 0).otherwise(_spaces(F.col("_plain")) + 1).cast("long")
    first, last, labels, count = [], [], [], F.lit(0)
    for i, (phrase, label) in enumerate(PHRASES):
        parts = F.col(f"_p{i}")
        hit, length = F.size(parts) > 1, phrase.count(" ") + 1
        count = count + F.size(parts) - 1
        first.append(F.when(hit, F.call_function("div", _spaces(F.get(parts, F.lit(0))), F.lit(2))))
        last.append(F.when(hit, n_words - length - F.call_function("div", _spaces(F.element_at(parts, -1)), F.lit(2))))
        labels.append(F.when(hit, F.lit(label)))
    # the last space of the wide text belongs to no word when the text has none; such texts have no place either
    rows = rows.withColumn("_lines", F.filter(F.transform(
        F.split("_text", "\n"),
        lambda line: F.transform(F.array(plain_words(line)), lambda plain: F.struct(
            F.array_distinct(F.filter(F.split(plain, " "), lambda w: w.isin(vocabulary))).alias("words"),
            (_spaces(plain) + 1).alias("n"), (plain != "").alias("any")))[0]), lambda line: line["any"]))
    # a run grows by whole lines as long as they fit; a line of its own is a block in any case
    empty = F.struct(F.array().cast("array<string>").alias("words"), F.lit(0).alias("n"))
    def grown(run: Column, line: Column) -> Column:
        n = run["n"] + line["n"]
        return F.struct(F.when(n <= RUN_WORDS, F.array_union(run["words"], line["words"])).otherwise(run["words"]).alias("words"), n.alias("n"))
    runs = F.transform("_lines", lambda line, i: F.when(
        line["n"] < RUN_WORDS, F.aggregate(F.slice("_lines", i + 1, F.lit(RUN_WORDS)), empty, grown, lambda run: run["words"])))
    lines = F.filter(F.array_distinct(F.col("_lines.words")), lambda words: F.size(words) >= least)
    held = F.array_union(lines, F.array_compact(runs))
    return rows.select(
        "doc_id", n_words.alias("n_words"), count.cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("_base"),
        F.filter(held, lambda words: F.size(words) >= least).alias("_blocks"), F.size(lines).alias("_n_lines"))


def block_matches(scanned: DataFrame, notices: list[Template]) -> DataFrame:
    """Each (row, block, template label, share of the template's words) at or above the threshold."""
    spark = scanned.sparkSession
    blocks = scanned.select("_rid", "_n_lines", F.posexplode("_blocks").alias("block", "_words"))
    # one row per template word at most
    counted = {r["w"]: r["n"] for r in blocks.select(F.explode("_words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted({w for t in notices for w in t.words}, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for number, t in enumerate(notices):
        ordered = sorted(t.words, key=rank.__getitem__)
        for at, word in enumerate(ordered[: len(ordered) - t.need + 1]):
            index.append((word, number, t.label, ordered, at, t.need))
    prefix = spark.createDataFrame(index, "word string, template int, label string, words array<string>, at int, need int")
    rarest = sorted({r[0] for r in index})
    # a block's words in the same order: positions in the order, rarest first
    ordered = F.filter(F.array(*[F.lit(w) for w in order]), lambda w: F.array_contains("_words", w))
    near = blocks.where(F.arrays_overlap("_words", F.array(*[F.lit(w) for w in rarest])))
    near = near.withColumn("_ordered", ordered)
    probes = near.select("_rid", (F.col("block") >= F.col("_n_lines")).alias("run"), "block", "_ordered", F.posexplode("_ordered").alias("_at", "word"))
    pairs = probes.where(F.col("word").isin(rarest)).join(F.broadcast(prefix), "word")  # the index is as small as the templates
    held = F.size("_ordered")
    pairs = pairs.where((held >= F.col("need")) & (F.least(F.size("words") - F.col("at"), held - F.col("_at")) >= F.col("need")))
    overlap = F.size(F.array_intersect("_ordered", "words"))
    telling = F.filter("words", lambda w: w.isin(*TELLING))
    verified = pairs.withColumn("_overlap", overlap).where(
        (F.col("_overlap") >= F.when(F.col("run") & (F.size("words") < SHORT), F.size("words")).otherwise(F.col("need"))) & (F.size(F.array_except(telling, "_ordered")) == 0))
    return verified.select("_rid", "block", "label", (F.col("_overlap") / F.size("words")).alias("share")).distinct()


def scanned_licenses(docs: DataFrame, threshold: float = THRESHOLD, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Word counts, places of the phrases, labels of phrases and of matched templates, and a score.

    The score is 1 for a phrase, else the best template's share, else 0. A null text counts as empty;
    repeated rows are scanned one by one, and an empty table gives no rows.
    """
    notices = templates(threshold)
    scanned = numbered(with_phrases(docs, text_column, id_column, notices), "license-scan")
    matches = block_matches(scanned, notices).groupBy("_rid").agg(
        F.collect_set("label").alias("_found"), F.max("share").alias("_share"))
    joined = scanned.drop("_blocks").join(matches, "_rid", "left")
    empty = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("_base", F.coalesce("_found", empty)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))
