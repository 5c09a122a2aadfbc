"""License scans by an exact set-similarity join with templates, in DataFrame operations only.

Every text is cut into overlapping blocks of words, and a block belongs to a template if it holds
at least ``threshold`` of the template's distinct words. The join is exact and filtered:

- tokens have one global order, rarest in the corpus first;
- prefix filter: a block that meets the threshold holds one of the first n - need + 1 tokens of
  the template, so only blocks with such a token are looked at;
- length filter: a block with fewer distinct template tokens than needed is dropped;
- positional filter: what is left of the template behind the first match must still be enough.

Templates are a parameter of the job, not data: their number is checked, and they are broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize

#: Words are runs of digits, lower-case ASCII letters and non-ASCII characters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Templates of the registered query: label and text.
TEMPLATES = [
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("all-rights-reserved", "All rights reserved No part of this work may be reproduced without written permission"),
]
THRESHOLD = 0.9
MAX_TEMPLATES = 10_000
#: Blocks in a segment of a text.
BLOCKS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_line(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each with one space before and one space behind it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD, " ")), F.lit(" "))


def _words(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def phrase_places(line: Column, phrase: str) -> Column:
    """Where, counted in words from 0, a phrase begins in a line of words."""
    words = _words(phrase)
    found = " ".join(words)
    # a look-ahead for the last space lets two places share it; the text before a place counts its words
    before = F.split(line, f" (?={found} )")
    sizes = F.transform(before, lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))))
    # the first part begins with one space for each word; a later part has lost the space in front of it
    ends = F.transform(F.sequence(F.lit(1), F.size(before) - 1), lambda k: F.aggregate(
        F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, b: a + b) + k - 1)
    return F.when(F.contains(line, F.lit(f" {found} ")), ends).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Find license phrases and license templates in whole texts; one row out per row in.

    Returns the id, ``n_words``, ``n_base`` (places where a phrase's words stand consecutively),
    ``first_word`` and ``last_word`` (smallest and largest such place in words from 0, else null),
    ``base_labels``, ``labels`` (those and the labels of templates met; both distinct, sorted,
    joined by commas; empty if none) and ``score`` (1 where a phrase stands, else the largest
    share of a template's words in a block that meets the threshold, else 0). Blocks are twice as
    long as the longest template and overlap by half, so every run of words as long as a template
    lies in one block. Null and empty texts have no words. Repeated rows and ids are kept apart.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    spark = docs.sparkSession
    sets = [(i, label, sorted(set(_words(text)))) for i, (label, text) in enumerate(templates) if _words(text)]
    half = max([len(_words(text)) for _, text in templates] + [1])
    vocabulary = sorted({w for *_, s in sets for w in s})

    # Rows carry a number from their place. A text is cut into segments of BLOCKS blocks, so a very
    # long one becomes many rows; what a segment holds of the vocabulary is written once, with the
    # facts of the whole text beside its first segment.
    line = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), word_line(F.col(text_col)).alias("line"))
    none = F.array().cast("array<string>")
    places = F.array_sort(F.concat(F.array().cast("array<int>"), *[phrase_places(F.col("line"), p) for p, _ in phrases]))
    base = F.array_sort(F.array_distinct(F.array_compact(F.concat(none, *[F.array(
        F.when(F.contains("line", F.lit(f" {' '.join(_words(p))} ")), F.lit(name))) for p, name in phrases]))))
    words = F.when(F.length("line") > 2, F.split(F.expr("substring(line, 2, length(line) - 2)"), " ")).otherwise(none)
    long = BLOCKS * half
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.size("words") / long).cast("int")) - 1),
                      lambda k: F.slice("words", k * long + 1, F.lit(long + half)))
    seen = line.select("id", "row", places.alias("places"), base.alias("base"), words.alias("words")).select(
        "row", "id", "places", "base", F.size("words").alias("n_words"), F.posexplode(cut).alias("segment", "own"))
    spots = F.when(F.size("own") > 0, F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: F.get("own", i).isin(vocabulary)))
    known = F.transform(spots, lambda i: F.struct(F.get("own", i).alias("w"), i.alias("i")))
    first = F.col("segment") == 0
    seen = materialize(seen.select("row", "segment", *[F.when(first, F.col(c)).alias(c) for c in ("id", "places", "base", "n_words")], known.alias("known")))

    # the global order: how often each template token occurs; at most one row per token of the templates
    in_text = F.filter("known", lambda k: k["i"] < long).getField("w")  # not the words shared with the next segment
    counts = {r["w"]: r["n"] for r in seen.select(F.explode(in_text).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    prefix_rows, whole = [], []
    for i, label, tokens in sets:
        tokens = sorted(tokens, key=lambda w: (counts.get(w, 0), w))
        need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
        whole.append((i, label, tokens, len(tokens), need))
        prefix_rows += [(w, i, at) for at, w in enumerate(tokens[:len(tokens) - need + 1])]
    prefix = spark.createDataFrame(prefix_rows, "token string, template int, place int")
    whole = spark.createDataFrame(whole, "template int, label string, tokens array<string>, n int, need int")
    index = prefix.join(F.broadcast(whole), "template")

    # blocks that hold a prefix token; a word at place i lies in the blocks i // half and i // half - 1
    first_tokens = sorted({r[0] for r in prefix_rows})
    near = F.array_distinct(F.flatten(F.transform(F.filter("known", lambda k: k["w"].isin(first_tokens)), lambda k: F.array(
        F.floor(k["i"] / half), F.floor(k["i"] / half) - 1))))
    blocks = seen.select("row", "segment", "known", F.explode(F.filter(near, lambda b: (b >= 0) & (b < BLOCKS))).alias("block"))
    held = F.array_distinct(F.transform(F.filter("known", lambda k: F.floor(k["i"] / half).isin(F.col("block"), F.col("block") + 1)), lambda k: k["w"]))
    blocks = blocks.select("row", held.alias("held"))
    tries = blocks.select("row", "held", F.explode("held").alias("token")).join(F.broadcast(index), "token")
    left_over = F.col("n") - F.col("place")  # tokens of the template from this place on: earlier ones are tried at their own place
    tries = tries.filter((F.size("held") >= F.col("need")) & (left_over >= F.col("need")))
    share = F.size(F.array_intersect("held", "tokens"))
    met = tries.withColumn("share", share).filter(F.col("share") >= F.col("need"))
    met = met.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("share") / F.col("n")).alias("best"))

    got = seen.filter("segment = 0").select("id", "row", "n_words", "places", "base").join(met, "row", "left")
    all_labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    some = F.size("places") > 0
    return got.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.when(some, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
