"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm.common import LOWER, UPPER, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text that is not lower-cased yet.
RAW_WORD, NOT_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The notices by which these licenses are named in texts.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "Copyright. All rights reserved. No part may be reproduced without written permission"),
]
CONTAINMENT = 0.8
#: A block is a line, or two or three neighbouring ones: the longest notice, wrapped at 70 columns, goes over three.
BLOCK_LINES = 3


def _plain(text):
    return F.translate(text, UPPER, LOWER)


def _words(text):
    """Words of a text whose A-Z are lower-cased already."""
    return F.array_remove(F.split(text, NOT_WORD), "")


def token_order(docs: DataFrame, vocabulary: list[str], text: str = "text") -> list[str]:
    """The vocabulary by rising number of texts that hold a token (ties: by token), counted over all rows."""
    held = F.array_intersect(_words(_plain(F.coalesce(F.col(text), F.lit("")))), F.array(*[F.lit(t) for t in vocabulary]))
    counts = dict(docs.select(F.explode(held).alias("t")).groupBy("t").count().collect())  # one row for each token of the templates at most
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def find_templates(docs: DataFrame, keep: list[str], text: str = "text", templates: list[tuple[str, str]] | None = None, least: float = CONTAINMENT) -> DataFrame:
    """``keep``, block (line number from 0), lines, template (its place in the list), label and containment: every block of a text
    that holds ``least`` or more of a template's distinct tokens. Blocks are one to BLOCK_LINES neighbouring lines; of a template's
    blocks in one text those with the fewest lines are reported, so a wrapped notice is found, and one on a line by its line.

    Tokens are ordered by frequency over all texts, rarest first. A template of n tokens needs a = ceil(least * n) of them, so one
    of its n - a + 1 rarest must be in the block: texts and blocks without such a token stop there (prefix), as do those with fewer
    template tokens than the smallest a (length). A shared prefix token at place i of the template and j of the block's tokens leaves room
    for 1 + min of what follows either; less than a ends the pair (position). The rest is counted exactly. No pair is lost.
    """
    templates = TEMPLATES if templates is None else templates
    sets = [sorted(set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t)))) for _, t in templates]
    vocabulary = sorted({t for s in sets for t in s})
    rank = {t: i for i, t in enumerate(token_order(docs, vocabulary, text))}
    ordered = [sorted(s, key=rank.get) for s in sets]
    need = [math.ceil(least * len(s) - 1e-9) for s in ordered]
    index = [(t, k, i, len(s), need[k]) for k, s in enumerate(ordered) for i, t in enumerate(s[: len(s) - need[k] + 1])]
    prefixes = F.array(*[F.lit(t) for t in sorted({x[0] for x in index})])
    in_order = F.array(*[F.lit(t) for t in sorted(vocabulary, key=rank.get)])

    plain = _plain(F.coalesce(F.col(text), F.lit("")))
    may = lambda own: (F.size(own) >= min(need)) & F.arrays_overlap(own, prefixes)
    # array_intersect keeps the order of its first array: tokens come out rarest first. Whole texts first, blocks only of what is left.
    held = docs.select(*keep, plain.alias("__text")).withColumn("__own", F.array_intersect(in_order, _words(F.col("__text")))).where(may("__own"))
    by_line = held.select(*keep, F.transform(F.split("__text", "\n", -1), lambda line: F.array_intersect(in_order, _words(line))).alias("__lines"))
    n = F.size("__lines")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(BLOCK_LINES), n - i)), lambda w: F.struct(
        i.alias("block"), w.alias("lines"), F.array_intersect(in_order, F.flatten(F.slice("__lines", i + 1, w))).alias("own")))))
    blocks = by_line.select(*keep, F.explode(F.filter(spans, lambda s: may(s["own"]))).alias("__b")).select(
        *keep, F.col("__b.block").alias("block"), F.col("__b.lines").alias("lines"), F.col("__b.own").alias("__own"))
    spark = docs.sparkSession
    sides = spark.createDataFrame(index, "__token string, template int, __i int, __n int, __need int")
    each = blocks.select(*keep, "block", "lines", "__own", F.posexplode("__own").alias("__j", "__token"))
    room = 1 + F.least(F.col("__n") - F.col("__i") - 1, F.size("__own") - F.col("__j") - 1)
    # The first shared prefix token decides: what stands before it in either order is not shared.
    pairs = each.join(sides, "__token").groupBy(*keep, "block", "lines", "template", "__n", "__need").agg(
        F.first("__own").alias("__own"), F.min(F.struct("__j", room.alias("room"))).alias("__first")).where(F.col("__first.room") >= F.col("__need"))
    full = spark.createDataFrame([(k, templates[k][0], s) for k, s in enumerate(ordered)], "template int, label string, __tokens array<string>")
    shared = F.size(F.array_intersect("__own", "__tokens"))
    found = pairs.join(full, "template").where(shared >= F.col("__need")).select(*keep, "block", "lines", "template", "label", (shared / F.col("__n")).alias("containment"))
    fewest = found.groupBy(*keep, "template").agg(F.min("lines").alias("lines"))
    keys = [*keep, "template", "lines"]
    same = _all([found[c].eqNullSafe(fewest[c]) for c in keys])
    return found.join(fewest, same, "left_semi")


def phrase_places(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_words and places, an array of (start, label) of every fixed phrase; positions count words from 0.

    Only texts in which a phrase may stand (a pattern over the plain text says so) have their words laid out.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    may = "(?i)(?:" + "|".join(NOT_RAW_WORD.join(p.split()) for p in PHRASES) + ")"
    n = F.length(F.regexp_replace(F.regexp_replace(t, RAW_WORD, "w"), NOT_RAW_WORD, ""))
    out = docs.select(*keep, n.cast("long").alias("n_words"), F.when(t.rlike(may), _words(_plain(t))).alias("__w"))

    def found(phrase: str, label: str):
        parts = phrase.split()
        hit = lambda i: [F.get("__w", i + k) == p for k, p in enumerate(parts)]
        at = F.filter(F.sequence(F.lit(0), F.size("__w") - 1), lambda i: F.coalesce(_all(hit(i)), F.lit(False)))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    places = F.when(F.size("__w") > 0, F.concat(*[found(p, lab) for p, lab in PHRASES.items()]))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return out.select(*keep, "n_words", F.coalesce(places, none).alias("places"))


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and templates found in every document; score is the largest containment (a fixed phrase stands whole: 1).

    Rows are matched by doc_id and text, so repeated and null ids keep their own labels.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = find_templates(docs, ["__mark"])
    more = found.groupBy("__mark").agg(F.collect_set("label").alias("__labels"), F.max("containment").alias("__score"))
    places = phrase_places(docs, ["doc_id", "__mark"])
    base = places.select("doc_id", "__mark", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
                         F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"), F.array_distinct(F.transform("places", lambda p: p["label"])).alias("__base"))
    both = base.join(more, "__mark", "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("__base"), ",").alias("base_labels"),
                       F.array_join(F.sort_array(F.array_union("__base", F.coalesce("__labels", none))), ",").alias("labels"),
                       F.greatest(F.coalesce("__score", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"))


QUERIES = {"op8_license_scan": (op8_license_scan, None)}
