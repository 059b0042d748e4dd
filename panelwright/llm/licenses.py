"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm._store import forget, pick, stored

#: The phrases whose places are counted, and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Words by which notices of the usual licenses are known, and their labels. No template's words lie in one of another label.
TEMPLATES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Share of a template's different words that a block has to contain.
THRESHOLD = 0.95
#: Words of a block; blocks begin every half block, so that one of them has any passage of up to half a block and one word.
BLOCK = 64

#: What parts words, in texts whose A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def needed(size: int, threshold: float) -> int:
    """Words that a block must share with a template of ``size`` different ones."""
    return max(1, math.ceil(round(threshold * size, 9)))


def _places(w: Column, label: str, phrase: str) -> Column:
    """(at, label) of every place in the words ``w``, of which there is one at least, where the phrase's words stand consecutively."""
    parts = phrase.split()
    whole = F.array(*[F.lit(p) for p in parts])
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.get(w, i) == parts[0]) & (F.slice(w, i + 1, len(parts)) == whole))
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def digest(docs: DataFrame, phrases: Sequence[tuple[str, str]], vocabulary: Sequence[str], least: int) -> DataFrame:
    """(row, doc_id, n_words, places, blocks) of each row: its phrases' places, and the words of ``vocabulary`` in each of its blocks that has ``least`` of them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(F.coalesce("text", F.lit("")), upper, lower)
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.array_remove(F.split("text", BETWEEN), "").alias("w"))
    w = F.col("w")
    may = F.lit(False)
    for _, phrase in phrases:
        may |= F.contains("text", F.lit(max(phrase.split(), key=len)))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    places = F.when(may & (F.size(w) > 0), F.concat(*[_places(w, *p) for p in phrases])).otherwise(none)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - BLOCK) / (BLOCK // 2)).cast("int"), F.lit(0)))
    known = F.array(*[F.lit(v) for v in vocabulary])
    blocks = F.filter(F.transform(starts, lambda i: F.array_intersect(F.slice(w, i * (BLOCK // 2) + 1, BLOCK), known)), lambda b: F.size(b) >= least)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size(w).cast("long").alias("n_words"), places.alias("places"), blocks.alias("blocks"))


def matches(blocks: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(row, label, score) of each block (row, block) that contains ``threshold`` of a template's words, by an exact set-similarity join.

    Words are ordered by the number of blocks that have them, rarest first. A block and a template that share enough
    words share one among the first of each: as many as may be missing, and one. Blocks with fewer words than are needed
    drop out by length; a shared word so late that the rest of either side cannot make up the number drops out by its
    place; what is left is compared whole.
    """
    spark = blocks.sparkSession
    sets = [(label, set(words.split())) for label, words in templates]
    counts = {r["word"]: r["count"] for r in blocks.select(F.explode("block").alias("word")).groupBy("word").count().collect()}  # one row a word of the templates
    order = sorted({w for _, s in sets for w in s}, key=lambda w: (counts.get(w, 0), w))
    entries = []
    for label, s in sets:
        words, o = [w for w in order if w in s], needed(len(s), threshold)
        entries += [(word, i, label, words, o) for i, word in enumerate(words[: len(words) - o + 1])]
    table = spark.createDataFrame(entries, "word string, i int, label string, words array<string>, needed int")  # a row for each prefix word of the templates
    least = min(e[4] for e in entries)
    ordered = blocks.select("row", F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("block")).alias("block"))
    prefix = F.slice("block", 1, F.size("block") - least + 1)
    found = ordered.where(F.size("block") >= least).select("row", "block", F.posexplode(prefix).alias("j", "word")).join(F.broadcast(table), "word")
    length = F.size("block") >= F.col("needed")
    place = (F.col("j") <= F.size("block") - F.col("needed")) & (F.least("i", "j") + F.least(F.size("words") - F.col("i"), F.size("block") - F.col("j")) >= F.col("needed"))
    both = F.size(F.array_intersect("block", "words"))
    return found.where(length & place).select("row", "label", both.alias("both"), "needed", (both / F.size("words")).alias("score")).where("both >= needed").select("row", "label", "score")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of ``docs`` (doc_id, text).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. n_base counts the places where the
    words of a phrase stand consecutively, first_word and last_word are the least and greatest word number at which one
    begins (null without), base_labels their labels. labels adds those of the templates ``threshold`` of whose different
    words lie in one block of the text (see ``matches``); blocks overlap by half and cover the whole text. Labels are
    distinct, sorted and joined by commas. score is the greatest share of a template that a block contains, among those
    that reach the threshold, 1 where a phrase occurs, and 0 where nothing is found.

    A null text, and one without words, has no words and no labels. Repeated rows, repeated and null ids are scanned each
    and stay as they are; other columns are ignored; an empty table gives an empty one. Blocks in which words of a
    template stand far apart, or in another order, count as well: the join is of sets.
    """
    sets = [set(words.split()) for _, words in templates]
    least = min(needed(len(s), threshold) for s in sets)
    rows = stored(digest(pick(docs, "doc_id", "text"), phrases, sorted(set().union(*sets)), least), "licenses")
    blocks = rows.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("block"))
    found = stored(matches(blocks, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("best")), "licenses-found")
    places, at = F.col("places"), F.transform("places", lambda p: p["at"])
    base = F.array_distinct(F.transform(places, lambda p: p["label"]))
    labels = F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))
    joined = lambda a: F.array_join(F.sort_array(a), ",")
    out = rows.drop("blocks").join(found, "row", "left").select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(labels).alias("labels"), F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
    out = stored(out, "licenses-out")
    forget(docs.sparkSession, rows, found)
    return out
