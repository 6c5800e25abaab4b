"""License scans: exact set-similarity join of text windows with license templates. Column expressions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, literal_table

# --- fixed values ----------------------------------------------------------------------------------------------

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# public one-line notices and first sentences of license texts, by the label the method gives
TEMPLATES = {
    "notice:apache-2.0": "Licensed under the Apache License, Version 2.0",
    "notice:cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "notice:gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "notice:mit": "Released under the MIT License",
    "text:apache-2.0": "you may not use this file except in compliance with the License",
    "text:bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                "provided that the following conditions are met",
    "text:gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation",
    "text:mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files",
    "text:mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

# the word without which a notice says nothing of that license; texts of licenses are long enough to need none
NAMES = {
    "notice:apache-2.0": "apache",
    "notice:cc-by-4.0": "commons",
    "notice:gpl-3.0": "gnu",
    "notice:mit": "mit",
    "text:mpl-2.0": "mozilla",
}

# ---------------------------------------------------------------------------------------------------------------

CONTAINMENT = 0.8
STRETCH = 2  # a window has this many times the words of its template
PIECE = 512  # words of a text that are searched in one row
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # between words, where letters have either case
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def lowered(text: Column) -> Column:
    return F.translate(text, LETTERS, LETTERS.lower())


def phrase_pattern(phrases: dict[str, str]) -> str:
    """One pattern for all phrases: no phrase ends with a word that starts another, so matches never overlap."""
    either = "|".join(GAP.join(map(re.escape, p.split())) for p in phrases)
    return f"(?i)(?<!{WORD})(?:{either})(?!{WORD})"


def phrase_places(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (distinct labels) for every row.

    The words before a place are counted in the text between matches, so only texts with a match are cut.
    """
    pattern, every = F.lit(phrase_pattern(phrases)), F.lit(f"{WORD}+")
    text = F.coalesce("text", F.lit(""))

    def label(match: Column) -> Column:
        plain = F.regexp_replace(lowered(match), GAP, " ")
        return F.element_at(F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair]), plain)

    def places(found: Column) -> Column:
        parts = F.split(text, phrase_pattern(phrases))
        last = F.regexp_count(F.element_at(parts, -1), every) + F.regexp_count(F.element_at(found, -1), every)
        some = F.size(found) > 0
        return F.struct(
            F.size(found).cast("long").alias("n_base"),
            F.when(some, F.regexp_count(F.element_at(parts, 1), every)).cast("long").alias("first_word"),
            F.when(some, last).cast("long").alias("from_end"),
            F.array_sort(F.array_distinct(F.transform(found, label))).alias("base"))

    return (docs.select("doc_id", F.regexp_count(text, every).cast("long").alias("n_words"),
                        F.explode(F.array(let(F.regexp_extract_all(text, pattern, F.lit(0)), places))).alias("p"))
            .select("doc_id", "n_words", "p.n_base", "p.first_word",
                    (F.col("n_words") - F.col("p.from_end")).alias("last_word"), "p.base"))


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens, rarest in all documents first; ties by the token."""
    held = literal_table(docs.sparkSession, [{"token": t} for t in vocabulary], "token string")
    counts = (docs.select(F.explode(F.split(F.lower("text"), GAP)).alias("token"))
              .join(F.broadcast(held), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect())
    seen = {r["token"]: r["n"] for r in counts}
    return sorted(vocabulary, key=lambda t: (seen.get(t, 0), t))


def contained_templates(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = CONTAINMENT,
                        stretch: int = STRETCH, names: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, label, score): templates of which a window of the text holds at least ``threshold`` of the tokens, and
    among them the one that ``names`` gives for the label.

    A window is ``stretch`` times as many words as the template has, in a row, whatever the lines. Tokens are
    ranked by their frequency in all documents, rarest first. A template of n tokens needs a =
    ceil(threshold * n) common ones, so one of its first n - a + 1 tokens is in every matching window (prefix
    filter). The words within a window's length of such a token need a tokens of the vocabulary (length
    filter), and the tokens after the matched one must suffice on both sides (positional filter). What passes
    is compared exactly in every window that holds the matched token, so every match is found and nothing
    else. The templates are parameters, so the prefix index has a bounded size and is broadcast. Texts are
    cut into pieces of PIECE words and the windows around them, so rows have a bounded size too.
    """
    lists = {label: re.findall("[0-9a-z]+", text.lower()) for label, text in templates.items()}
    order = token_order(docs, sorted({t for held in lists.values() for t in held}))
    place = {t: i for i, t in enumerate(order)}
    index = []
    for label, held in lists.items():
        ranked = sorted(set(held), key=place.get)
        needed = math.ceil(threshold * len(ranked) - 1e-9)
        index += [{"token": t, "label": label, "i": i, "needed": needed, "template": ranked,
                   "name": (names or {}).get(label), "span": stretch * len(held)} for i, t in enumerate(ranked[:len(ranked) - needed + 1])]
    prefix = literal_table(docs.sparkSession, index,
                           "token string, label string, i int, needed int, template array<string>, name string, span int")
    ranked_vocabulary = F.array(*map(F.lit, order))
    rare = sorted({r["token"] for r in index})
    reach = max(r["span"] for r in index) - 1

    def pieces(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(PIECE)), lambda at: F.struct(
            F.least(at, F.lit(reach)).alias("start"),
            F.slice(words, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)) + PIECE + reach).alias("words")))

    def probed(words: Column, start: Column) -> Column:
        own = F.sequence(start, F.least(start + PIECE, F.size(words)) - 1)
        return F.transform(F.filter(own, lambda k: F.get(words, k).isin(rare)), lambda k: F.struct(
            F.get(words, k).alias("token"), F.least(k, F.lit(reach)).alias("at"),
            F.slice(words, F.greatest(k - reach, F.lit(0)) + 1, F.least(k, F.lit(reach)) + reach + 1).alias("near")))

    cut = docs.where("text is not null").select(
        "doc_id", F.explode(let(F.split(lowered(F.col("text")), GAP), pieces)).alias("piece"))
    probes = cut.select("doc_id", F.explode(probed(F.col("piece.words"), F.col("piece.start"))).alias("probe"))
    before = F.least(F.col("at"), F.col("span") - 1)
    met = (probes.select("doc_id", "probe.*").join(F.broadcast(prefix), "token")
           .withColumn("near", F.slice("near", F.col("at") - before + 1, before + F.col("span")))
           .withColumn("at", before)
           .withColumn("held", F.array_intersect(ranked_vocabulary, F.col("near"))))
    n, i, j = F.size("template"), F.col("i"), F.array_position("held", F.col("token")).cast("int") - 1
    possible = F.least(i, j) + 1 + F.least(n - i - 1, F.size("held") - j - 1)
    windows = F.transform(F.sequence(F.lit(1), F.col("at") + 1), lambda first: let(
        F.array_intersect("template", F.slice("near", first, F.col("span"))),
        lambda common: F.when(F.col("name").isNull() | F.array_contains(common, F.col("name")), F.size(common)).otherwise(0)))
    return (met.where(F.size("held") >= F.col("needed")).where(possible >= F.col("needed"))
            .where(F.size(F.array_intersect("template", "near")) >= F.col("needed"))
            .select("doc_id", "label", "needed", n.alias("n"), F.array_max(windows).alias("overlap"))
            .where("overlap >= needed").select("doc_id", "label", (F.col("overlap") / F.col("n")).alias("score")))


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
                 threshold: float = CONTAINMENT) -> DataFrame:
    """Per row the places of the phrases, and labels of phrases and of contained templates with their ``NAMES``.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. ``score`` is the
    largest share of a template that a window holds, 0 where no template reaches the threshold. Null and empty
    texts have no words and no labels. Rows that share a doc_id share the labels found by containment; an empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    found = contained_templates(docs, templates, threshold, names=NAMES).groupBy(F.col("doc_id").alias("found_id")).agg(
        F.collect_set("label").alias("more"), F.max("score").alias("score"))  # as many labels as templates at most
    none = F.array().cast("array<string>")
    return (phrase_places(docs, phrases).join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
            .select("doc_id", "n_words", "n_base", "first_word", "last_word",
                    F.array_join("base", ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
