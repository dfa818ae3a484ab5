"""License scans by diagonal voting, in DataFrame functions only.

All rolling grams of ``GRAM`` words are joined to the places where the license
templates have them. A hit votes for its diagonal, the offset of document to template;
votes are added up per diagonal, diagonals close to each other (a word more or less in
between) are merged, and each merged span is verified on the words themselves: place by
place, in order, on the merged diagonals, with the words that tell the license from its
relatives standing side by side. Base phrases are found beside it by exact search; their
labels always stay.

The templates are a constant of this module, so their gram table has a fixed size and
may be broadcast.

Edge cases: a null or empty text has no words, labels or places; rows with one id and
one text get one answer each, the same; a row without id is answered like any other;
a text may repeat a template any number of times; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulith.llm.words import id_and_text
from tabulith.session import cut_lineage

GRAM = 3
#: Diagonals this close are one span.
SLACK = 3
#: Share of a template's grams that must vote, and of its words that must stand at their places.
VOTES, WORDS = 0.6, 0.8

#: Phrases whose consecutive words name a license.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices as they are written in works.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "gpl-3": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    ),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "all-rights-reserved": ("All rights reserved.",),
}

#: What a notice must say word for word, where its template says it, to be of the license and not of a
#: relative (other GPL versions, LGPL, AGPL; CC BY, BY-SA, BY-NC-SA; MIT-0, NCSA; Apache 1.1).
DISTINGUISHING = {
    "mit": ("mit license", "deal in the software"),
    "apache-2": ("apache license version 2", "licenses license 2"),
    "cc-by-nc": ("cc by nc 4", "attribution noncommercial 4"),
    "gpl-3": ("gnu general public license", "version 3"),
    "bsd": ("source and binary forms", "are permitted"),
    "all-rights-reserved": ("all rights reserved",),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def gram(of: Column, i: Column, k: int = GRAM) -> Column:
    return F.xxhash64(*[F.get(of, i + j) for j in range(k)])


def must_stand(label: str, text: str, distinguishing=DISTINGUISHING) -> list[list[int]]:
    """Places of the distinguishing phrases that a template has."""
    w = [x for x in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if x]
    phrases = [p.split() for p in distinguishing.get(label, ())]
    return [list(range(i, i + len(p))) for p in phrases for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def template_table(spark, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """(template, label, its words, places of distinguishing phrases, place, gram) of every template."""
    rows = [(n, label, text, must_stand(label, text)) for n, (label, text) in enumerate((x, t) for x, texts in templates.items() for t in texts)]
    named = spark.createDataFrame(rows, "template int, label string, text string, must array<array<int>>").withColumn("t_words", words(F.col("text"))).drop("text")
    places = F.transform(F.sequence(F.lit(0), F.size("t_words") - k), lambda i: F.struct(i.alias("place"), gram(F.col("t_words"), i, k).alias("gram")))
    return named.withColumn("p", F.explode(places)).select("template", "label", "t_words", "must", "p.place", "p.gram")


def phrase_starts(line: Column, phrase: str) -> Column:
    """Places of a phrase: the words before each are those of the parts before it and of the phrases between them."""
    parts = F.split(line, f" {phrase}(?= )")
    counts = F.transform(parts, lambda p: F.size(F.array_remove(F.split(p, " "), "")))
    before = lambda i: F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, x: a + x) + (i - 1) * len(phrase.split())
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), before)


def base_places(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """Per row: words, places of the phrases, the first and the last of their starts, their labels."""
    line = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    rows = docs.select("doc_id", "digest", words(F.col("text")).alias("w")).select("doc_id", "digest", F.size("w").cast("long").alias("n_words"), line.alias("line"))
    starts = [F.when(F.col("line").contains(f" {p} "), phrase_starts(F.col("line"), p)).otherwise(F.array().cast("array<int>")) for p in phrases]
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, label in enumerate(phrases.values())]))
    found = rows.select("doc_id", "digest", "n_words", *[s.alias(f"p{n}") for n, s in enumerate(starts)])
    every = F.concat(*[F.col(f"p{n}") for n in range(len(phrases))])
    return found.select(
        "doc_id", "digest", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"),
    )


def spans(docs: DataFrame, templates: DataFrame, k: int = GRAM, slack: int = SLACK, votes: float = VOTES) -> DataFrame:
    """(doc_id, digest, template, first and end word, merged diagonals, share of votes) where there are enough votes."""
    w = docs.select("doc_id", "digest", words(F.col("text")).alias("w"))
    grams = w.select("doc_id", "digest", F.posexplode(F.transform("w", lambda _, i: gram(F.col("w"), i, k))).alias("pos", "gram"))
    sizes = templates.groupBy("template").agg(F.count("*").alias("grams"))
    hits = grams.join(F.broadcast(templates.select("template", "place", "gram")), "gram")
    key = ["doc_id", "digest", "template"]
    diagonals = hits.withColumn("diagonal", F.col("pos") - F.col("place")).groupBy(*key, "diagonal").agg(F.collect_set("place").alias("places"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = W.partitionBy(*key).orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > slack) | F.lag("diagonal").over(order).isNull()
    marked = diagonals.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(order))
    merged = marked.groupBy(*key, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.min("lo").alias("first"), (F.max("hi") + k).alias("end"), F.array_sort(F.collect_list("diagonal")).alias("diagonals"))
    return merged.join(F.broadcast(sizes), "template").withColumn("share", F.col("n") / F.col("grams")).filter(F.col("share") >= votes).select(*key, "first", "end", "diagonals", "share")


def stands(own: Column, t_words: Column, place: Column, diagonal: Column) -> Column:
    """Does the template's word of this place stand on this diagonal?"""
    return F.coalesce(F.get(own, place + diagonal) == F.get(t_words, place), F.lit(False))


def in_order(own: Column, t_words: Column, diagonals: Column) -> Column:
    """How many of the template's words stand on the diagonals, each behind the one before.

    A place stays on the diagonal of the last one where it can, else it takes the first diagonal on which the next
    word stands as well, so that a stray word draws nothing away.
    """
    last = F.size(t_words) - 1
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit(None).cast("int").alias("d"))

    def step(state: Column, place: Column) -> Column:
        free = lambda d: (place + d > state["at"]) & stands(own, t_words, place, d)
        other = F.array_min(F.filter(diagonals, lambda d: free(d) & ((place == last) | stands(own, t_words, place + 1, d))))
        d = F.when(state["d"].isNotNull() & free(state["d"]), state["d"]).otherwise(other)
        moved = F.transform(F.array(d), lambda x: F.when(x.isNull(), state).otherwise(F.struct((state["n"] + 1).alias("n"), (place + x).alias("at"), x.alias("d"))))
        return F.get(moved, F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), last), start, step)["n"]


def verified(docs: DataFrame, found: DataFrame, templates: DataFrame, least: float = WORDS) -> DataFrame:
    """Spans with enough of the template's words at their places, in order, and with all its distinguishing phrases."""
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
    names = templates.select("template", "label", "t_words", "must").distinct()
    ids = found.select("doc_id", "digest").distinct()
    texts = docs.join(ids, same(docs, ids), "left_semi").distinct()
    # Words beside the voting grams belong to the template too: the part begins and ends a template's length further out.
    begin = F.greatest(F.col("first") - F.size("t_words"), F.lit(0))
    placed = found.join(F.broadcast(names), "template").withColumn("begin", begin).withColumn("diagonals", F.transform("diagonals", lambda d: d - F.col("begin")))
    part = F.slice(words(F.col("text")), F.col("begin") + 1, F.col("end") + F.size("t_words") - F.col("begin"))
    held = placed.join(texts, same(placed, texts)).select(placed["doc_id"], placed["digest"], "label", "share", "t_words", "must", "diagonals", part.alias("own"))
    own, t_words, diagonals = F.col("own"), F.col("t_words"), F.col("diagonals")
    told = F.forall("must", lambda p: F.exists(diagonals, lambda d: F.forall(p, lambda i: stands(own, t_words, i, d))))
    return held.filter(told & (in_order(own, t_words, diagonals) >= least * F.size(t_words))).select("doc_id", "digest", "label", "share")


def license_labels(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per document: words, base places and labels, all labels, and the strongest evidence (a base place is 1)."""
    texts = id_and_text(docs).withColumn("digest", F.xxhash64("text"))
    table = template_table(docs.sparkSession, templates)
    voted = cut_lineage(spans(texts, table))
    sure = verified(texts, voted, table).groupBy("doc_id", "digest").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    base = base_places(texts, phrases)
    joined = base.join(sure, base["doc_id"].eqNullSafe(sure["doc_id"]) & (base["digest"] == sure["digest"]), "left").drop(sure["doc_id"], sure["digest"])
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        base["doc_id"], "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
