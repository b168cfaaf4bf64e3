"""License scans by diagonal voting.

Every text is cut into words; rolling k-gram hashes at all word positions (k = 2 for short phrases, 4 for longer
templates) are joined to the places of the same k-grams in the templates. A hit votes for the diagonal (document
place minus template place). Votes are aggregated by document, template and diagonal; diagonals that lie next to
each other are merged, which bridges inserted or lost words; a span holds if the verified k-grams cover enough of
the template. Hits are verified by their words, not only by their hashes.

A phrase must be there word for word, so its diagonal needs a vote from each of its k-grams. Templates need
`coverage` of their different k-grams on merged diagonals.

Defined results: null or wordless text has no words, no labels and score 0; rows with equal ids are scanned apart;
a null id stays null; overlapping places count each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: all of ASCII but digits and letters (applied after lower-casing).
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wordings of well-known public licenses and notices, with their labels.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "mit-notice": "Released under the MIT License",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "reserved": "All rights reserved",
}
SHORT, LONG = 2, 4


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at ASCII that is neither digit nor letter."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), lambda w: w != "")


def _cut(text: str) -> list[str]:
    import re

    return [w for w in re.split(SEPARATOR, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """template, base, label, k, grams (of the template), at, words, hash: a row for each k-gram place. Small: bounded by the templates."""
    rows = []
    for base, texts in ((True, phrases), (False, templates)):
        for name, value in texts.items():
            words = _cut(name if base else value)
            k = min(SHORT if base else LONG, len(words))
            rows += [(name, base, value if base else name, k, len(words) - k + 1, at, words[at : at + k]) for at in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "template string, base boolean, label string, k int, grams int, at int, words array<string>")
    return df.withColumn("hash", F.coalesce(*(F.when(F.col("k") == k, gram_hash(F.lit(0), k)) for k in range(1, LONG + 1))))


def gram_hash(at: Column, k: int) -> Column:
    """Hash of k neighbouring elements of the column words."""
    return F.xxhash64(*(F.get("words", at + j) for j in range(k)))


def hits(docs: DataFrame, grams: DataFrame, ks: list[int], id_col: str, text_col: str) -> DataFrame:
    """A row for each verified k-gram hit, and one with a null template for a document without any.

    Only the places whose hash stands in a template leave a text's array; their number is what the join works on. The
    hashes of the templates are bounded by the templates.
    """
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    wanted: dict[int, set[int]] = {k: set() for k in ks}
    for r in grams.select("k", "hash").collect():
        wanted[r.k].add(r.hash)

    def places(k: int) -> Column:
        here = F.filter(F.sequence(F.lit(0), F.size("words") - k), lambda i: gram_hash(i, k).isin(sorted(wanted[k])))
        rows = F.transform(here, lambda i: F.struct(F.lit(k).alias("k"), i.alias("place"), gram_hash(i, k).alias("hash")))
        return F.when(F.size("words") >= k, rows).otherwise(F.array().cast("array<struct<k: int, place: int, hash: bigint>>"))

    each = cut.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.concat(*(places(k) for k in ks)).alias("all"))
    out = each.select("row", "doc_id", "n_words", "words", F.explode_outer("all").alias("g")).select("row", "doc_id", "n_words", F.slice("words", F.coalesce("g.place", F.lit(0)) + 1, F.coalesce("g.k", F.lit(1))).alias("here"), F.col("g.place").cast("long").alias("at_word"), F.col("g.hash").alias("dhash"))
    # equal words decide, not equal hashes
    joined = out.join(F.broadcast(grams), (F.col("dhash") == F.col("hash")) & (F.col("here") == F.col("words")), "left")
    return joined.select("row", "doc_id", "n_words", "template", "base", "label", "grams", "at", F.when(F.col("template").isNotNull(), F.col("at_word")).alias("place"), "k")


def spans(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, coverage: float = 0.6, slack: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words and the spans found: template, base, label, start, stop (words), share of the template's k-grams.

    A document without spans has one row with a null template. slack: how far neighbouring diagonals may lie apart.
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    grams = template_grams(spark, phrases, templates)
    ks = sorted({min(k, len(_cut(t))) for k, ts in ((SHORT, phrases), (LONG, templates.values())) for t in ts if _cut(t)}) or [SHORT]
    found = hits(docs, grams, ks, id_col, text_col)
    votes = found.groupBy("row", "doc_id", "n_words", "template", "base", "label", "grams", "k", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_list("at").alias("ats"), F.min("place").alias("first"), (F.max("place") + F.max("k")).alias("stop"))
    same = Window.partitionBy("row", "template").orderBy("diagonal")
    # diagonals of phrases stay apart; those of templates join their neighbour
    near = (F.col("diagonal") - F.lag("diagonal").over(same) <= slack) & ~F.col("base")
    group = F.sum(F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).over(same.rowsBetween(Window.unboundedPreceding, 0))
    merged = votes.withColumn("group", group).groupBy("row", "doc_id", "n_words", "template", "base", "label", "grams", "group").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.min("first").alias("start"), F.max("stop").alias("stop"))
    # a place of the template counts once, however many of the merged diagonals hold it
    share = F.col("votes") / F.col("grams")
    good = F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(share >= coverage)
    ok = F.col("template").isNotNull() & F.coalesce(good, F.lit(False))
    keep = [F.when(ok, F.col(c)).alias(c) for c in ("template", "base", "label", "start", "stop")]
    return merged.select("row", "doc_id", "n_words", *keep, F.when(ok, share).alias("share"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: n_words, n_base, first_word, last_word, base_labels, labels and a score.

    The score is the largest share of a template, or 1 where a phrase stands.
    """
    s = spans(docs, phrases, templates, id_col=id_col, text_col=text_col)
    base = F.col("base") & F.col("template").isNotNull()
    text = lambda c: F.array_join(F.array_sort(F.array_compact(c)), ",")
    return s.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        text(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), text(F.collect_set("label")).alias("labels"), F.coalesce(F.max(F.when(base, 1.0).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("row")
