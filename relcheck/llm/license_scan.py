"""License scans (DataFrame functions only): diagonal voting of word k-grams against license templates.

Every rolling 3-word hash of every document is joined to the positions of the templates (a table whose size is fixed
below, hence broadcast). A hit votes for the diagonal `word position - template position`; votes are aggregated per
document, template and diagonal, diagonals at most two apart are merged (insertions and deletions), and a merged span is
verified: at least 0.8 of the template's words are covered, on a span not much longer than the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relcheck.llm.common import let, packed, table, unpacked
from relcheck.llm.quality_rules import trigram_hashes

K = 3
COVERED = 0.8
LONGER = 1.5
NEXT_TO = 2
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and opening paragraphs of public licenses, with the labels the method adds.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("reserved", "All rights reserved"),
]


def lowered(text: Column) -> Column:
    """A-Z as a-z. Other letters may change too, but to others outside of ASCII: the two that lower() makes ASCII letters
    of (U+0130, U+212A) are replaced before, so that words are found and compared as if only A-Z had changed."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0138")))


def words_of(low: Column) -> Column:
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def phrase_places(low: Column, ws: Column, phrase: str) -> Column:
    """Start words of the phrase; the words are compared only where the text holds them all."""
    first, *rest = phrase.split(" ")

    def at(w: Column, i: Column) -> Column:
        same = w == first
        for n, x in enumerate(rest, 1):
            same = same & (F.get(ws, i + n) == x)
        return F.when(same, i)

    there = low.contains(first)
    for x in rest:
        there = there & low.contains(x)
    return F.when(there, F.filter(F.transform(ws, at), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def templates(spark: SparkSession) -> DataFrame:
    """t, label, n (words) and, one row for each position, p and k (the hash of its 3 words)."""
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(text).alias("text")) for t, (label, text) in enumerate(TEMPLATES)])
    ws = words_of(lowered(F.col("text")))
    return spark.range(1).select(F.inline(rows)).select("t", "label", F.size(ws).alias("n"), F.posexplode(trigram_hashes(ws)).alias("p", "k"))


def spans(base: DataFrame) -> DataFrame:
    """Per document (_id, _h) `_spans` (label, start, end, coverage; verified ones) and `_score` (the best coverage)."""
    grams = base.select("_id", "_h", F.posexplode(let(words_of(lowered(F.col("_text"))), trigram_hashes)).alias("i", "k"))
    hits = grams.join(F.broadcast(templates(base.sparkSession)), "k")
    doc = ["_id", "_h", "t", "label", "n"]
    lines = hits.groupBy(*doc, (F.col("i") - F.col("p")).alias("d")).agg(F.min("i").alias("start"), (F.max("i") + K).alias("end"), F.collect_set("p").alias("ps"))
    order = Window.partitionBy("_id", "_h", "t").orderBy("d")
    apart = F.coalesce((F.col("d") - F.lag("d").over(order) > NEXT_TO).cast("int"), F.lit(0))
    merged = lines.withColumn("apart", apart).withColumn("m", F.sum("apart").over(order))
    share = lambda ps: F.size(F.array_distinct(F.flatten(F.transform(ps, lambda p: F.sequence(p, p + K - 1))))) / F.col("n")
    found = merged.withColumn("alone", share(F.col("ps"))).groupBy(*doc, "m")
    found = found.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.flatten(F.collect_list("ps")).alias("ps"), F.max("alone").alias("alone"))
    found = found.withColumn("coverage", share(F.col("ps")))
    right = (F.col("coverage") >= COVERED) & ((F.col("end") - F.col("start") <= LONGER * F.col("n")) | (F.col("alone") >= COVERED))
    span = F.struct("label", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "coverage")
    return found.groupBy(F.col("_id").alias("_id2"), F.col("_h").alias("_h2")).agg(
        F.array_sort(F.collect_list(F.when(right, span))).alias("_spans"), F.max("coverage").alias("_score")
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word (bigint), base_labels, labels (strings), score, license_spans.

    Null or empty text: 0 words, null places, empty labels, score 0. Null ids are ordinary ids. Repeated rows get equal
    results. Empty tables give empty results; extra columns stay.
    """
    base = packed(docs, id_col, text_col)
    low = lowered(F.col("_text"))
    places = lambda ws: F.struct(F.size(ws).cast("bigint").alias("n"), *[phrase_places(low, ws, p).alias(f"p{i}") for i, p in enumerate(PHRASES)])
    told = base.select("row", "_id", "_h", let(words_of(low), places).alias("w"))
    found = spans(base)
    met = told.join(found, told["_id"].eqNullSafe(found["_id2"]) & (told["_h"] == found["_h2"]), "left")
    each = [F.col(f"w.p{i}") for i in range(len(PHRASES))]
    every = F.concat(*each)
    base_labels = F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, label in zip(each, PHRASES.values(), strict=True)]))
    spans_ = F.coalesce(F.col("_spans"), F.array().cast("array<struct<label:string,start:bigint,end:bigint,coverage:double>>"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return unpacked(
        met,
        {
            "n_words": F.col("w.n"),
            "n_base": F.size(every).cast("bigint"),
            "first_word": F.array_min(every).cast("bigint"),
            "last_word": F.array_max(every).cast("bigint"),
            "base_labels": joined(base_labels),
            "labels": joined(F.concat(base_labels, F.transform(spans_, lambda s: s.label))),
            "score": F.coalesce(F.col("_score"), F.lit(0.0)),
            "license_spans": spans_,
        },
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
