"""License scan by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of a document meets the template grams with the same
hash in a join; the three words are compared too, so a hash collision casts no
vote.  Votes are gathered by offset diagonal (position in the document less
position in the template); a place where a template stands word for word is a
diagonal that has all its grams.  Diagonals next to each other, as edits make
them, are merged, and a merged span counts if it covers enough of the template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

K = 3
#: What parts words: all of ASCII but digits and lower-case letters, which are all that is left of letters by then.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "\u212a"

#: Fixed values of the query's contract: phrase and label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public licence notices, a paragraph each, and their labels.
NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache-2"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "gpl"),
    ("You should have received a copy of the GNU Affero General Public License along with this program", "agpl"),
    ("under the terms of the GNU Lesser General Public License", "lgpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl-2"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
)


def words_of(text: Column) -> Column:
    """The words of a text; one pass of a splitting pattern, which costs a third of collecting its matches.

    ``lower`` changes other letters than A-Z too, which no ASCII template and no
    count of words can see, but for the Kelvin sign: its lower case is ``k``.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("\u00e5")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def template_rows(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, tpos, g1, g2, g3, grams, label, exact) of all templates."""
    rows, at = [], 0
    for texts, exact in ((phrases, True), (notices, False)):
        for text, label in texts:
            words = template_words(text)
            if len(words) < K:
                raise ValueError(f"a template needs {K} words: {text}")
            rows += [(at, i, *words[i : i + K], len(words) - K + 1, label, exact) for i in range(len(words) - K + 1)]
            at += 1
    return rows


def template_grams(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """The templates' grams and their hash ``h``.

    Its size is that of the template lists, which are code; it is checked all the same.
    """
    rows = template_rows(phrases, notices)
    df = spark.createDataFrame(rows, "template int, tpos int, g1 string, g2 string, g3 string, grams int, label string, exact boolean")
    df = df.withColumn("h", F.xxhash64("g1", "g2", "g3"))
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def gram_votes(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, template, diagonal, tposes): the template positions that voted for a diagonal.

    Only a gram's own three words leave the array of a document's words, so the
    work is in proportion to the text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    later = [F.slice("words", i + 1, F.lit(2**31 - 1)).alias(f"w{i}") for i in range(K)]
    rolling = rows.select("id", "text_hash", F.posexplode(F.arrays_zip(*later)).alias("pos", "gram"))
    w = [F.col(f"gram.w{i}") for i in range(K)]
    rolling = rolling.select("id", "text_hash", "pos", *[x.alias(f"w{i}") for i, x in enumerate(w)], F.xxhash64(*w).alias("hash"))
    # the hash alone is the key, a long; `between` keeps the comparison of the words out of it
    hit = F.col("hash") == F.col("h")
    for i in range(K):
        hit = hit & F.col(f"w{i}").between(F.col(f"g{i + 1}"), F.col(f"g{i + 1}"))
    votes = rolling.join(grams, hit).select("id", "text_hash", "template", "grams", "label", "exact", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    # repeated rows cast the same votes; a set counts them once
    return votes.groupBy("id", "text_hash", "template", "grams", "label", "exact", "diagonal").agg(F.collect_set("tpos").alias("tposes"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, min_cover: float = 0.7, gap: int = 3) -> DataFrame:
    """One row for each span: id, text_hash, label, exact, first_word, last_word, cover.

    Exact spans are places where a phrase stands word for word; others are
    merged diagonals of a notice that cover at least ``min_cover`` of its grams.
    """
    # few rows, read twice below; the texts are read once
    votes = cut(gram_votes(docs, template_grams(docs.sparkSession, phrases, notices), id_col, text_col))
    exact = votes.filter("exact").filter(F.size("tposes") == F.col("grams"))
    exact = exact.select("id", "text_hash", "label", "exact", F.col("diagonal").cast("long").alias("first_word"), (F.col("diagonal") + F.col("grams") + K - 2).cast("long").alias("last_word"), F.lit(1.0).alias("cover"))
    near = votes.filter("not exact")
    w = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    near = near.withColumn("_new", F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= gap, 0).otherwise(1))
    near = near.withColumn("_cluster", F.sum("_new").over(w))
    near = near.groupBy("id", "text_hash", "template", "grams", "label", "exact", "_cluster").agg(
        F.flatten(F.collect_list("tposes")).alias("_t"),
        F.min(F.col("diagonal") + F.array_min("tposes")).cast("long").alias("first_word"),
        (F.max(F.col("diagonal") + F.array_max("tposes")) + K - 1).cast("long").alias("last_word"),
    )
    near = near.withColumn("cover", F.size(F.array_distinct("_t")) / F.col("grams")).filter(F.col("cover") >= min_cover)
    return exact.unionByName(near.select("id", "text_hash", "label", "exact", "first_word", "last_word", "cover"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Identifier, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    A null text is empty.  Without words or licence: zero places, null words,
    empty label lists, score 0.  Repeated rows get the same result each; rows
    that share an identifier but differ in text are judged each by its own.
    ``score`` is the best cover of a template.  An empty table gives an empty result.
    """
    spans = license_spans(docs, id_col, text_col, **options)
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    found = spans.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count_if("exact").alias("_n"),
        F.min(F.when(F.col("exact"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word"))).alias("last_word"),
        joined(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("_base"),
        joined(F.collect_set("label")).alias("_labels"),
        F.max("cover").alias("_score"),
    )
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_hash"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select(
        id_col, "n_words", F.coalesce("_n", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("_base", F.lit("")).alias("base_labels"), F.coalesce("_labels", F.lit("")).alias("labels"), F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
