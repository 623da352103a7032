"""Licence scans by diagonal voting, in DataFrame functions only.

Every template (a phrase or a passage of a licence) and every text is a list of words. All
rolling ``GRAM``-word hashes of the texts are joined to the positions where the templates have
them; a match at text position p and template position t votes for the diagonal p - t. Votes are
counted per text, template and diagonal; neighbouring diagonals of a template are merged, so a
few words put in or left out don't split a span; a span counts if its verified words cover
enough of the template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD_PATTERN

GRAM = 3
#: Diagonals at most this far apart belong to one span.
SLACK = 3
#: Share of a passage's grams that a span must have.
COVER = 0.6

#: The base phrases and their labels; they count only where all their words stand together.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Passages of public licences, whole or edited, and the labels they give.
PASSAGES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software",
        "mit",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied",
        "apache-2",
    ),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache-2",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "bsd",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        "gpl",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mpl-2",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "isc",
    ),
    (
        "this work is licensed under a creative commons attribution noncommercial",
        "cc-by-nc",
    ),
    ("this work is licensed under a creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under the creative commons attribution", "cc-by"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "proprietary"),
)

#: The template of the row that carries a text's word count, so that texts without a match stay.
_EVERY = -1


def words(column: str):
    """Words of a text, A-Z lowered; null is the empty text."""
    lowered = F.translate(F.coalesce(F.col(column), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"({WORD_PATTERN})"), F.lit(1))


def templates(spark: SparkSession, phrases=PHRASES, passages=PASSAGES) -> DataFrame:
    """``hash, template, label, base, at, size, gram`` for each gram of each template: a few hundred rows."""
    rows = []
    for k, (text, label, base) in enumerate([(*p, True) for p in phrases] + [(*p, False) for p in passages]):
        w = text.split()
        if len(w) < GRAM:
            raise ValueError(f"a template has {GRAM} words or more: {text}")
        rows += [(k, label, base, i, len(w), w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, at int, size int, gram array<string>")
    own = grams.select(_hash(*[F.col("gram")[i] for i in range(GRAM)]).alias("hash"), "*")
    every = spark.createDataFrame([(0, _EVERY, None, False, 0, 0, None)], "hash long, " + "template int, label string, base boolean, at int, size int, gram array<string>")
    return own.unionByName(every)


def _hash(*w):
    """A gram's hash; 0 is kept for the row that carries the word count."""
    h = F.xxhash64(*w)
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def license_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, passages=PASSAGES) -> DataFrame:
    """Spans of licence templates: ``row, doc_id, n_words, template, label, base, size, votes, first, last``.

    ``first`` and ``last`` are the smallest and largest word where a diagonal of the span starts.
    Every text has a row with ``template`` -1. Null text is empty; rows that repeat an id stay apart
    by ``row``; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words(text_col).alias("w")
    ).withColumn("n_words", F.size("w").cast("long"))
    n = F.size("w")
    # a gram takes its own words along, never the text (nor what is counted on it): rows stay small however long a text is
    pairs = F.zip_with("w", F.slice("w", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rolled = F.zip_with(pairs, F.slice("w", F.lit(3), n), lambda x, c: F.struct(
        F.when(c.isNull(), F.lit(None).cast("long")).otherwise(_hash(x["a"], x["b"], c)).alias("hash"), x["a"].alias("a"), x["b"].alias("b"), c.alias("c")))
    none = F.lit(None).cast("string")
    every = F.array(F.struct(F.lit(0).cast("long").alias("hash"), none.alias("a"), none.alias("b"), none.alias("c")))
    grams = docs.select("row", "doc_id", "n_words", F.posexplode(F.concat(rolled, every)).alias("p", "g"))
    grams = grams.select("row", "doc_id", "n_words", "p", F.col("g.hash").alias("hash"), *[F.col(f"g.{x}").alias(f"g_{x}") for x in "abc"])
    hits = grams.where("hash is not null").join(F.broadcast(templates(spark, phrases, passages)), "hash")
    verified = hits.where("template = -1 or array(g_a, g_b, g_c) = gram")
    diagonals = verified.select(
        "row", "doc_id", "n_words", "template", "label", "base", "size", "at",
        F.when(F.col("template") == _EVERY, F.lit(0)).otherwise(F.col("p") - F.col("at")).alias("diagonal"),
    )
    key = ["row", "doc_id", "n_words", "template", "label", "base", "size"]
    votes = diagonals.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.collect_set("at").alias("ats"))
    # merge neighbouring diagonals of passages; a phrase's diagonals stand for themselves
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(1 << 30))
    starts = votes.withColumn("new", (F.col("base") | (step > SLACK)).cast("int"))
    spans = starts.withColumn("span", F.sum("new").over(order))
    merged = spans.groupBy(*key, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"),
        F.min("diagonal").cast("long").alias("first"),
        F.max("diagonal").cast("long").alias("last"),
    )
    whole = F.col("size") - GRAM + 1
    enough = F.when(F.col("base"), F.col("votes") == whole).otherwise(F.col("votes") >= F.ceil(whole * COVER))
    return merged.where((F.col("template") == _EVERY) | enough)


def license_scan(documents: DataFrame, **options) -> DataFrame:
    """One row per text: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the best share of a template's grams that a span has, 1 for a base phrase, 0 without any.
    """
    spans = license_spans(documents, **options)
    base, found = F.col("base"), F.col("template") != _EVERY
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("last"))).alias("last_word"),
            names(base).alias("base_labels"),
            names(found).alias("labels"),
            F.coalesce(F.max(F.when(found, F.col("votes") / (F.col("size") - GRAM + 1))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of every whole text; one row per document."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
