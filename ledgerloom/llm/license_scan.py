"""License scan by diagonal voting.

All rolling word 3-gram hashes of every text are joined to the positions of the
same grams in license templates. A hit at text word i and template word j votes
for the diagonal i - j; neighbouring diagonals (a few words inserted or left
out) are merged, and the merged span is verified against the template's words.

A *phrase* needs every one of its grams on one diagonal, so that its words stand
consecutively; a *notice* needs a share of its words covered by verified grams, one of
fewer than ``WHOLE`` words all of them. Words that tell licenses apart (``TELLING``, and
the number in a label such as ``gpl-3``) have to be covered where the notice has them,
and rule it out where they stand inside its span but not in the notice. Of
notices whose spans overlap, only that counts which explains the place best: covered
words, less two for each word of the notice that is not there and for each word of
the text in between that is not the notice's; equals all count.

Defined cases: null text counts as empty (no words). Every row gives a row, repeated
rows too. An empty table gives no rows. Extra columns are ignored. Hashes only propose: every hit's words are compared
with the template's, so a hash collision cannot make a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ascii_lower, rolling_hashes

K = 3
#: Diagonals at most this far apart vote together.
GAP = 3
#: Share of a notice's words that verified grams must cover.
COVERAGE = 0.6
#: Notices of fewer words need all of them.
WHOLE = 8
# Words that tell one license from another.
TELLING = ["mit", "apache", "bsd", "isc", "gnu", "lesser", "library", "affero", "mozilla", "creative", "commons", "noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd", "unencumbered"]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Opening notices of public licenses, as published with them.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "licensed under the creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "licensed under the creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "licensed under the creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "this work is licensed under the gnu lesser general public license version"),
    ("agpl", "this work is licensed under the gnu affero general public license version"),
    ("gpl", "released under the terms of the gnu general public license"),
    ("bsd", "released under the bsd license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]


def templates(spark: SparkSession, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per template gram: its hash and words, position, and the template's size.

    The row ``template = -1`` carries the hash that every text emits once, so that
    texts without any hit stay in the result without a second scan.
    """
    rows = [(i, label, text, base) for i, (label, text, base) in enumerate([*((a, b, True) for a, b in phrases), *((a, b, False) for a, b in notices)])]
    given = spark.sql("select stack({}, {}) as (template, label, text, base)".format(len(rows), ", ".join(f"{i}, '{label}', '{text}', {str(base).lower()}" for i, label, text, base in rows)))
    words = given.withColumn("words", F.split("text", " ")).withColumn("size", F.size("words"))
    # places of the words that have to be covered
    number = F.regexp_extract("label", r"-(\d+)$", 1)
    told = F.transform("words", lambda w, i: F.when(w.isin(TELLING) | (number != "") & (w == number), i))
    words = words.withColumn("needs", F.array_compact(told))
    grams = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).select(
        "template", "label", "base", "size", "words", "needs", F.posexplode(rolling_hashes(F.col("hashes"), K)).alias("at", "gram")
    )
    grams = grams.select("gram", "template", "label", "base", "size", "at", "needs", F.array_join(F.slice("words", F.col("at") + 1, K), " ").alias("said"))
    marker = spark.range(1).select(
        F.lit(0).cast("long").alias("gram"), F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(1).alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("needs"), F.lit("").alias("said")
    )
    return grams.unionByName(marker)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Verified hits: (doc_id, row, n_words, template, label, base, size, needs, at, start, told); told has the places of telling words in the text.

    The template side is the fixed list above, so it is broadcast. Of the texts,
    only matching grams leave the scan. The outer form of explode keeps Catalyst from
    deriving a filter on the array that would compute it a second time, and exploding a
    plain column keeps generation and join in one compiled stage, where words aren't copied.
    """
    scanned = (
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("words"))
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("grams", F.concat(F.array(F.lit(0).cast("long")), rolling_hashes(F.col("hashes"), K)))
        .select("doc_id", "row", "words", F.posexplode_outer("grams").alias("slot", "gram"))
    )
    places = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(TELLING), i)))
    told = F.when((F.col("template") >= 0) & ~F.col("base"), places)
    return (
        scanned.join(F.broadcast(grams), "gram")
        .where((F.col("template") == -1) & (F.col("slot") == 0) | (F.col("slot") > 0) & (F.array_join(F.slice("words", F.col("slot"), K), " ") == F.col("said")))
        .select("doc_id", "row", F.size("words").cast("long").alias("n_words"), "template", "label", "base", "size", "needs", "at", (F.col("slot") - 1).alias("start"), told.alias("told"))
    )


def spans(found: DataFrame) -> DataFrame:
    """Verified spans of each text: merged diagonals with their coverage of the template, the best of those that overlap."""
    text = ["doc_id", "row", "n_words", "template", "label", "base", "size"]
    same = [F.first(c).alias(c) for c in ("needs", "told")]
    diagonals = (
        found.groupBy(*text, (F.col("start") - F.col("at")).alias("diagonal"))
        .agg(*same, F.collect_set("at").alias("ats"), F.collect_set("start").alias("starts"), F.min("start").alias("first"), (F.max("start") + K - 1).alias("last"))
        .withColumn("votes", F.size("ats"))
    )
    of_template = W.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    new = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(of_template) > GAP), 1).otherwise(0)
    merged = (
        diagonals.withColumn("new", new)
        .withColumn("span", F.sum("new").over(of_template))
        .groupBy(*text, "span")
        .agg(*same, F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    places = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda a: F.sequence(a, a + K - 1))))
    full = merged.withColumn("mine", places("ats")).withColumn("theirs", places("starts")).withColumn("covered", F.size("mine")).withColumn("coverage", F.col("covered") / F.col("size"))
    told = F.size(F.array_except("needs", "mine")) == 0
    # a telling word inside the span that isn't the notice's
    strange = F.exists(F.col("told"), lambda i: (i > F.col("first")) & (i < F.col("last")) & ~F.array_contains("theirs", i))
    covers = F.when(F.col("size") < WHOLE, F.col("covered") == F.col("size")).otherwise(F.col("coverage") >= COVERAGE)
    enough = F.when(F.col("base"), F.size("ats") == F.col("size") - K + 1).otherwise(covers & told & ~F.coalesce(strange, F.lit(False)))
    between = F.col("last") - F.col("first") + 1 - F.size("theirs")
    value = F.col("covered") - 2 * (F.col("size") - F.col("covered") + between)
    kept = full.where((F.col("template") == -1) | enough).withColumn("value", F.when((F.col("template") >= 0) & ~F.col("base"), value)).drop("ats", "starts", "covered", "mine", "theirs", "needs", "told")
    # notices of a text in order, those that overlap as one place
    notice = F.col("value").isNotNull()
    in_order = W.partitionBy("doc_id", "row", notice).orderBy("first", "last", "template")
    before = F.max("last").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    placed = kept.withColumn("apart", F.coalesce(F.col("first") > before, F.lit(True)).cast("int")).withColumn("place", F.sum("apart").over(in_order))
    best = F.max("value").over(W.partitionBy("doc_id", "row", notice, "place"))
    return placed.withColumn("best", best).where(~notice | (F.col("value") == F.col("best"))).drop("apart", "place", "best", "value")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: base counts and places, labels, spans and a score (the best coverage)."""
    found = spans(hits(docs, templates(docs.sparkSession)))
    real, base = F.col("template") >= 0, F.col("base")
    labels = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    return found.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(real).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_set(F.when(real & ~base, F.struct("first", "last", "label", "coverage")))).alias("spans"),
    )
