"""License scan by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of every text is joined by hash to the positions
that it has in the license templates.  A hit votes for the diagonal ``word
position - template position`` of its template.  Votes are counted for each
diagonal; diagonals at most ``GAP`` apart are merged (an inserted or dropped
word shifts to a neighbouring diagonal); a merged span is verified by the
share of the template's k-grams that it holds in order of place.

The k-gram itself is compared beside its hash, so a full diagonal proves that
the phrase's words stand there consecutively: these are the base places.
Longer notices give labels of the method's own at ``MIN_SHARE`` of their
k-grams.

The template table is a parameter of a few hundred rows and broadcast only
below ``BROADCAST_ROWS``; hits are aggregated by document before anything
else, so hot phrases spread over the documents that hold them.

Defined cases: null and empty text have no words; texts shorter than a k-gram
have no hits; rows equal in doc_id and text get a result each; null ids are
kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import lower_ascii, row_key, text_or_empty

GRAM, GAP, MIN_SHARE, BROADCAST_ROWS = 3, 3, 0.6, 100_000
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed values of the contract: phrase and label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Openings of public license notices, for whole or slightly changed copies.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, base, grams, at, gram, hash): one row per k-gram place."""
    rows = []
    for k, (text, label) in enumerate((*phrases, *notices)):
        words = text.split()
        grams = [" ".join(words[i:i + GRAM]) for i in range(len(words) - GRAM + 1)]
        rows += [(k, label, k < len(phrases), len(grams), i, g) for i, g in enumerate(grams)]
    return (spark.createDataFrame(rows, "template int, label string, base boolean, grams int, at int, gram string")
            .withColumn("hash", F.xxhash64("gram")))


def license_report(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """One row per document: word count, base places and labels."""
    table = table if table is not None else templates(docs.sparkSession)
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    words = F.regexp_extract_all(lower_ascii(text_or_empty()), F.lit(WORDS), F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (GRAM - 1))),
                        lambda i: F.concat_ws(" ", *[F.get("words", i + (k - 1)) for k in range(GRAM)]))
    each = (docs.select("doc_id", row_key("doc_id", "text").alias("row"), words.alias("words"))
            .select("doc_id", "row", F.size("words").cast("long").alias("n_words"), F.posexplode(grams).alias("pos", "gram")))
    # Position 0 stays without a hit too: it stands for the document.
    hits = (each.withColumn("hash", F.xxhash64("gram")).withColumnRenamed("gram", "words")
            .join(table, "hash", "left").filter((F.col("gram") == F.col("words")) | (F.col("pos") == 0))
            .withColumn("template", F.when(F.col("gram") == F.col("words"), F.col("template"))))
    key = ["doc_id", "row", "n_words"]
    # Equal rows share their hits; how many they are stands at position 0.
    single = (hits.withColumn("diagonal", F.col("pos") - F.col("at"))
              .withColumn("at", F.when(F.col("template").isNotNull(), F.col("at")))
              .withColumn("diagonal", F.when(F.col("template").isNotNull(), F.col("diagonal")))
              .groupBy(*key, "template", "pos", "at", "diagonal")
              .agg(F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"),
                   F.count_if(F.col("pos") == 0).alias("heads")))
    # Neighbouring diagonals merge into a span.
    of = Window.partitionBy(*key, "template")
    near = of.orderBy("diagonal", "pos")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > GAP).cast("int"), F.lit(0))
    placed = (single.withColumn("opens", opens).withColumn("span", F.sum("opens").over(near))
              .withColumn("full", F.count(F.lit(1)).over(Window.partitionBy(*key, "template", "diagonal")) == F.col("grams")))
    # Verification: places of the template count once, and only where they rise
    # with the text, read from the front or from the back.
    run = Window.partitionBy(*key, "template", "span").orderBy("pos", "at")
    back = Window.partitionBy(*key, "template", "span").orderBy(F.col("pos").desc(), F.col("at").desc())
    up = F.col("at") > F.coalesce(F.max("at").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    down = F.col("at") < F.coalesce(F.min("at").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.col("grams"))
    starts = F.col("full") & (F.col("at") == 0)
    spans = (placed.withColumn("up", up).withColumn("down", down)
             .groupBy(*key, "template", "label", "base", "grams", "span")
             .agg(F.greatest(F.count_if("up"), F.count_if("down")).alias("votes"), F.max("heads").alias("heads"),
                  F.count_if(starts).alias("places"), F.min(F.when(starts, F.col("diagonal"))).alias("first"),
                  F.max(F.when(starts, F.col("diagonal"))).alias("last")))
    share = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = F.col("base") & (F.col("places") > 0)
    out = (spans.groupBy(*key).agg(
        F.max("heads").alias("copies"),
        F.coalesce(F.sum(F.when(found, F.col("places"))), F.lit(0)).alias("n_base"),
        F.min(F.when(found, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(found, F.col("last"))).cast("long").alias("last_word"),
        labels(found).alias("base_labels"),
        labels(found | (~F.col("base") & (share >= MIN_SHARE))).alias("labels"),
        F.coalesce(F.max(F.when(found | ~F.col("base"), share)), F.lit(0.0)).alias("score")))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
