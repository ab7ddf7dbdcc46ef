"""Licence notices by diagonal voting.

Words of a text are numbered; every pair of consecutive words is hashed and joined to the positions of the same pair in
the templates. A hit at text position p and template position t votes for the diagonal p - t. The votes of a diagonal are
counted, neighbouring diagonals (words put in or left out) are merged, and the merged span is verified: the words must
cover enough of the template in little more than its length. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import ascii_lower, cut, narrow, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand consecutively.
PHRASES = {"cc-by": ["cc by"], "gpl": ["general public license"], "reserved": ["all rights reserved"]}
#: Notices that are found also when some words differ.
NOTICES = {
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc0": ["dedicated to the public domain under the creative commons cc0 1 0 universal dedication"],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["subject to the terms of the mozilla public license version 2 0"],
}
K = 2
REACH, COVER, SLACK = 2, 0.75, 1.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")
BITS = 60  # template positions in one word of votes


def templates(spark, phrases: Mapping[str, list[str]], notices: Mapping[str, list[str]]) -> DataFrame:
    """Template positions, a fixed table: its length is that of the word lists in the code."""
    rows, number = [], 0
    for exact, group in ((True, phrases), (False, notices)):
        for label, texts in group.items():
            for text in texts:
                words = text.split()
                rows += [(number, label, exact, len(words), t, words[t], words[t + 1]) for t in range(len(words) - 1)]
                number += 1
    df = spark.createDataFrame(rows, "template int, label string, exact boolean, size int, t int, t_first string, t_second string")
    return F.broadcast(df.withColumn("gram", F.xxhash64("t_first", "t_second")))


def hits(df: DataFrame, phrases: Mapping[str, list[str]] = PHRASES, notices: Mapping[str, list[str]] = NOTICES) -> DataFrame:
    """Verified places: ``row_id, label, exact, first_word, last_word, cover`` for rows ``row_id, text``."""
    pairs = df.select("row_id", words_of(F.col("text")).alias("w")).select(
        "row_id", F.posexplode(F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))))).alias("p", "pair"))
    pairs = pairs.select("row_id", "p", F.col("pair")["w"].alias("first"), F.col("pair")["1"].alias("second"))
    votes = (
        pairs.filter("second IS NOT NULL").withColumn("gram", F.xxhash64("first", "second"))
        .join(templates(df.sparkSession, phrases, notices), "gram").filter("first = t_first AND second = t_second")
        .withColumn("diagonal", F.col("p") - F.col("t"))
    )
    # Votes are a set of template positions, so a repeated row cannot vote twice; the set is kept in words of 60 bits.
    longest = max((len(t.split()) for group in (phrases, notices) for texts in group.values() for t in texts), default=0)
    names = [f"votes{k}" for k in range(max(1, -(-longest // BITS)))]
    masks = [F.coalesce(F.bit_or(F.when(F.expr(f"t div {BITS}") == k, F.expr(f"shiftleft(1L, t % {BITS})"))), F.lit(0).cast("long")).alias(n) for k, n in enumerate(names)]
    lines = cut(votes.groupBy("row_id", "template", "label", "exact", "size", "diagonal").agg(*masks, F.min("p").alias("low"), (F.max("p") + K - 1).alias("high")))
    cast = lambda found: sum((F.bit_count(c) for c in found[1:]), F.bit_count(found[0]))
    # A phrase allows no other word: its own diagonal must hold all of its pairs.
    whole = lines.filter(F.col("exact") & (cast([F.col(n) for n in names]) == F.col("size") - 1)).select(
        "row_id", "label", "exact", F.col("low").alias("first_word"), F.col("high").alias("last_word"), F.lit(1.0).alias("cover"))
    # Neighbouring diagonals of a notice are merged while they are near on both axes.
    w = W.partitionBy("row_id", "template").orderBy("diagonal", "low")
    apart = (F.col("diagonal") - F.lag("diagonal").over(w) > REACH) | (F.col("low") - F.lag("high").over(w) > F.col("size"))
    merged = (
        lines.filter("NOT exact").withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("row_id", "template", "label", "exact", "size", "run")
        .agg(cast([F.bit_or(n) for n in names]).alias("votes"), F.min("low").alias("first_word"), F.max("high").alias("last_word"))
        .withColumn("cover", F.least(F.lit(1.0), F.col("votes") / (F.col("size") - 1)))
        .filter((F.col("cover") >= COVER) & (F.col("last_word") - F.col("first_word") + 1 <= F.col("size") * SLACK))
    )
    return whole.unionByName(merged.select(*whole.columns))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, list[str]] = PHRASES,
                 notices: Mapping[str, list[str]] = NOTICES) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of ``phrases``; ``first_word`` and ``last_word`` are their smallest and largest start
    (null without one). ``labels`` adds those of ``notices``. ``score`` is 0 without a label, else the best share of a
    template that was found (1 for a phrase). Null and empty texts have no words. Rows with the same id and text are one
    document and get the same figures; a null id is an id like any other here. Labels are joined in sorted order, so ties
    don't matter. Templates and texts may have any length. Other columns are not read, whatever their names.
    """
    docs = narrow(df, doc_id=id_col, text=text_col).select("doc_id", whole_text().alias("text"))
    docs = docs.withColumn("row_id", F.struct("doc_id", F.xxhash64("text").alias("digest")))
    found = hits(docs, phrases, notices)
    figures = cut(found.groupBy("row_id").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score")))
    figures = figures.withColumnRenamed("row_id", "found_id")
    upper = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    counted = docs.select("doc_id", "row_id", F.regexp_count("text", F.lit(upper)).cast("long").alias("n_words"))
    return counted.join(figures, F.col("row_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
