"""Folds, splits, class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import PAGE, beside, entity_levels, ranked
from .nearest import neighbour_lists


def contiguous_folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """k runs of equal size in order; the last takes the rest."""
    placed = ranked(rows, [], [*PAGE, "entity_seq"], entity_levels(), "_rn")
    total = rows.agg(F.count("*").alias("_n"))
    size = F.greatest(F.expr(f"_n div {k}"), F.lit(1))
    return placed.transform(beside, total).withColumn("fold", F.least(F.floor((F.col("_rn") - 1) / size), F.lit(k - 1))).drop("_rn", "_n")


def fold_quality(rows: DataFrame, k: int = 5) -> DataFrame:
    """Quality per fold: half mean confidence, half share of texts."""
    folds = contiguous_folds(rows, k).groupBy("fold").agg(F.avg("confidence_score").alias("m"), (F.count_if(F.trim("text_value") != "") / F.count("*")).alias("c"), F.count("*").alias("n"))
    return folds.select("fold", "n", ((F.col("m") + F.col("c")) / 2).alias("quality"))


def fold_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("quality").alias("cv_score"), F.coalesce(F.stddev_samp("quality"), F.lit(0.0)).alias("cv_std"))


def hash_of(*cols: str) -> Column:
    return F.md5(F.concat_ws("-", *cols))


def stratified_folds(rows: DataFrame, label: str = "label", k: int = 5) -> DataFrame:
    """Fold per row so that each label is spread evenly; the order inside a label is a hash, ranked on its leading digits."""
    h = hash_of("doc_id", "entity_seq")  # made anew where it is sorted: it doesn't travel with the row
    digits = lambda n: F.conv(F.substring(h, 1, n), 16, 10).cast("int")
    placed = ranked(rows, [label], [h], [digits(2), digits(4)], "_rn")
    return placed.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k))).drop("_rn")


def split_in_order(pages: DataFrame, train: float = 0.8) -> DataFrame:
    """First part of the pages by key for training."""
    placed = ranked(pages, [], PAGE, [F.expr("doc_id div 65536"), F.struct("doc_id", "page_number")], "_rn")
    total = pages.agg(F.count("*").alias("_n"))
    return placed.transform(beside, total).withColumn("split", F.when(F.col("_rn") <= F.floor(F.col("_n") * train), "train").otherwise("test")).drop("_rn", "_n")


def split_by_hash(rows: DataFrame, key: str, train: float = 0.8) -> DataFrame:
    """Random split that depends on the key only: all boxes of a page fall on one side, at any number of partitions."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int")
    return rows.withColumn("split", F.when(bucket < int(65536 * train), "train").otherwise("test"))


def smote(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Balance the classes up to the largest: new vectors between a vector and one of its k nearest.

    The largest class needs no new vectors and is not compared. Which pair and which weight follows from hashes.
    """
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"))
    top = sizes.agg(F.max("n").alias("m"))
    short = sizes.transform(beside, top).filter((F.col("n") < F.col("m")) & (F.col("n") > 1)).withColumn("need", F.col("m") - F.col("n"))
    minor = vectors.join(short.select("label", "n", "need"), "label")
    h = hash_of("label", "vec_id")
    bases = ranked(minor.withColumn("_h", h), ["label"], ["_h"], [F.substring("_h", 1, 2), F.substring("_h", 1, 4)], "rn").drop("_h")
    # Base vector number i makes the samples i, i + n, i + 2n, ... up to the need of its class.
    times = F.floor((F.col("need") - F.col("rn")) / F.col("n")) + 1
    made = bases.filter("rn <= need").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    near = neighbour_lists(minor.select("label", "vec_id", "embedding"), k)
    nth = (F.pmod(F.col("t"), F.size("near")) + 1).cast("int")
    chosen = made.join(near.filter(F.size("near") > 0), ["label", "vec_id"]).withColumn("other", F.element_at("near", nth)["other"]).drop("near")
    other = vectors.select(F.col("vec_id").alias("other"), F.col("embedding").alias("_to"))
    weight = F.conv(F.substring(F.md5(F.concat_ws("-", "vec_id", "t")), 1, 4), 16, 10).cast("double") / 65536
    mixed = F.zip_with("embedding", "_to", lambda a, b: a + (b - a) * F.col("w"))
    return chosen.join(other, "other").withColumn("w", weight).select("label", "vec_id", "other", "t", mixed.alias("embedding"))
