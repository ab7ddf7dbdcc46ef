"""Distinct rows, exact copies, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import first_per


def dedup_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in order; each map task sends one row per key."""
    return first_per(rows, keys, order)


def exact_copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Copies of a text with the first document that has it.

    The first document per content is an aggregate (combined map-side); only contents with copies meet their documents.
    """
    hashed = docs.select(key, F.sha2(F.col(text), 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min(key).alias("kept"), F.count("*").alias("copies")).filter("copies > 1")
    return hashed.join(first, "hash").filter(F.col(key) != F.col("kept")).select(key, "kept", "copies")


def keep_first(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents without their exact copies."""
    return docs.join(exact_copies(docs, key, text).select(key), key, "left_anti")


def new_rows_only(found: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not processed yet."""
    return found.join(done.select(*keys).distinct(), keys, "left_anti")


def augment_union(base: DataFrame, made: DataFrame) -> DataFrame:
    return base.unionByName(made, allowMissingColumns=True)


def split_label(rank: Column, size: Column, train: float) -> Column:
    return F.when(rank <= F.floor(size * train), "train").otherwise("test")
