"""Connected components by contraction.

In each round every node points to the smallest node among itself and its neighbours. Pointers only lead to smaller nodes,
so they form trees; doubling follows them to the roots in a logarithmic number of joins. Links are then rewritten to the
roots, and the round repeats on what is left. A root that nobody pointed to has a smaller neighbour in the next round, so
two rounds at least halve the linked nodes. The smallest node of a component is always a root and names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def roots_of(pointer: DataFrame) -> DataFrame:
    """Follow ``node, to`` to the roots (rows that point to themselves)."""
    while True:
        further = pointer.select(F.col("node").alias("to"), F.col("to").alias("next"))
        pointer = cut(pointer.join(further, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        if pointer.filter("moved").isEmpty():
            return pointer.select("node", "to")


def components(links: DataFrame) -> DataFrame:
    """``node, component_id`` for every node in ``links`` (columns ``a, b``, no nulls); component_id is the smallest node."""
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = roots_of(cut(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))))
        rounds.append(pointer)
        left = pointer.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = pointer.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    final = rounds.pop().withColumnRenamed("to", "component_id")
    while rounds:
        later = final.withColumnRenamed("node", "to")
        final = cut(rounds.pop().join(later, "to", "left").select("node", F.coalesce("component_id", "to").alias("component_id")))
    return final
