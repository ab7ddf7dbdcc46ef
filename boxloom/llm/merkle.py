"""Merkle manifest of a dataset by a butterfly exchange.

Every row is a leaf. The leaves of a group (a language) are put in order and packed in aligned blocks of ``fanout ** k``;
a block hashes its own levels alone. Then aligned runs of ``fanout`` blocks swap the roots of their subtrees, round by round:
in round r the blocks that differ in digit r of their number meet, and each of them hashes the common ancestor for itself.
After the last round every block knows the root of its group and has gathered the upper part of its leaves' proofs on the
way, so nothing is sent down again. Numbers up to the next power of ``fanout`` are filled with empty blocks, which learn
ancestors as the others do; so every run is complete. The group roots are leaves of a tree made in the same way.

A step of a proof is the text in front of the own digest and the text behind it: the digests of the run's other nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..scale import checked_broadcast
from .common import crc_mod, cut, narrow, partitions

BLOCK = 4096  # leaves in a block, at most
STEPS = "array<struct<front: string, behind: string>>"
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """A value with its length in bytes in front; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves: Sequence[str], fanout: int, height: int | None) -> list[list[str]]:
    """The nodes of a block level by level, the leaves first; ``height`` levels above them, or until one node is left."""
    out = [list(leaves)]
    while (len(out) <= height) if height is not None else (len(out[-1]) > 1):
        below = out[-1]
        out.append([digest(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return out


def positions(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (with a column ``grp``) beside ``pos``, their place in the group's order, and ``n_leaves``, its size.

    Rows are dealt by ranges of (group, order), so a large group is spread; places are the counts of the partitions before
    plus the row number inside. Equal rows may take each other's places.
    """
    spark = leaves.sparkSession
    tied = leaves.withColumn("_tie", F.monotonically_increasing_id())
    placed = cut(tied.repartitionByRange(partitions(spark), "grp", *order, "_tie").sortWithinPartitions("grp", *order, "_tie").drop("_tie"))
    placed = placed.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    whole = placed.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_row") - F.shiftleft("_part", 33))  # a row per partition
    sizes = checked_broadcast(whole.groupBy(F.col("grp").alias("_grp")).agg(F.min("_at").alias("_first"), F.count("*").alias("n_leaves")))
    joined = whole.join(sizes, F.col("grp").eqNullSafe(F.col("_grp")))
    return joined.withColumn("pos", F.col("_at") - F.col("_first")).drop("_row", "_part", "_before", "_at", "_grp", "_first")


def block_roots(packed: DataFrame, fanout: int, height: int) -> DataFrame:
    """``grp, block, n_blocks, node``: the root of every block's own subtree."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [levels(x, fanout, height if n > 1 else None)[-1][0] for x, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.string())], ["grp", "block", "n_blocks", "node"])

    return packed.select("grp", "block", "n_blocks", F.col("leaves.leaf").alias("leaf")).mapInArrow(rows, "grp string, block long, n_blocks long, node string")


def butterfly(roots: DataFrame, fanout: int) -> DataFrame:
    """``grp, block, node, steps``: the root of the block's group and the steps from the block's root up to it."""
    largest = roots.agg(F.max("n_blocks")).first()[0] or 1
    rounds = 0
    while fanout ** rounds < largest:
        rounds += 1
    filled = F.lit(1)
    for r in range(rounds):
        filled = F.when(F.col("n_blocks") > fanout ** r, fanout ** (r + 1)).otherwise(filled)
    last = roots.filter((F.col("block") == F.col("n_blocks") - 1) & (F.col("n_blocks") < filled))
    empty = last.select("grp", F.explode(F.sequence("n_blocks", filled.cast("long") - 1)).alias("block"), "n_blocks", F.lit(None).cast("string").alias("node"))
    state = roots.unionByName(empty).withColumn("steps", F.array().cast(STEPS))
    for r in range(rounds):
        digit = F.expr(f"block div {fanout ** r} % {fanout}")
        met = W.partitionBy("grp", F.expr(f"block - block div {fanout ** r} % {fanout} * {fanout ** r}L"))
        state = state.withColumn("met", F.sort_array(F.collect_list(F.struct(digit.alias("digit"), "node")).over(met))).withColumn("digit", digit)
        texts = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: x.node), "")  # noqa: E731  empty subtrees are left out
        step = F.struct(texts(lambda x: x.digit < F.col("digit")).alias("front"), texts(lambda x: x.digit > F.col("digit")).alias("behind"))
        swaps = F.col("n_blocks") > fanout ** r
        ancestor = F.when(F.exists("met", lambda x: x.node.isNotNull()), F.sha2(texts(lambda x: x.node.isNotNull()), 256))
        state = state.select(
            "grp", "block", "n_blocks", F.when(swaps, ancestor).otherwise(F.col("node")).alias("node"),
            F.when(swaps, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"))
        if r % 8 == 7:
            state = cut(state)
    return state.filter("block < n_blocks").select("grp", "block", "node", "steps")


def forest(leaves: DataFrame, order: Sequence[str], fanout: int, block: int = BLOCK) -> DataFrame:
    """A tree per ``grp`` over rows with a hex digest ``leaf``: all columns, ``subroot``, and ``proof``, the steps up to it."""
    height = 1
    while fanout ** (height + 1) <= block:
        height += 1
    own = [c for c in leaves.columns if c != "grp"]
    kinds = dict(leaves.dtypes)
    placed = positions(leaves, order).withColumn("block", F.expr(f"pos div {fanout ** height}")).withColumn("n_blocks", F.expr(f"(n_leaves + {fanout ** height - 1}) div {fanout ** height}"))
    packed = cut(placed.groupBy("grp", "block", "n_blocks").agg(F.sort_array(F.collect_list(F.struct("pos", *own))).alias("leaves")))
    upper = checked_broadcast(butterfly(cut(block_roots(packed, fanout, height)), fanout), 10_000)
    upper = upper.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "node", "steps")
    known = packed.join(upper, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                grp, n_blocks, node, steps = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                held = batch.column(2)[i].values
                nodes = levels(held.field("leaf").to_pylist(), fanout, height if n_blocks > 1 else None)
                n, at = len(held), np.arange(len(held))
                front, behind = np.empty((2, n, len(nodes) - 1 + len(steps)), object)
                for level, row in enumerate(nodes[:-1]):
                    place = at // fanout ** level
                    runs = range(0, len(row), fanout)
                    front[:, level] = np.array(["".join(row[a:k]) for a in runs for k in range(a, min(a + fanout, len(row)))], object)[place]
                    behind[:, level] = np.array(["".join(row[k + 1:a + fanout]) for a in runs for k in range(a, min(a + fanout, len(row)))], object)[place]
                for k, step in enumerate(steps):
                    front[:, len(nodes) - 1 + k], behind[:, len(nodes) - 1 + k] = step["front"], step["behind"]
                flat = pa.StructArray.from_arrays([pa.array(front.ravel().tolist(), pa.string()), pa.array(behind.ravel().tolist(), pa.string())], ["front", "behind"])
                proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * front.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([grp] * n, pa.string()), *[held.field(c) for c in own], pa.array([node] * n, pa.string()), proof], ["grp", *own, "subroot", "proof"])

    fields = ", ".join(f"{c} {kinds[c]}" for c in own)
    return known.select("grp", "n_blocks", "leaves", "node", "steps").mapInArrow(rows, f"grp string, {fields}, subroot string, proof {STEPS}")


def merkle_manifest(df: DataFrame, fanout: int = 2, block: int = BLOCK, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``df``: ``doc_id, lang, leaf, subroot, root, proof, changed``.

    ``leaf`` is the digest of doc_id, source, lang, n_chars and text, ``proof`` the steps from it to ``root``. ``changed`` is
    the leaf with n_chars raised by one where ``tampered`` holds, else null; fold it to see the proof fail.

    Nulls in any column count as a dash; a null lang is a group of its own (the first), null ids stand first in it. Rows that
    repeat are leaves side by side (rows of one id in order of their leaves). An empty text is not a null one; very long texts
    are hashed where they are read and never move. Other columns, whatever their names, are left alone. An empty table gives
    no rows.
    """
    rows = narrow(df, **{c: c for c in LEAF_FIELDS})
    values = [F.col(c) for c in LEAF_FIELDS]
    more = [F.col("n_chars").cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in LEAF_FIELDS]
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(more)) if tampered is not None else F.lit(None).cast("string")
    leaves = rows.select(F.col("lang").cast("string").alias("grp"), "doc_id", leaf_hash(values).alias("leaf"), changed.alias("changed"))
    lower = cut(forest(leaves, ["doc_id", "leaf"], fanout, block))
    tops = lower.select("grp", "subroot").distinct().select(F.lit("").alias("grp"), F.col("grp").alias("lang"), F.col("subroot").alias("leaf"))
    top = forest(tops, ["lang"], fanout, block).select(F.col("lang").alias("_lang"), F.col("subroot").alias("root"), F.col("proof").alias("_more"))
    joined = lower.join(checked_broadcast(top, 10_000), F.col("grp").eqNullSafe(F.col("_lang")))
    return joined.select("doc_id", F.col("grp").alias("lang"), "leaf", "subroot", "root", F.concat("proof", "_more").alias("proof"), "changed")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.concat(step.front, own, step.behind), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s.front, s.behind)), ""), 256)


def verify(manifest: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of a manifest; changed leaves are folded instead."""
    folded = manifest.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def every_seventh() -> Column:
    return crc_mod("doc_id", 7) == 0
