"""Near duplicates by SimHash with one-wildcard deletion variants.

Fingerprints of 64 bits link when they differ in at most three bits. Cut into two halves, one half differs in at most one
bit. So every half is indexed 32 times, each time with one bit wiped out: linked fingerprints share such a key. Groups of
equal keys are compared and verified. A group that is too large is cut again by the same rule: what is left of the other
half differs in at most three bits, so its quarters, and then its eighths, are indexed with one bit wiped out. After the
third cut a group has at most 2**11 members by construction. Groups only report links that join their members into
the same components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, partitions, released, whole_text
from .components import components

BITS = 3
GROUP = 256  # members of a group that is compared at once; larger ones are cut again
WEIGHT = 1 << 16  # shingles turned into bits at a time


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text; a bit is set when over half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), WEIGHT):
        part = np.array(hashes[i:i + WEIGHT], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((total * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) per row."""
    texts = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("body"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts.mapInArrow(released(rows), f"doc_id {dict(texts.dtypes)['doc_id']}, fp long")


def wildcards(bits: Column, width: int) -> Column:
    """Array of (key, part that the key leaves out) for a ``width``-bit value: each half with each of its bits wiped out.

    The key holds which half, which bit, and the half without it.
    """
    half = width // 2
    low, high = bits.bitwiseAND(F.lit((1 << half) - 1)), F.shiftrightunsigned(bits, half).bitwiseAND(F.lit((1 << half) - 1))
    out = []
    for which, (own, other) in enumerate(((low, high), (high, low))):
        for bit in range(half):
            wiped = own.bitwiseAND(F.lit(((1 << half) - 1) & ~(1 << bit)))
            out.append(F.struct((F.shiftleft(F.lit(which * half + bit).cast("long"), half).bitwiseOR(wiped)).alias("key"), other.alias("rest")))
    return F.array(*out)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number it would count the absolute value


def join_group(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links that connect what is within ``bits`` of each other, at most one less than there are members."""
    a, b = [], []
    free = np.ones(len(fps), bool)
    for head in range(len(fps)):
        if not free[head]:
            continue
        free[head] = False
        queue = [head]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(free & (popcount(fps ^ fps[at]) <= bits))
            free[near] = False
            a += [int(fps[at])] * len(near)
            b += fps[near].tolist()
            queue += near.tolist()
    return a, b


def group_links(groups: DataFrame, bits: int) -> DataFrame:
    """``a, b`` for rows with an array ``fps`` of bounded length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            fps, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            size = np.diff(cuts)
            first = cuts[:-1][size == 2]
            first = first[popcount(fps[first] ^ fps[first + 1]) <= bits]
            a, b = fps[first].tolist(), fps[first + 1].tolist()
            for k in np.flatnonzero(size > 2):
                x, y = join_group(fps[cuts[k]:cuts[k + 1]], bits)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.select("fps").mapInArrow(released(rows), "a long, b long")


def links(nodes: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """Links that give the components of 'differ in at most three bits' among distinct fingerprints ``fp``."""
    if not 0 <= bits <= 3:
        raise ValueError("one of two halves differs in at most one bit only for up to three bits")
    rest = F.col("fp")
    level = nodes.select("fp", F.explode(wildcards(rest, 64)).alias("v")).select("fp", F.col("v.key").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3"), F.col("v.rest").alias("rest"))
    out = None
    for depth, width in ((1, 32), (2, 16), (3, 8)):
        keys = [f"k{i}" for i in range(1, depth + 1)]
        shared = cut(level.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"))
        met = cut(level.join(shared, keys))
        small = met if depth == 3 else met.filter(F.col("n") <= group)
        found = group_links(small.groupBy(*keys).agg(F.collect_list("fp").alias("fps")), bits).distinct()
        out = found if out is None else out.unionByName(found)
        large = met.filter(F.col("n") > group)
        if depth == 3 or large.isEmpty():
            return out
        new = f"k{depth + 1}"
        level = large.drop(new).select("fp", *keys, F.explode(wildcards(F.col("rest"), width)).alias("v"))
        level = level.select("fp", *keys, F.col("v.key").alias(new), *[F.lit(0).cast("long").alias(f"k{i}") for i in range(depth + 2, 4)], F.col("v.rest").alias("rest"))
    return out


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, group: int = GROUP) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id`` (the smallest doc_id reachable by links).

    Null and empty texts have the fingerprint zero and link like any other. Null ids never name a component that has
    other ids. Repeated rows have equal fingerprints, so they fall together. An empty table gives no rows.
    """
    prints = cut(fingerprints(df, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).repartition(partitions(df.sparkSession)))
    labels = components(links(nodes.select("fp"), bits, group))
    named = cut(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component_id", "fp").alias("label")))
    least = cut(named.groupBy("label").agg(F.min("least").alias("component_id")))
    owner = cut(named.join(least, "label").select("fp", "component_id"))
    return prints.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
