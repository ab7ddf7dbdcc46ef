"""Prefix trie of conversations from sorted common prefixes and range minima.

Conversations become sequences of turn digests; equal sequences are one. The sequences are sorted and dealt to shards by
ranges. In a shard the length of the common prefix of each sequence with the one before it goes into a sparse table of range
minima. A prefix is named by the first sequence that has it; its members are the interval around that sequence over which
the minimum does not fall below the prefix's length, and both ends of it are found by binary searches of their own in the
sparse table. All figures of a node are then differences of running sums over the interval, or one more range minimum.

A prefix that reaches over the edge of a shard is a prefix of the shard's first or last sequence. Only for these the shards
give partial figures (a bounded number of rows per shard), which are added up by the prefix's digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import cut, narrow, partitions

WIDTH = 16  # bytes of a turn's digest (the first half of a sha256)
SHARD = 32_768  # sequences in a shard, about
LIST = 65_536  # member ids hashed into one row
NODE = ("shard int, closed boolean, name binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, stride: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, turns``: the first h turns of conversation ``conv_id - conv_id % stride``, then the own turns after the first
    h; h is crc32(conv_id) modulo ``most``. A turn is its digest and its number of words; texts stay where they are read."""
    rows = narrow(conversations, conv_id="conv_id", turn="turn", role="role", text="text").filter("conv_id IS NOT NULL")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    own = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", name.alias("name"), words.alias("words")))).alias("own"))
    own = cut(own.withColumn("own", F.transform("own", lambda t: F.struct(t["name"].alias("name"), t.words.alias("words")))))
    heads = own.filter(F.col("conv_id") % stride == 0).select(F.col("conv_id").alias("_base"), F.slice("own", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = own.withColumn("_base", F.expr(f"conv_id - conv_id % {stride}")).join(heads, "_base", "left")
    head = F.when(h > 0, F.slice(F.coalesce("head", F.expr("slice(own, 1, 0)")), F.lit(1), h)).otherwise(F.expr("slice(own, 1, 0)"))
    return both.select("conv_id", F.concat(head, F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))).alias("turns"))


def end_digests(pairs: DataFrame) -> DataFrame:
    """``key, n, least, ends_sha256`` per key of rows ``key, conv_id``: the digest of all ids, ascending, comma-joined.

    Ids are dealt by ranges of (key, conv_id) and written out in rows of at most ``LIST``; a key's rows are then hashed one
    after the other, so a key with very many ids is neither gathered nor sorted in one task.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["key", "least", "n", "ids"])

        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= LIST):
                    yield row()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield row()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = engine = None
        least = n = 0
        done: list[tuple] = []
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        names = ["key", "n", "least", "ends_sha256"]
        for batch in batches:
            for k, low, count, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if engine is None or k != key:
                    if engine is not None:
                        done.append((key, n, least, engine.hexdigest()))
                    key, engine, least, n = k, hashlib.sha256(), low, 0
                else:
                    engine.update(b",")
                engine.update(text.encode())
                n += count
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if engine is not None:
            done.append((key, n, least, engine.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    parts = partitions(pairs.sparkSession)
    spread = pairs.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = spread.mapInArrow(lists, "key binary, least long, n long, ids string")
    return rows.repartition(parts, "key").sortWithinPartitions("key", "least").mapInArrow(chained, "key binary, n long, least long, ends_sha256 string")


class RangeMinimum:
    """Sparse table: minima of all stretches of 2 ** k places."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half, below = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(below[:-half], below[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over low..high, both included."""
        k = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for level in np.unique(k):
            here = np.flatnonzero(k == level)
            row = self.rows[level]
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << level) + 1])
        return out

    def right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to which all values behind ``start`` are at least ``bound``."""
        at = start.copy()
        for level in range(len(self.rows) - 1, -1, -1):
            row = self.rows[level]
            fits = np.flatnonzero(at + 1 < len(row))
            fits = fits[row[at[fits] + 1] >= bound[fits]]
            at[fits] += 1 << level
        return at

    def left(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from whose successor on all values up to ``start`` are at least ``bound``."""
        at = start.copy()
        for level in range(len(self.rows) - 1, -1, -1):
            row, width = self.rows[level], 1 << level
            fits = np.flatnonzero(at - width >= 0)
            fits = fits[row[at[fits] - width + 1] >= bound[fits]]
            at[fits] -= width
        return at


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their beginning."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(k[:n * WIDTH], f"S{WIDTH}") for k in (a, b))
    differs = np.flatnonzero(x != y)
    return int(differs[0]) if len(differs) else n


def shard_nodes(keys: list[bytes], words: list[list[int]], copies: np.ndarray, least: np.ndarray, ends: list[str], before: bytes | None, after: bytes | None) -> dict[str, list | np.ndarray]:
    """All nodes of one shard of sorted distinct sequences; those that reach over its edges in part (``closed`` is false).

    ``before`` and ``after`` are the last sequence of the shard before and the first one of the shard behind.
    """
    n = len(keys)
    size = np.array([len(k) // WIDTH for k in keys])
    start = np.cumsum(size) - size
    # Turn numbers in place of digests, so that neighbours are compared column by column.
    number = np.unique(np.frombuffer(b"".join(keys), f"S{WIDTH}"), return_inverse=True)[1] if size.sum() else np.zeros(0, int)
    lcp = np.zeros(n, np.int64)  # with the sequence before
    open_ = np.arange(1, n)
    for column in range(int(size.max())):
        open_ = open_[(size[open_] > column) & (size[open_ - 1] > column)]
        open_ = open_[number[start[open_] + column] == number[start[open_ - 1] + column]]
        if not len(open_):
            break
        lcp[open_] = column + 1
    shared_before = common(before, keys[0]) if before is not None else -1
    shared_after = common(keys[-1], after) if after is not None else -1
    lcp[0] = max(shared_before, 0)

    inner = RangeMinimum(lcp)
    smallest = RangeMinimum(least)
    sums = np.concatenate([[0], np.cumsum(np.concatenate([np.array(w, np.int64) for w in words]) if size.sum() else np.zeros(0, np.int64))])
    upto = lambda i, d: sums[start[i] + d] - sums[start[i]]  # noqa: E731  words of the first d turns
    running = lambda x: np.concatenate([[0], np.cumsum(x)])
    next_lcp = np.append(lcp[1:], shared_after)
    total = upto(np.arange(n), size)
    convs, spoken, fresh, leaf = running(copies), running(copies * total), running(total - upto(np.arange(n), lcp)), running(next_lcp < size)
    splits = np.sort(lcp * (n + 1) + np.arange(n))  # places by the depth at which they leave the sequence before

    # Candidates: every prefix at the first sequence that has it; and those that the shard before has begun, the root among them.
    root_here = int(before is None)
    owned = size - lcp + np.where(np.arange(n) == 0, root_here, 0)
    at = np.concatenate([np.zeros(shared_before + 1, np.int64), np.repeat(np.arange(n), owned)])
    first = np.where(np.arange(n) == 0, 1 - root_here, 1) + lcp
    depth = np.concatenate([np.arange(shared_before + 1), np.arange(owned.sum()) - np.repeat(np.cumsum(owned) - owned, owned) + np.repeat(first, owned)])
    own = np.arange(len(at)) > shared_before
    low, high = inner.left(at, depth), inner.right(at, depth)
    closed = own & ((high < n - 1) | (depth > shared_after))
    members = convs[high + 1] - convs[low]
    said = np.where(depth > 0, upto(at, np.maximum(depth - 1, 0)), 0)
    behind = np.minimum(np.searchsorted(splits, depth * (n + 1) + high, "right"), n)
    children = behind - np.searchsorted(splits, depth * (n + 1) + low, "left") + (own & (size[at] > depth))
    children -= own & (lcp[low] == depth) & (depth == 0)  # the root's own first place is no split
    nodes = fresh[high + 1] - fresh[low + 1] + np.where(own, total[at] - said, fresh[low + 1] - fresh[low])
    saved = spoken[high + 1] - spoken[low] - said * members - nodes
    row_of = {(i, d): k for k, (i, d) in enumerate(zip(at.tolist(), depth.tolist(), strict=True)) if own[k] or i == 0}
    # The parent stands at the sequence itself or, for a node that begins a branch, where the search to the left from it ends.
    branch = np.flatnonzero(depth > 0)
    parent_at = at.copy()
    parent_at[branch] = inner.left(at[branch], depth[branch] - 1)
    parent = np.array([row_of.get((i, d - 1), -1) for i, d in zip(parent_at.tolist(), depth.tolist(), strict=True)])
    least_id = smallest.least(low, high)
    inside = (parent >= 0) & closed & closed[parent]
    name = lambda k, d: hashlib.sha256(keys[k][:d * WIDTH]).digest()
    loose = ~closed
    return {
        "closed": closed, "name": [name(k, d) if x else None for k, d, x in zip(at.tolist(), depth.tolist(), loose.tolist(), strict=True)],
        "parent": [name(k, d - 1) if x and d else None for k, d, x in zip(at.tolist(), depth.tolist(), (~inside).tolist(), strict=True)],
        "depth": depth, "conv_id": least_id, "parent_conv_id": [int(least_id[p]) if x else None for p, x in zip(parent, inside, strict=True)],
        "n_convs": members, "n_children": children, "n_leaves": leaf[high + 1] - leaf[low], "saved_tokens": saved,
        "ends_sha256": [ends[k] if x else EMPTY if c else None for k, x, c in zip(at.tolist(), ((size[at] == depth) & own).tolist(), closed.tolist(), strict=True)],
    }


def trie_nodes(sequences: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie of rows ``conv_id, turns`` (arrays of ``name, words``)."""
    spark = sequences.sparkSession
    keyed = cut(sequences.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), "")).alias("key"), F.col("turns.words").alias("words")))
    known = end_digests(keyed)
    distinct = keyed.groupBy("key").agg(F.first("words").alias("words")).join(known, "key")
    distinct = cut(distinct)
    shards = max(-(-distinct.count() // shard), 1)
    dealt = cut(distinct.repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id()))
    # One row per shard: its edges, and with them those of its neighbours (empty shards have none).
    order = W.orderBy("shard")
    edges = dealt.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edges = edges.select("shard", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("words", "array<int>"), ("n", "long"), ("least", "long"), ("ends_sha256", "string"))]
    sides = [edges.filter(F.col(c).isNotNull()).select("shard", F.lit(k).alias("side"), F.col(c).alias("key"), *none) for c, k in (("before", -1), ("after", 1))]
    rows = dealt.select("shard", F.lit(0).alias("side"), "key", "words", "n", "least", "ends_sha256").unionByName(sides[0]).unionByName(sides[1])

    def nodes(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        key = table.column("key").to_pylist()
        edge = {int(s): key[k] for k, s in enumerate(side.tolist()) if s}
        own = sorted(np.flatnonzero(side == 0).tolist(), key=key.__getitem__)
        part = table.take(pa.array(own, pa.int64()))
        found = shard_nodes(
            part.column("key").to_pylist(), part.column("words").to_pylist(), part.column("n").to_numpy(), part.column("least").to_numpy(), part.column("ends_sha256").to_pylist(),
            edge.get(-1), edge.get(1))
        found = {"shard": np.full(len(found["depth"]), table.column("shard")[0].as_py())} | found
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
        return pa.table({c: pa.array(found[c], kinds[t]) for c, t in (x.split() for x in NODE.split(", "))})

    found = cut(rows.groupBy("shard").applyInArrow(nodes, NODE))
    loose = found.filter("NOT closed")
    whole = cut(loose.groupBy("name", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.coalesce(F.max("ends_sha256"), F.lit(EMPTY)).alias("ends_sha256")))
    # Names are looked up per shard: a node with very many children is asked for by each shard once.
    named = whole.select("name", F.col("conv_id").alias("_id"))
    local = loose.select("shard", "name").join(named, "name").select("shard", F.col("name").alias("parent"), "_id")
    inside = found.filter("closed").join(local, ["shard", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_id"))
    upper = whole.join(named.select(F.col("name").alias("parent"), F.col("_id").alias("parent_conv_id")), "parent", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return inside.select(*columns).unionByName(upper.select(*columns))


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns go by turn, null first; turns of one number by the digest of role and text. A null role or text is empty. Rows
    without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Texts of any length
    are hashed where they are read; 16 bytes a turn go on, so the turns of one conversation are held in one row. Other columns
    are not read, whatever their names. An empty table has no conversations and gives no rows.
    """
    return trie_nodes(rebuilt(conversations), shard)
