"""Repeated passages by suffix arrays.

Each task packs whole texts (long ones in overlapping pieces) into shards of some two million bytes. A shard's suffix
array comes from Larsson-Sadakane refinement: suffixes are sorted by their first characters, and groups that are still
equal are sorted by the rank of the suffix that starts behind, doubling the sorted depth until it covers the passage
length. Kasai's rule gives the common prefixes of neighbours. Runs of neighbours that share a passage give the passages of
the shard, each with the smallest document that holds it.

What a shard has not removed by itself is compared across shards. A passage goes to the bucket named by its smallest
hashed 16-byte string, so consecutive passages mostly travel together as one stretch of text. A bucket's repeated keys are
sorted once, the list of every shard is looked up in them by binary search, and hits are verified byte by byte. Only
ranges of removed starts travel back to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import narrow, whole_text
from .quality import powers

PASSAGE = 50
INDEX = 21  # bits of a position in a shard; three of them fill a sort key
SHARD = (1 << INDEX) - 2
FLUSH = 16 << 20  # bytes of text whose stretches are sent together
BUCKET = 4 << 20  # bytes of text per bucket, about
PART = 4 << 20  # bytes of documents that are finished together, about
GRAM = 16
SPREAD = 1_000_003  # deals ids evenly whatever their step
TEXTS, MARKS = 0, 1


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (small whole numbers), sorted by at least ``depth`` symbols."""
    n, mask = len(symbols), (1 << INDEX) - 1
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    chars = 2 * INDEX // bits
    wide = np.concatenate([symbols, np.zeros(chars, symbols.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(chars):
        key <<= bits
        key |= wide[j:j + n]
    key <<= INDEX
    key |= np.arange(n)
    key.sort()
    order = key & mask
    key >>= INDEX
    new = np.ones(n + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:n])
    start = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
    rank = np.full(n + 64 * max(depth, chars), -1, np.int64)
    rank[order] = start
    slots = np.flatnonzero(~(new[:n] & new[1:]))
    sorted_to = chars
    while sorted_to < depth and len(slots):
        at = order[slots]
        key = ((start[slots] << INDEX) | (rank[at + sorted_to] + 1)) << INDEX | at
        key.sort()
        at = key & mask
        order[slots] = at
        key >>= INDEX
        new = np.ones(len(slots) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        first = np.maximum.accumulate(np.where(new[:-1], slots, 0))
        start[slots] = first
        rank[at] = first
        slots = slots[~(new[:-1] & new[1:])]
        sorted_to *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, strip: int = 128) -> np.ndarray:
    """For every slot of the suffix array, how many bytes it shares with the slot before, up to ``most`` or a little over.

    Kasai's rule: walking through the text, the shared length falls by at most one from a position to the next. It holds
    while the length is below the sorted depth; behind a longer match the count starts anew, since the order inside a
    group of equal passages is open. Strips of the text are walked side by side.
    """
    n = len(order)
    padded = np.concatenate([data, np.zeros(most + 2 * strip + 16, np.uint8)])
    words = np.ndarray(len(padded) - 8, "<u8", padded, strides=(1,))
    before = np.full(n + strip, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n + strip, np.int64)
    lanes = np.arange(0, n, strip)
    have = np.zeros(len(lanes), np.int64)
    one = np.uint64(1)
    for step in range(strip):
        here = lanes + step
        there = before[here]
        have = np.maximum(np.where(have >= most, 0, have - 1), 0)
        have[there < 0] = 0
        active = np.flatnonzero((there >= 0) & (have < most))
        while len(active):
            x = words[here[active] + have[active]] ^ words[there[active] + have[active]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + one)) - one) >> 3).astype(np.int64)
            have[active] += same
            active = active[(same == 8) & (have[active] < most)]
        shared[here] = have
    return shared[order]


def own_marks(order: np.ndarray, shared: np.ndarray, valid: np.ndarray, owner: np.ndarray, passage: int) -> np.ndarray:
    """Which starts hold a passage that a smaller owner of the same shard holds too."""
    marked = np.zeros(len(order), bool)
    same = shared >= passage
    same[0] = False
    member = same.copy()
    member[:-1] |= same[1:]
    slots = np.flatnonzero(member)
    if len(slots):
        at = order[slots]
        heads = np.flatnonzero(~same[slots])
        owners = owner[at]
        good = valid[at]
        least = np.minimum.reduceat(np.where(good, owners, np.iinfo(owners.dtype).max), heads)
        least = np.repeat(least, np.diff(np.append(heads, len(slots))))
        marked[at[good & (least < owners)]] = True
    return marked


def gram_minima(data: np.ndarray, passage: int) -> np.ndarray:
    """The smallest hash among the 16-byte strings inside the passage at each start; it depends on the passage only."""
    table = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
    h = table[np.concatenate([data, np.zeros(passage + GRAM, np.uint8)])]
    size = 1
    for factor in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F):
        h = h[:-size] * np.uint32(factor) + h[size:]
        size *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    need, size = passage - GRAM + 1, 1
    while size * 2 <= need:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if need > size:
        h = np.minimum(h[:size - need], h[need - size:])
    return h[:len(data)]


def pack(*columns: np.ndarray) -> bytes:
    """Whole-number columns of equal length, each in the narrowest type."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        low, high = (int(c.min()), int(c.max())) if len(c) else (0, 0)
        kind = next(k for k in ("<u1", "<u2", "<u4", "<i8") if k == "<i8" or low >= 0 and high <= np.iinfo(k).max)
        out += [bytes([np.dtype(kind).itemsize]), np.ascontiguousarray(c, kind).tobytes()]
    return b"".join(out)


def unpack(blob: memoryview, columns: int) -> tuple[list[np.ndarray], int]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for _ in range(columns):
        width = blob[at]
        out.append(np.frombuffer(blob, f"<{'i' if width == 8 else 'u'}{width}", n, at + 1).astype(np.int64))
        at += 1 + n * width
    return out, at


def ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers in a rising array."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut + 1])] if len(starts) else starts, starts[np.concatenate([cut, [len(starts) - 1]])] if len(starts) else starts


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows of sorted columns begins."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal rows of sorted columns."""
    heads = heads_of(*columns).tolist()
    return list(zip(heads, [*heads[1:], len(columns[0])][:len(heads)], strict=True))


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return ids % SPREAD % parts


class Stretches:
    """What a task sends: removed starts by part of the documents, and stretches of text by bucket."""

    def __init__(self, buckets: int, parts: int, passage: int):
        self.buckets, self.parts, self.passage = buckets, parts, passage
        self.clear()

    def clear(self) -> None:
        self.size, self.texts, self.meta, self.marks = 0, [], [], []

    def shard(self, pieces: list[tuple[int, int, int, np.ndarray]]) -> None:
        """Work through one shard of pieces (doc_id, tag, offset in the document, bytes)."""
        passage = self.passage
        size = np.array([len(p[3]) + 1 for p in pieces])
        head = np.concatenate([[0], np.cumsum(size)])[:-1]
        n = int(size.sum())
        data = np.zeros(n, np.uint8)
        for p, at in zip(pieces, head.tolist(), strict=True):
            data[at:at + len(p[3])] = p[3]
        used = np.bincount(data, minlength=256) > 0
        code = np.cumsum(used).astype(np.int16)
        symbols = code[data]
        symbols[head + size - 1] = 0  # a piece ends
        valid = np.ones(n, bool)
        tails = (head + size - passage)[:, None] + np.arange(passage)[None, :]
        valid[tails[tails >= np.repeat(head, passage).reshape(tails.shape)]] = False
        ids = np.array([p[0] for p in pieces], np.int64)
        numbers = np.unique(ids, return_inverse=True)[1].astype(np.int32)
        order = suffix_array(symbols, passage)
        marked = own_marks(order, common_prefixes(data, order, passage), valid, np.repeat(numbers, size), passage)
        del order, symbols
        tags, offsets = np.array([p[1] for p in pieces], np.int64), np.array([p[2] for p in pieces], np.int64)
        low, high = ranges(np.flatnonzero(marked))
        piece = np.searchsorted(head, low, "right") - 1
        self.marks.append((ids[piece], tags[piece], offsets[piece] + low - head[piece], offsets[piece] + high - head[piece]))
        send = valid & ~marked
        least = gram_minima(data, passage)
        new = send.copy()
        new[1:] &= ~send[:-1] | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        stops = send.copy()
        stops[:-1] &= ~send[1:] | new[1:]
        last = np.flatnonzero(stops)
        piece = np.searchsorted(head, first, "right") - 1
        mixed = (least[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        bucket = (mixed % np.uint64(self.buckets)).astype(np.int64)
        whole = data.tobytes()
        self.texts += [whole[a:b] for a, b in zip(first.tolist(), (last + passage).tolist(), strict=True)]
        self.meta.append((bucket, ids[piece], tags[piece], offsets[piece] + first - head[piece], last - first + 1))
        self.size += n

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        squeeze = zstandard.ZstdCompressor(level=3)
        if self.meta:
            bucket, *columns = (np.concatenate(c) for c in zip(*self.meta, strict=True))
            order = np.argsort(bucket, kind="stable")
            for a, b in runs(bucket[order]):
                rows = order[a:b]
                ids, tags, starts, counts = (c[rows] for c in columns)
                text = b"".join([self.texts[i] for i in rows.tolist()])
                yield TEXTS, int(bucket[order[a]]), squeeze.compress(pack(np.diff(ids, prepend=0), tags, starts, counts) + text)
        yield from mark_rows(*(np.concatenate(c) for c in zip(*self.marks, strict=True)), self.parts) if self.marks else ()
        self.clear()


def mark_rows(ids: np.ndarray, tags: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    part = part_of(ids, parts)
    order = np.lexsort((low, ids, part))
    squeeze = zstandard.ZstdCompressor(level=3)
    for a, b in runs(part[order]):
        rows = order[a:b]
        yield MARKS, int(part[order[a]]), squeeze.compress(pack(np.diff(ids[rows], prepend=0), tags[rows], low[rows], high[rows] - low[rows]))


NO_ID = np.iinfo(np.int64).min


def text_rows(held: list[tuple[int, int, bytes]], parts: int) -> Iterator[tuple[int, int, bytes]]:
    if not held:
        return
    ids = np.array([r[0] for r in held], np.int64)
    part = np.where(ids == NO_ID, 0, part_of(ids, parts))
    order = np.argsort(part, kind="stable")
    squeeze = zstandard.ZstdCompressor(level=3)
    for a, b in runs(part[order]):
        rows = order[a:b].tolist()
        with np.errstate(over="ignore"):
            steps = np.diff(ids[order[a:b]], prepend=0)
        body = [held[r][2] for r in rows]
        yield TEXTS, int(part[rows[0]]), squeeze.compress(pack(steps, np.array([held[r][1] for r in rows], np.int64), np.array([len(x) for x in body], np.int64)) + b"".join(body))


SENT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
SENT_DDL = "kind int, part int, blob binary"


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), SENT, strict=True)] if rows else [pa.array([], k.type) for k in SENT], schema=SENT)


def passage_keys(data: np.ndarray, at: np.ndarray, passage: int) -> np.ndarray:
    """A 64-bit polynomial hash of the passage at each of the rising starts, a stretch of the data at a time."""
    keys = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + (1 << 20), 1 << 20))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            continue
        low, place = int(at[a]), at[a:b] - at[a]
        part = data[low:int(at[b - 1]) + passage]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        keys[a:b] = (sums[place + passage] - sums[place]) * down[place]
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(29))


def across_shards(blobs: list[bytes], passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of one bucket whose passage a smaller document of any shard holds: ids, tags, first and last start."""
    columns, texts = [], []
    for blob in blobs:
        raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
        meta, at = unpack(raw, 4)
        columns.append((np.cumsum(meta[0]), *meta[1:]))
        texts.append(np.frombuffer(raw, np.uint8, offset=at))
    lists = np.cumsum([len(c[0]) for c in columns])
    ids, tags, starts, counts = (np.concatenate(c) for c in zip(*columns, strict=True))
    data = np.concatenate(texts)
    del columns, texts
    nothing = tuple(np.zeros(0, np.int64) for _ in range(4))
    ends = np.cumsum(counts)
    head = np.concatenate([[0], np.cumsum(counts + passage - 1)])[:-1]
    at = np.arange(ends[-1]) + np.repeat(head - (ends - counts), counts)
    keys = passage_keys(data, at, passage)
    # The keys that occur again, sorted; a small table tells most others apart before the search.
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(again):
        return nothing
    table = np.zeros(1 << 20, bool)
    table[(again >> np.uint64(44)).astype(np.int64)] = True
    hit = np.flatnonzero(table[(keys >> np.uint64(44)).astype(np.int64)])
    found = keys[hit]
    del keys
    place = np.empty(len(hit), np.int64)
    borders = np.searchsorted(hit, np.concatenate([[0], ends[lists - 1]]))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):  # the list of one shard
        order = np.argsort(found[a:b])
        place[a:b][order] = np.searchsorted(again, found[a:b][order])
    place = np.minimum(place, len(again) - 1)
    ok = again[place] == found
    hit, place = hit[ok], place[ok]
    own = np.searchsorted(ends, hit, "right")
    owners, owner = np.unique(ids, return_inverse=True)
    owner = owner[own]
    # The smallest document of each key, and one place where it has the passage.
    least = np.full(len(again), np.iinfo(np.int64).max)
    np.minimum.at(least, place, owner << 32 | np.arange(len(hit)))
    least = least[place]
    marked = np.flatnonzero(owner > least >> 32)
    # Verified word by word against that place.
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    mine, first = at[hit[marked]], at[hit[least[marked] & 0xFFFFFFFF]]
    same = np.ones(len(marked), bool)
    for step in (*range(0, passage - 8, 8), passage - 8):
        same &= words[mine + step] == words[first + step]
    if not same.all():  # different passages under one key: settle those keys by the passages themselves
        wrong = np.isin(place, place[marked[~same]])
        text = lambda k: data[at[hit[k]]:at[hit[k]] + passage].tobytes()
        best: dict[bytes, int] = {}
        for k in np.flatnonzero(wrong).tolist():
            best[text(k)] = min(best.get(text(k), len(owners)), int(owner[k]))
        settled = [k for k in np.flatnonzero(wrong).tolist() if owner[k] > best[text(k)]]
        marked = np.union1d(marked[~wrong[marked]], np.array(settled, np.int64))
    gone, own = hit[marked], own[marked]
    if not len(gone):
        return nothing
    cut = np.flatnonzero((np.diff(gone) != 1) | (np.diff(own) != 0))
    a, b = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(gone) - 1]])
    stretch = own[a]
    inside = gone - (ends - counts)[own]
    return ids[stretch], tags[stretch], starts[stretch] + inside[a], starts[stretch] + inside[b]


def finish(text: memoryview, low: np.ndarray, high: np.ndarray, passage: int) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the digest of what is left."""
    if not len(low):
        return 0, 0, hashlib.sha256(text).hexdigest()
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(high[order] + passage)
    opens = np.concatenate([[True], low[1:] > end[:-1]])
    first = low[opens]
    last = end[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(end) - 1]])]
    digest, at = hashlib.sha256(), 0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        digest.update(text[at:a])
        at = b
    digest.update(text[at:])
    return int((last - first).sum()), len(first), digest.hexdigest()


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, shard: int = SHARD,
                 bucket_bytes: int = BUCKET, part_bytes: int = PART) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Bytes covered by a ``passage``-byte string that also starts in a document with a smaller id are removed; strings are
    judged on the input. A null text is empty. A row without an id loses nothing and makes no other row lose anything.
    Rows that share an id are one document to the rule: neither loses to the other, repeated rows give repeated results.
    An empty table gives no rows.
    """
    if not GRAM <= passage or not passage < shard <= SHARD:
        raise ValueError(f"a passage has {GRAM} bytes at least and fits in a shard of {SHARD} bytes at most")
    docs = narrow(df, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("text"), F.lit(1 << 16)).alias("tag"), whole_text().cast("binary").alias("body"))
    total = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets, parts = total // bucket_bytes + 1, total // part_bytes + 1

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Stretches(buckets, parts, passage)
        held: list[tuple[int, int, int, np.ndarray]] = []
        size = 0
        for batch in batches:
            for doc_id, tag, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                if doc_id is None or len(data) < passage:
                    continue
                for at in range(0, len(data) - passage + 1, shard - passage):
                    piece = data[at:at + shard - 1]
                    if size + len(piece) + 1 > shard:
                        out.shard(held)
                        held, size = [], 0
                        if out.size >= FLUSH:
                            yield as_batch(list(out.rows()))
                    held.append((doc_id, tag, at, piece))
                    size += len(piece) + 1
            held = [(*p[:3], p[3].copy()) for p in held]  # the batch's memory goes back
        if held:
            out.shard(held)
        yield as_batch(list(out.rows()))

    def merge(key, table):
        if key[0].as_py() == MARKS:
            return table
        found = across_shards(table.column("blob").to_pylist(), passage)
        return pa.Table.from_batches([as_batch(list(mark_rows(*found, parts)))])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole texts by part, packed: they move once, to be finished."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for doc_id, tag, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append((NO_ID if doc_id is None else doc_id, tag, body))
                size += len(body)
                if size >= FLUSH:
                    yield as_batch(list(text_rows(held, parts)))
                    held, size = [], 0
        yield as_batch(list(text_rows(held, parts)))

    def clean(key, texts: pa.Table, marks: pa.Table) -> pa.Table:
        columns = []
        for blob in marks.column("blob").to_pylist():
            (steps, tags, low, length), _ = unpack(memoryview(zstandard.ZstdDecompressor().decompress(blob)), 4)
            columns.append((np.cumsum(steps), tags, low, low + length))
        ids, tags, low, high = (np.concatenate(c) for c in zip(*columns, strict=True)) if columns else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((tags, ids))
        ids, tags, low, high = ids[order], tags[order], low[order], high[order]
        spans = {(int(ids[a]), int(tags[a])): (a, b) for a, b in runs(ids, tags)}
        rows = []
        for blob in texts.column("blob").to_pylist():
            raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
            (steps, own_tags, size), at = unpack(raw, 3)
            for doc_id, tag, n in zip(np.cumsum(steps).tolist(), own_tags.tolist(), size.tolist(), strict=True):
                a, b = spans.get((doc_id, tag), (0, 0))
                rows.append((None if doc_id == NO_ID else doc_id, n, *finish(raw[at:at + n], low[a:b], high[a:b], passage)))
                at += n
        return pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds) if rows else kinds.empty_table()

    sent = docs.mapInArrow(shards, SENT_DDL)
    marks = sent.groupBy("kind", "part").applyInArrow(merge, SENT_DDL)
    texts = docs.mapInArrow(ship, SENT_DDL)
    return texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(
        clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
