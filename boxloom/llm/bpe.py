"""Byte-level BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be merged over: between two such bytes there is a
certain cut. A text is taken apart at its added tokens, then by the vocabulary's own pattern, then at every certain cut; the
fragments are encoded independently of each other and their ids are put together again.

Fragments are merged side by side in one array: in every round each fragment merges its lowest-ranked pair, wherever it
stands in it. The merge table is checked on loading for what makes that exact: every merge makes a token of its own, out of
tokens that are bytes or were made before. Fragments of more than ``LONG`` bytes are merged with a heap instead.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import released, whole_text

FILE = "byte_bpe_50k.json"
KNOWN = 200_000  # pieces of text remembered by a task; the memory starts anew beyond it
LONG = 2048
SLICE = 1 << 20  # bytes of text that are encoded together
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The published stand-in characters of byte-level vocabularies: printable Latin-1 is itself, the rest moves to U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and certain cuts of a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: dict, pattern: str):
        model = spec["model"]
        value = {c: b for b, c in enumerate(byte_letters())}
        self.pattern = pattern
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", ())):
            raise ValueError("added tokens that strip, normalise or want single words are not read here")
        plain = {t: i for t, i in model["vocab"].items() if t not in self.added}
        self.spelled: list[bytes] = [b""] * (max([*plain.values(), *self.added.values()]) + 1)
        for token, i in plain.items():
            self.spelled[i] = bytes(value[c] for c in token)
        for token, i in self.added.items():
            self.spelled[i] = token.encode()
        self.first = np.array([plain[c] for c in byte_letters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [plain[a + b] for a, b in pairs]
        ready = set(self.first.tolist())
        for (a, b), i in zip(pairs, made, strict=True):
            if plain[a] not in ready or plain[b] not in ready or i in ready:
                raise ValueError("merges must make each token once, out of tokens made before")
            ready.add(i)
        key = np.array([plain[a] << 32 | plain[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)  # sorted pairs and their ranks
        self.made = np.array(made, np.int32)
        self.inside = np.zeros((256, 256), bool)
        for i in plain.values():
            token = np.frombuffer(self.spelled[i], np.uint8)
            self.inside[token[:-1], token[1:]] = True

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """From a file; the installed public vocabulary if none is named."""
        import public_tokenizers

        with open(path or public_tokenizers.path(FILE), encoding="utf-8") as f:
            return cls(json.load(f), public_tokenizers.PATTERN)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``NONE`` for pairs that are not merged."""
        key = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], NONE)


def merge_one(ids: Sequence[int], vocabulary: Vocabulary) -> list[int]:
    """One long fragment: pairs in a heap by rank and place, neighbours by links."""
    n, ids = len(ids), list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(vocabulary.rank_of(np.array([a]), np.array([b]))[0])
        return known[a, b]

    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) != NONE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:  # one of them was merged in the meantime
            continue
        ids[i], ids[j] = int(vocabulary.made[r]), -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := rank(ids[left], ids[right])) != NONE:
                heapq.heappush(heap, (r, left, ids[left], ids[right]))
    return [i for i in ids if i >= 0]


def merge_all(ids: np.ndarray, size: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge many fragments (their byte ids one after the other, and their sizes): ids in order, and ids per fragment."""
    lane = np.repeat(np.arange(len(size)), size)
    done_ids, done_lane = [], []
    for k in np.flatnonzero(size > LONG).tolist():
        done_ids.append(np.array(merge_one(ids[lane == k].tolist(), vocabulary), np.int32))
        done_lane.append(np.full(len(done_ids[-1]), k))
    short = size[lane] <= LONG
    ids, lane = ids[short].copy(), lane[short]
    rank = np.full(len(ids), NONE, np.int32)  # of the pair that starts here
    if len(ids):
        joint = np.flatnonzero(lane[:-1] == lane[1:])
        rank[joint] = vocabulary.rank_of(ids[joint], ids[joint + 1])
    while len(ids):
        start = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        length = np.diff(np.append(start, len(ids)))
        best = np.minimum.reduceat(rank, start)
        over = np.repeat(best == NONE, length)
        done_ids.append(ids[over])
        done_lane.append(lane[over])
        best = np.repeat(best, length)[~over]
        ids, lane, rank = ids[~over], lane[~over], rank[~over]
        if not len(ids):
            break
        here = np.flatnonzero(rank == best)
        # Places that overlap (a run of one token): every second one of the run, from its left end.
        run = np.maximum.accumulate(np.where(np.diff(here, prepend=-2) > 1, np.arange(len(here)), 0))
        here = here[(np.arange(len(here)) - run) % 2 == 0]
        ids[here] = vocabulary.made[rank[here]]
        stay = np.ones(len(ids), bool)
        stay[here + 1] = False
        fresh = np.zeros(len(ids), bool)
        fresh[here] = True
        ids, lane, fresh, rank = ids[stay], lane[stay], fresh[stay], rank[stay]
        changed = np.flatnonzero(fresh)
        changed = np.union1d(changed, changed[changed > 0] - 1)
        rank[changed] = NONE
        changed = changed[changed + 1 < len(ids)]
        changed = changed[lane[changed] == lane[changed + 1]]
        rank[changed] = vocabulary.rank_of(ids[changed], ids[changed + 1])
    lanes = np.concatenate([*done_lane, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(lanes, kind="stable")
    return np.concatenate([*done_ids, np.zeros(0, np.int32)]).astype(np.int32)[order], np.bincount(lanes, minlength=len(size))


def fragments(pieces: Sequence[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the pieces one after the other, sizes of their fragments, and fragments per piece."""
    held = [p.encode() for p in pieces]
    raw = np.frombuffer(b"".join(held), np.uint8)
    width = np.fromiter(map(len, held), np.int64, len(held))
    cut = np.zeros(len(raw), bool)
    cut[1:] = ~vocabulary.inside[raw[:-1], raw[1:]]
    cut[np.cumsum(width) - width] = True
    start = np.flatnonzero(cut)
    home = np.searchsorted(np.cumsum(width), start, "right")
    return raw, np.diff(np.append(start, len(raw))), np.bincount(home, minlength=len(held))


class Encoder:
    """Encodes texts, and remembers the pieces of text it has met."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        longest_first = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str | int, int] = {i: k for k, i in enumerate(self.vocabulary.added.values())}  # an added token goes by its id
        self.ids = np.array(list(self.number), np.int32)
        self.start = np.arange(len(self.number) + 1)

    def pieces(self, text: str) -> list[str | int]:
        if self.added is None or not self.added.search(text):
            return self.find(text)
        out: list[str | int] = []
        for k, part in enumerate(self.added.split(text)):
            out += [self.vocabulary.added[part]] if k % 2 else self.find(part)
        return out

    def learn(self, pieces: list[str]) -> None:
        raw, size, count = fragments(pieces, self.vocabulary)
        ids, made = merge_all(self.vocabulary.first[raw], size, self.vocabulary)
        ends = np.concatenate([[0], np.cumsum(made)])[np.cumsum(count)]
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces)), strict=True))
        self.ids, self.start = np.concatenate([self.ids, ids]), np.concatenate([self.start, self.start[-1] + ends])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where the ids of each text begin (and the last one's end)."""
        if len(self.number) > KNOWN:
            self.forget()
        parts = [self.pieces(t) for t in texts]
        line = [p for part in parts for p in part]
        if new := [p for p in dict.fromkeys(line) if p not in self.number]:
            self.learn(new)
        code = np.fromiter(map(self.number.__getitem__, line), np.int64, len(line))
        size = self.start[code + 1] - self.start[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[code] - ends[:-1], size)]
        return ids, np.concatenate([[0], ends[np.cumsum([len(p) for p in parts])]]).astype(np.int64) if parts else np.zeros(1, np.int64)


def decode(ids: np.ndarray, spelled: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(spelled[ids].tolist()).decode("utf-8", "replace")


def _slices(batch: pa.RecordBatch, column: int, width: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``SLICE`` bytes, so that a long text is worked on alone."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset:][:len(batch) + 1].astype(np.int64) * width
    low = 0
    while low < len(batch):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def bpe_encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` per row: the ids of the whole text.

    A null or empty text has no ids; an added token written in a text is that token. Rows that repeat are encoded alike, a
    null id stays null, an empty table gives no rows. Other columns are not read, whatever their names are. A very long text
    is worked on alone, its fragments together.
    """
    texts = df.select(df[id_col].alias("doc_id"), whole_text(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # a fixed vocabulary, some megabytes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in _slices(batch, 1, 1):
                ids, cuts = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return texts.mapInArrow(released(rows), f"doc_id {dict(texts.dtypes)['doc_id']}, ids array<int>")


def bpe_decode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, text`` per row: ids, and the text they stand for; null ids are read as none, null elements are skipped."""
    given = df.select(df[id_col].alias("doc_id"), F.coalesce(F.filter(F.col(ids_col).cast("array<int>"), lambda i: i.isNotNull()), F.array().cast("array<int>")).alias("ids"))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.spelled)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = np.array(shared.value, object)
        for batch in batches:
            for part in _slices(batch, 1, 4):
                column = part.column(1)
                cuts = column.offsets.to_numpy()
                flat = column.values.to_numpy()
                text = [decode(flat[a:b], spelled) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return given.mapInArrow(released(rows), f"doc_id {dict(given.dtypes)['doc_id']}, ids array<int>, text string")


def token_digests(df: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows ``doc_id, ids, text``."""
    return df.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
