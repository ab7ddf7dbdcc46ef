"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has an edge for every piece that matches; a character no single piece matches gets an edge of its
own, written as byte pieces. The best path is found left to right. Only the last ``longest piece`` boundaries can still be
extended, so the search keeps a window of that many, and as soon as all paths into the window run through one boundary
the ids up to it are committed. Where no piece reaches over a place (a change from other characters to spaces, or a
character that stands in no longer piece) all paths meet by themselves: texts are cut there first, and the parts that a
task has not met yet are searched together, column by column.

Spaces are written as U+2581 and one is put in front, as in the public format. A literal U+2581 is written as bytes, so
decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import released, whole_text

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 200_000  # parts remembered by a task; the memory starts anew beyond it
WIDE = 48  # longer parts go through the window search one by one


class Vocabulary:
    """Pieces and scores; scores of merge-ranked models are turned into the log-probabilities of a Zipf law."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], bytes_at: Sequence[int], ranked: bool):
        self.pieces = {p: i for i, p in enumerate(pieces) if p}
        self.bytes_at = list(bytes_at)
        score = np.array(scores, float)
        own = np.array(sorted(self.pieces.values()))
        if ranked:
            rank = np.zeros(len(score))
            rank[own] = np.arange(1, len(own) + 1)
            score[own] = -np.log(rank[own]) - np.log((1 / rank[own]).sum())
        self.score = score.tolist()
        self.unknown = float(score[own].min()) - 10.0
        self.longest = max(map(len, self.pieces), default=1)
        self.text = np.array([p.replace(SPACE, " ").encode() for p in pieces], object)
        for value, i in enumerate(self.bytes_at):
            self.text[i] = bytes([value])
        # Cutting before a run of spaces is exact when no piece has a space behind another character.
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        lonely = "".join(c for c in "\n\t" if not any(c in p and len(p) > 1 for p in self.pieces))
        self.parts = re.compile(rf"[{lonely}]| *[^ {lonely}]+| +" if lonely else r" *[^ ]+| +", re.S) if self.splits else re.compile(".+", re.S)
        self.heads = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)]
        pieces = [sp.id_to_piece(i) if plain[i] else "" for i in range(n)]
        at = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        scores = [sp.get_score(i) for i in range(n)]
        ranked = all(s == int(s) for s, p in zip(scores, plain, strict=True) if p)
        return cls(pieces, scores, [at[f"<0x{b:02X}>"] for b in range(256)], ranked)

    def char_ids(self, char: str) -> list[int]:
        return [self.bytes_at[b] for b in char.encode()]


def window_search(part: str, vocabulary: Vocabulary) -> Iterator[int]:
    """Ids of the best path through one part (spaces are plain spaces here), committed as early as they are settled.

    Kept per boundary in the window: best score, the edge that reaches it, and the first boundary behind the last
    committed one on its path. Equal scores prefer the path found first, that is the longer last piece.
    """
    pieces, score, longest, heads = vocabulary.pieces, vocabulary.score, vocabulary.longest, vocabulary.heads
    done, n = 0, len(part)
    best: dict[int, float] = {0: 0.0}
    back: dict[int, tuple[int, int]] = {}
    first: dict[int, int] = {}
    for at in range(n):
        base = best.pop(at)
        root, single, seen = first.pop(at, None), False, ""
        for end in range(at + 1, min(at + longest, n) + 1):
            char = part[end - 1]
            seen += SPACE if char == " " else "\x00" if char == SPACE else char
            if seen not in heads:
                break
            found = pieces.get(seen)
            if found is None:
                continue
            single |= end == at + 1
            new = base + score[found]
            if end not in best or new > best[end]:
                best[end], back[end], first[end] = new, (at, found), end if root is None else root
        if not single:
            new = base + vocabulary.unknown
            if at + 1 not in best or new > best[at + 1]:
                best[at + 1], back[at + 1], first[at + 1] = new, (at, -1), at + 1 if root is None else root
        # All paths that are still alive end in the window; one first boundary among them is settled.
        roots = set(first.values())
        while len(roots) == 1:
            settled = next(iter(roots))
            start, found = back.pop(settled)
            assert start == done
            yield from vocabulary.char_ids(part[start]) if found < 0 else (found,)
            done = settled
            for end in first:
                if end != settled:
                    step = end
                    while back[step][0] != settled:
                        step = back[step][0]
                    first[end] = step
            if done in first:
                first.pop(done)
                break
            roots = set(first.values())
        if at % longest == 0:  # edges behind the last committed boundary are of no more use
            for end in [e for e in back if e <= done]:
                del back[end]


class Searcher:
    """Best paths of many short parts at once, and the memory of parts met before."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.codes: dict[str, int] = {}  # part -> number; with table = flat, starts its ids are flat[starts[number]:starts[number + 1]]
        self.table = np.zeros(0, np.int32), np.zeros(1, np.int64)
        # The prefix tree as sorted (state, character) keys; a state is a row of ``ends`` (piece id or -1).
        heads = sorted(vocabulary.heads, key=len)
        number = {"": 0} | {h: i + 1 for i, h in enumerate(heads)}
        keys = np.array([(number[h[:-1]] << 21) | ord(h[-1]) for h in heads], np.int64)
        states = np.arange(1, len(heads) + 1, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.states = keys[order], states[order]
        self.ends = np.array([-1] + [vocabulary.pieces.get(h, -1) for h in heads], np.int64)
        self.scores = np.array(vocabulary.score)

    def many(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Column-wise search: ids of all parts in one array, and how many each has; as ``window_search`` part by part."""
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        codes = np.where(chars == 0x20, 0x2581, np.where(chars == 0x2581, 0, chars))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.cumsum(size) - size
        end_of = np.repeat(start + size, size)
        n, longest = len(codes), self.vocabulary.longest
        match = np.full((n, longest), -1, np.int32)
        at, state = np.arange(n), np.zeros(n, np.int64)
        for step in range(longest):
            key = (state << 21) | codes[at + step]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[place] == key
            at, state = at[ok], self.states[place[ok]]
            match[at, step] = self.ends[state]
            more = at + step + 1 < end_of[at]
            at, state = at[more], state[more]
            if not len(at):
                break
        best = np.full(n + len(parts), -np.inf)
        last = np.zeros(n + len(parts), np.int32)  # length of the edge that reaches a boundary
        lanes = np.arange(len(parts))
        best[start + lanes] = 0
        for column in range(int(size.max())):
            lanes = lanes[size[lanes] > column]
            where = start[lanes] + column
            bound = where + lanes
            base = best[bound]
            rows = match[where]
            for step in np.flatnonzero((rows >= 0).any(0) | (np.arange(longest) == 0)).tolist():
                found = rows[:, step]
                ok = found >= 0
                new = base + np.where(ok, self.scores[found], self.vocabulary.unknown)
                if step:  # only a single character has an edge of its own
                    own = np.flatnonzero(ok)
                    target, new = bound[own] + step + 1, new[own]
                else:
                    target = bound + 1
                better = new > best[target]
                target = target[better]
                best[target] = new[better]
                last[target] = step + 1
        # Back from every end at once; the pieces fall into their places in the text.
        piece = np.full(n, -2, np.int32)
        lanes = np.arange(len(parts))
        here = start + size
        while len(lanes):
            length = last[here + lanes]
            here = here - length
            piece[here] = match[here, length - 1]
            more = here > start[lanes]
            lanes, here = lanes[more], here[more]
        at = np.flatnonzero(piece > -2)
        ids = piece[at]
        lane = np.searchsorted(start, at, "right") - 1
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            spelled = [self.vocabulary.char_ids(chr(c)) for c in chars[at[unknown]].tolist()]
            width = np.ones(len(ids), np.int64)
            width[unknown] = [len(x) for x in spelled]
            first = np.cumsum(width) - width
            out = np.repeat(ids, width)
            for k, x in zip(first[unknown].tolist(), spelled, strict=True):
                out[k:k + len(x)] = x
            return out, np.bincount(lane, width, len(parts)).astype(np.int64)
        return ids, np.bincount(lane, minlength=len(parts))

    def learn(self, parts: set[str]) -> None:
        """Search the parts that are not known yet; a full memory starts anew."""
        new = [p for p in parts if p not in self.codes]
        if len(self.codes) + len(new) > CACHE:
            self.codes.clear()
            self.table, new = (np.zeros(0, np.int32), np.zeros(1, np.int64)), list(parts)
        short, long = sorted((p for p in new if len(p) <= WIDE), key=len), [p for p in new if len(p) > WIDE]
        ids, sizes = [self.table[0]], [np.diff(self.table[1])]
        for i in range(0, len(short), 20_000):
            for into, x in zip((ids, sizes), self.many(short[i:i + 20_000]), strict=True):
                into.append(x)
        for p in long:
            ids.append(np.fromiter(window_search(p, self.vocabulary), np.int32))
            sizes.append([len(ids[-1])])
        self.codes.update(zip(short + long, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        self.table = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin and end in it."""
        findall = self.vocabulary.parts.findall
        parts = [findall(" " + t) if t else [] for t in texts]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        line = list(chain.from_iterable(parts))
        codes = np.fromiter(map(self.codes.get, line, repeat(-1)), np.int64, len(line))
        if (codes < 0).any():
            held = len(self.codes)
            self.learn({line[i] for i in np.flatnonzero(codes < 0).tolist()} if held < CACHE // 2 else set(line))
            codes = np.fromiter(map(self.codes.__getitem__, line), np.int64, len(line)) if line else codes
        flat, starts = self.table
        low, size = starts[codes], starts[codes + 1] - starts[codes]
        ends = np.cumsum(size)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)] if len(ends) else flat[:0]
        return ids, np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(count)]])


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The text in UTF-8: the pieces' bytes without the space in front."""
    return b"".join(vocabulary.text[ids].tolist())[1:]


def sentencepiece(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_ids, ids, n_bytes, decoded_sha256, round_trip``.

    The whole text is encoded and the ids are decoded again; ``decoded_sha256`` is of the decoded text and ``round_trip``
    says whether it is the text. A null or empty text has no ids. Of paths with equal scores the one found first stays, so
    repeated rows get equal ids. An empty table gives no rows.
    """
    texts = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # a fixed vocabulary, some megabytes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        searcher = Searcher(known)
        for batch in batches:
            size, low = 0, 0
            column = batch.column(1)
            for i in range(len(batch)):
                size += len(column[i].as_buffer())
                if size < 1 << 20 and i + 1 < len(batch) and i - low < 1000:
                    continue
                part = batch.slice(low, i + 1 - low)
                low, size = i + 1, 0
                plain = part.column(1).to_pylist()
                ids, cuts = searcher.encode(plain)
                back = [decode(ids[a:b], known) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                body = [t.encode() for t in plain]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)), pa.array([len(b) for b in body], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([a == b for a, b in zip(body, back, strict=True)])],
                    ["doc_id", "n_ids", "ids", "n_bytes", "decoded_sha256", "round_trip"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(released(rows), f"doc_id {kind}, n_ids long, ids array<int>, n_bytes long, decoded_sha256 string, round_trip boolean")
