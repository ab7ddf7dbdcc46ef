"""Katz backoff scores of texts.

Words are named by 64-bit hashes. The model's tables lie in buckets:

* words: by a hash of the word, every training word with its count, answered to each bucket of pairs that has the word;
* pairs: by a hash of the history word, with the counted pairs and, per history, how many of them occur once, twice and so
  on and the unigram probability of all of them. The backoff weight of a history follows exactly: what discounting
  leaves over what the unigrams give to other words, so that each history's distribution sums to one.

A token is evaluated recursively: a counted pair has its Good-Turing discounted probability, any other pair the backoff
weight of its history times the unigram probability, and an unknown word the mass the unigrams leave.

Texts send their pairs once, in blocks. The discount factors are known only when all pairs are counted, so a bucket
returns sums that hold them as unknowns: how many pairs of each low count a text has, and which weights it needs.
Histories that would fill a bucket are dealt by both words, and so is the start of a text; which ones is a matter of
layout and is read off a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, cut, whole_text
from .quality import _KINDS, span_hashes
from .suffix_dedup import NO_ID, heads_of, pack, runs, unpack

START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000002)
BLOCK = 6 << 20  # bytes of text a task counts at once
BUCKET = 16 << 20  # bytes of text per bucket, about
PART = 16 << 20  # bytes of documents that are summed together, about
SAMPLE = 64 << 20  # bytes of text that decide which histories are dealt by both words
KEPT = 5  # higher counts are reliable: only LEAST of an occurrence is taken off, so that every history leaves something
LEAST = 0.01
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SUMS, LATER, COMMON, TIMES = 0, 1, 2, 3


@dataclass
class Tokens:
    """Token pairs of a block of texts."""

    row: np.ndarray  # index into the block's texts
    history: np.ndarray
    word: np.ndarray


def pairs_of(data: np.ndarray, cuts: np.ndarray, before: np.uint64 = START, ends: bool = True) -> Tokens:
    """Pairs (history, word) of the texts that end at ``cuts[1:]``; every text begins behind START and ends with END.

    ``before`` is the history of the first word of the first text, and without ``ends`` the last text goes on.
    """
    n = len(cuts) - 1
    data = LOWER[data]
    space = _KINDS["space"][data] if len(data) else np.zeros(0, bool)
    first = ~space
    first[1:] &= space[:-1]
    at = cuts[:-1][cuts[:-1] < cuts[1:]]
    first[at] = ~space[at]
    start = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    del first, last, space
    names = span_hashes(data, start, end)
    del end, data
    names[(names == START) | (names == END)] += np.uint64(11)
    text = np.minimum(np.searchsorted(cuts, start, "right") - 1, n - 1)
    del start
    words = np.bincount(text, minlength=n)
    slot = np.concatenate([[0], np.cumsum(words + 1)])
    history, word = np.empty(slot[-1], np.uint64), np.empty(slot[-1], np.uint64)
    place = np.arange(len(names)) + text
    word[place] = names
    word[slot[1:] - 1] = END
    history[place + 1] = names
    history[slot[:-1]] = START
    history[0] = before
    row = np.repeat(np.arange(n), words + 1)
    keep = len(row) - (not ends)
    return Tokens(row[:keep], history[:keep], word[:keep])


def blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Tokens]]:
    """(row numbers, ids, training flags, pairs) of texts of some ``block`` bytes together; batches are doc_id, train, body."""
    held: list[tuple[int, int, bool, bytes]] = []
    size = number = 0

    def out(rows, before=START, ends=True):
        body = np.frombuffer(b"".join([r[3] for r in rows]), np.uint8)
        cuts = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int64)
        return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], np.array([r[2] for r in rows], bool), pairs_of(body, cuts, before, ends)

    for batch in batches:
        for doc_id, train, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            body = body.as_py()
            if size and size + len(body) > block:
                yield out(held)
                held, size = [], 0
            if len(body) > block:  # one long text, word for word, with the last word carried over
                at, before = 0, START
                while True:
                    cut_at = min(at + block, len(body))
                    if cut_at < len(body):
                        spaces = np.flatnonzero(_KINDS["space"][np.frombuffer(body, np.uint8, cut_at - at, at)])
                        cut_at = at + int(spaces[-1]) + 1 if len(spaces) else len(body)
                    found = out([(number, doc_id, train, body[at:cut_at])], before, cut_at == len(body))
                    if len(found[3].word):
                        before = found[3].word[-1]
                    yield found
                    at = cut_at
                    if at >= len(body):
                        break
            else:
                held.append((number, doc_id, train, body))
                size += len(body)
            number += 1
    if held:
        yield out(held)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def bucket_of(history: np.ndarray, word: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    """By history; by both words where the history is frequent (``frequent`` is sorted)."""
    place = np.minimum(np.searchsorted(frequent, history), len(frequent) - 1)
    both = frequent[place] == history
    return (mix(np.where(both, history ^ mix(word), history)) % np.uint64(buckets)).astype(np.int64)


def names_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, index = np.unique(x, return_inverse=True)
    return names, index


def squeeze(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(columns))


def hashes(names: np.ndarray) -> bytes:
    return len(names).to_bytes(8, "little") + names.tobytes()


def read_hashes(raw: memoryview, at: int) -> tuple[np.ndarray, int]:
    n = int.from_bytes(raw[at:at + 8], "little")
    return np.frombuffer(raw, np.uint64, n, at + 8), at + 8 + 8 * n


def discounts(times: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing factors for counts 0..KEPT from ``times[r]``, the number of items counted r times.

    Where the counts of counts don't allow a factor between 0 and 1, half an occurrence is taken off instead.
    """
    out = np.ones(KEPT + 1)
    spare = (KEPT + 1) * times[KEPT + 1] / times[1] if times[1] else 1.0
    for r in range(1, KEPT + 1):
        value = ((r + 1) * times[r + 1] / (r * times[r]) - spare) / (1 - spare) if times[r] and spare < 1 else 0.0
        out[r] = value if 0 < value < 1 else 1 - 0.5 / r
    return out


def discounted(count: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.where(count <= KEPT, count * factors[np.minimum(count, KEPT)], count - LEAST)


def freed(times: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """What discounting takes off, for rows of counts of counts: once, ..., KEPT times, more often."""
    return times[..., :KEPT] @ ((1 - factors[1:]) * np.arange(1, KEPT + 1)) + LEAST * times[..., KEPT]


@dataclass
class Unigrams:
    """Figures of the unigram distribution; ``left`` is the probability of an unknown word."""

    total: int
    distinct: int
    factors: np.ndarray
    left: float

    @classmethod
    def of(cls, total: int, distinct: int, times: np.ndarray) -> Unigrams:
        factors = discounts(times)
        rows = np.append(times[1:KEPT + 1], distinct - times[1:KEPT + 1].sum())
        return cls(total, distinct, factors, float(freed(rows, factors)) / total if total else 1.0)

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.factors) / max(self.total, 1), self.left)


def frequent_histories(docs: DataFrame, size: int, buckets: int, block: int) -> np.ndarray:
    """START and the words that hold over a quarter of an even bucket in a sample of the texts: 4 * buckets at most."""
    if buckets == 1:
        return np.array([START])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, tokens in blocks(batches, block):
            words, counts = np.unique(tokens.history[tokens.history != START], return_counts=True)
            keep = counts * 16 * buckets > len(tokens.history)
            yield pa.RecordBatch.from_arrays([pa.array(words[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64)), pa.array(np.full(keep.sum(), len(tokens.history)))], ["word", "n", "of"])

    found = docs.sample(min(1.0, SAMPLE / max(size, 1)), 1).mapInArrow(rows, "word long, n long, of long")
    share = found.groupBy("word").agg((F.sum("n") / F.max("of")).alias("share")).orderBy(F.desc("share"), "word").limit(4 * buckets)
    return np.unique(np.append(np.array([x.word for x in share.collect()], np.int64).view(np.uint64), START))


def katz_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2,
                bucket_bytes: int = BUCKET, part_bytes: int = PART, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from rows whose crc32(id) mod ``modulus`` is not ``held`` (rows without an id are learned from) and
    scores all. A null or empty text is one end token. Without training rows every token is unknown and has probability
    one in ``score``. Repeated rows are scored, and learned from, each for itself. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_mod(id_col, modulus) != held, F.lit(True)).alias("train"), whole_text(text_col).cast("binary").alias("body"))
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets, parts = size // bucket_bytes + 1, size // part_bytes + 1
    frequent = frequent_histories(docs, size, buckets, block)

    # Words: counts, and the buckets of pairs that ask for them.
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, train, tokens in blocks(batches, block):
            bucket = bucket_of(tokens.history, tokens.word, frequent, buckets)
            learned = train[tokens.row].astype(np.int64)
            order = np.lexsort((bucket, tokens.word))
            word, bucket, learned = tokens.word[order], bucket[order], learned[order]
            heads = heads_of(word, bucket)
            times = np.add.reduceat(learned, heads) if len(heads) else heads
            word, bucket = word[heads], bucket[heads]
            part = (mix(word ^ np.uint64(0x5BD1E995)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows = []
            for a, b in runs(part[order]):
                own = order[a:b]
                names, index = names_of(word[own])
                rows.append((int(part[own[0]]), squeeze(hashes(names), pack(np.diff(index, prepend=0), bucket[own], times[own]))))
            del tokens, word, bucket, learned, times, part, order  # the next block is made while this frame lives
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

    answer_ddl = "bucket int, blob binary, word long, n long, times array<long>"
    answer_schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("word", pa.int64()), ("n", pa.int64()), ("times", pa.list_(pa.int64()))])

    def answer(key, table):
        words, targets, times = [], [], []
        for blob in table.column("blob").to_pylist():
            raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
            names, at = read_hashes(raw, 0)
            (steps, bucket, n), _ = unpack(raw[at:], 3)
            words.append(names[np.cumsum(steps)])
            targets.append(bucket.astype(np.int32))
            times.append(n)
        word, target, n = np.concatenate(words), np.concatenate(targets), np.concatenate(times)
        names, index = names_of(word)
        total = np.bincount(index, n, len(names)).astype(np.int64)
        order = np.lexsort((index, target))
        heads = heads_of(target[order], index[order])
        pick = order[heads]
        rows = []
        for a, b in runs(target[pick]):
            own = index[pick[a:b]]
            rows.append((int(target[pick[a]]), squeeze(hashes(names[own]), pack(total[own])), None, None, None))
        seen = total[total > 0]
        rows.append((None, None, None, int(seen.sum()), [len(seen), *np.bincount(np.minimum(seen, KEPT + 2), minlength=KEPT + 3)[1:KEPT + 2].tolist()]))
        common = np.flatnonzero(np.isin(names, frequent) | (names == END))
        rows += [(None, None, int(names[k].view(np.int64)), int(total[k]), None) for k in common.tolist()]
        return pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), answer_schema, strict=True)], schema=answer_schema)

    answers = cut(docs.mapInArrow(ask, "part int, blob binary").groupBy("part").applyInArrow(answer, answer_ddl))
    figures = answers.filter("times IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[F.coalesce(F.sum(F.col("times")[k]), F.lit(0)).alias(f"t{k}") for k in range(KEPT + 2)]).first()
    single = Unigrams.of(figures.total, figures.t0, np.array([0] + [figures[f"t{r}"] for r in range(1, KEPT + 2)], float))
    known_counts = {int(np.int64(x.word).view(np.uint64)): x.n for x in answers.filter("word IS NOT NULL").select("word", "n").collect()}  # the frequent ones and END
    end_count = known_counts.get(int(END), 0)
    frequent_count = np.array([end_count if h == START else known_counts.get(int(h), 0) for h in frequent], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = TaskContext.get().partitionId() << 40
        for number, ids, train, tokens in blocks(batches, block):
            order = np.lexsort((tokens.word, tokens.history, tokens.row))
            row, history, word = tokens.row[order], tokens.history[order], tokens.word[order]
            heads = heads_of(row, history, word)
            times = np.diff(np.append(heads, len(order)))
            row, history, word = row[heads], history[heads], word[heads]
            bucket = bucket_of(history, word, frequent, buckets)
            order = np.argsort(bucket, kind="stable")
            rows = []
            for a, b in runs(bucket[order]):
                own = order[a:b]
                texts = np.unique(row[own])
                blob = squeeze_texts(home + number[texts], [ids[t] for t in texts.tolist()], train[texts], history[own], word[own], np.searchsorted(texts, row[own]), times[own])
                rows.append((int(bucket[own[0]]), blob))
            del tokens, row, history, word, bucket, times, order
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    first_ddl = "kind int, part int, blob binary, sums array<double>"

    def evaluate(key, texts: pa.Table, tables: pa.Table) -> pa.Table:
        names, counts = [], []
        for blob in tables.column("blob").to_pylist():
            raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
            name, at = read_hashes(raw, 0)
            names.append(name)
            counts.append(unpack(raw[at:], 1)[0][0])
        names, counts = np.concatenate(names), np.concatenate(counts)
        order = np.argsort(names)
        names, chance = names[order], single.probability(counts[order])
        found = []
        for blob in texts.column("blob").to_pylist():
            rows, ids, train, (h, hi), (w, wi), row, times = read_texts(blob)
            found.append((rows, ids, train, h, hi.astype(np.int32), np.searchsorted(names, w)[wi].astype(np.int32), row.astype(np.int32), times.astype(np.int32)))
        own = np.unique(np.concatenate([f[3] for f in found]))
        sizes = [len(f[0]) for f in found]
        base_row = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        rows, ids, train = (np.concatenate([f[k] for f in found]) for k in range(3))
        hi = np.concatenate([np.searchsorted(own, f[3])[f[4]] for f in found])
        wi = np.concatenate([f[5] for f in found])
        row = np.concatenate([f[6] + b for f, b in zip(found, base_row, strict=True)])
        times = np.concatenate([f[7] for f in found])
        del found
        pairs, pair = np.unique(hi * len(names) + wi, return_inverse=True)
        count = np.bincount(pair, times * train[row], len(pairs)).astype(np.int64)
        of, behind_pair = pairs // len(names), chance[pairs % len(names)]
        seen = count > 0
        low = np.minimum(count, KEPT + 1)
        # Per history: counts of counts of its pairs, all of its occurrences, what the unigrams give to its pairs.
        shape = np.bincount((of * (KEPT + 2) + low)[seen], minlength=len(own) * (KEPT + 2)).reshape(-1, KEPT + 2)[:, 1:]
        total = np.bincount(of, count, len(own))
        behind = np.bincount(of[seen], behind_pair[seen], len(own))
        place = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        common = frequent[place] == own
        total = np.where(common, frequent_count[place], total)
        with np.errstate(divide="ignore", invalid="ignore"):
            fixed = np.where(count > KEPT, count - LEAST, count) / total[of]
            back = np.where((total > 0) & ~common, 1 / (total * np.maximum(1 - behind, 1e-300)), 1.0)
            logs = np.log10(np.where(seen, fixed, back[of] * behind_pair))
            base = np.log10((total + 1) / (single.total + single.distinct + 1))
        word_token = own[hi] != START
        n = len(rows)
        add = lambda x: np.bincount(row, x, n)
        columns = [rows, ids, train, *(add(times * x).astype(np.int64) for x in (word_token, word_token & (total[hi] > 0), *((low[pair] == r) for r in range(1, KEPT + 1))))]
        reals = [add(logs[pair] * times), add(np.where(word_token, base[hi] * times, 0.0))]
        out = []
        part = rows % parts
        order = np.lexsort((rows, part))
        for a, b in runs(part[order]):
            own_rows = order[a:b]
            with np.errstate(over="ignore"):
                blob = squeeze(pack(np.diff(rows[own_rows], prepend=0), np.diff(ids[own_rows], prepend=0), *(c[own_rows] for c in columns[2:])), *(c[own_rows].tobytes() for c in reals))
            out.append((SUMS, int(part[own_rows[0]]), blob, None))
        # Backoff weights that wait for the discounts: by shape of the history, or by number for a frequent one.
        wait = np.flatnonzero(~seen[pair] & (total[hi] > 0))
        shapes, kind = np.unique(shape, axis=0, return_inverse=True)
        what = np.where(common[hi[wait]], len(shapes) + place[hi[wait]], kind.reshape(-1)[hi[wait]])
        order = np.lexsort((what, row[wait], part[row[wait]]))
        wait, what = wait[order], what[order]
        for a, b in runs(part[row[wait]]):
            here = wait[a:b]
            used, index = np.unique(what[a:b], return_inverse=True)
            local = used < len(shapes)
            table = np.where(local[:, None], shapes[np.minimum(used, len(shapes) - 1)], -1)
            table[~local, 0] = -1 - (used[~local] - len(shapes))
            out.append((LATER, int(part[row[here[0]]]), squeeze(pack(np.diff(rows[row[here]], prepend=0), index, times[here]), pack(*table.T)), None))
        for k in np.flatnonzero(common).tolist():
            out.append((COMMON, int(place[k]), None, [*shape[k].astype(float).tolist(), float(behind[k])]))
        out.append((TIMES, 0, None, np.bincount(np.minimum(count, KEPT + 2), minlength=KEPT + 3)[1:KEPT + 2].astype(float).tolist() + [0.0]))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "part", "blob", "sums"])

    dealt = docs.mapInArrow(deal, "bucket int, blob binary")
    replies = answers.filter("bucket IS NOT NULL").select(F.col("bucket").alias("home"), "blob")
    first = cut(dealt.groupBy("bucket").cogroup(replies.groupBy("home")).applyInArrow(evaluate, first_ddl))
    # Figures over all buckets: 4 * buckets + 2 rows at most.
    whole = {(x.kind, x.part): np.array(x[2:], float) for x in first.filter(F.col("kind").isin(COMMON, TIMES)).groupBy("kind", "part").agg(*[F.sum(F.col("sums")[k]) for k in range(KEPT + 2)]).collect()}
    factors = discounts(np.concatenate([[0], whole.get((TIMES, 0), np.zeros(KEPT + 2))[:KEPT + 1]]))
    weights = np.zeros(len(frequent))
    for k in range(len(frequent)):
        if frequent_count[k] and (COMMON, k) in whole:
            x = whole[COMMON, k]
            weights[k] = np.log10(freed(x[:KEPT + 1], factors) / frequent_count[k] / max(1 - x[KEPT + 1], 1e-300))

    names = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(key, table):
        sums, late = [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
            if kind == SUMS:
                columns, at = unpack(raw, 5 + KEPT)
                sums.append((np.cumsum(columns[0]), np.cumsum(columns[1]), *columns[2:], *np.frombuffer(raw, np.float64, offset=at).reshape(2, -1)))
            else:
                (steps, index, times), at = unpack(raw, 3)
                shape = np.array(unpack(raw[at:], KEPT + 1)[0]).T
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.where(shape[:, 0] < 0, weights[np.maximum(-1 - shape[:, 0], 0)], np.log10(freed(shape, factors)))
                late.append((np.cumsum(steps), value[index] * times))
        rows, ids, train, n, known, *rest = (np.concatenate(c) for c in zip(*sums, strict=True))
        low, (score, base) = rest[:KEPT], rest[KEPT:]
        row, first_at, index = np.unique(rows, return_index=True, return_inverse=True)
        add = lambda x: np.bincount(index, x, len(row))
        score = add(score) + sum(add(c) * np.log10(factors[r + 1]) for r, c in enumerate(low))
        for at, value in late:
            score += np.bincount(np.searchsorted(row, at), value, len(row))
        end = np.log10((end_count + 1) / (single.total + single.distinct + 1))
        return pa.Table.from_arrays([
            pa.array(ids[first_at], mask=ids[first_at] == NO_ID), pa.array(train[first_at] == 0), pa.array(add(n).astype(np.int64) + 1), pa.array(add(known).astype(np.int64) + int(end_count > 0)),
            pa.array(np.full(len(row), single.total, np.int64)), pa.array(add(base) + end), pa.array(score)], schema=names)

    return first.filter(F.col("kind").isin(SUMS, LATER)).select("kind", "part", "blob").groupBy("part").applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def squeeze_texts(rows: np.ndarray, ids: list, train: np.ndarray, history: np.ndarray, word: np.ndarray, row: np.ndarray, times: np.ndarray) -> bytes:
    """Texts of a block that have pairs in a bucket, and those pairs in order of the texts."""
    numbers = np.array([NO_ID if i is None else i for i in ids], np.int64)
    h, hi = names_of(history)
    w, wi = names_of(word)
    with np.errstate(over="ignore"):
        steps = np.diff(numbers, prepend=0)
    return squeeze(hashes(h), hashes(w), pack(np.diff(rows, prepend=0), steps, train.astype(np.int64)), pack(np.diff(row, prepend=0), hi, wi, times))


def read_texts(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    h, at = read_hashes(raw, 0)
    w, at = read_hashes(raw, at)
    (rows, ids, train), used = unpack(raw[at:], 3)
    (row, hi, wi, times), _ = unpack(raw[at + used:], 4)
    with np.errstate(over="ignore"):
        return np.cumsum(rows), np.cumsum(ids), train, (h, hi), (w, wi), np.cumsum(row), times
