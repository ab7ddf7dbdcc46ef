"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Every text gives a row of counts (letters, symbols, words, repeats, lines), turned into logarithms of shares. Each class
has a mean and a covariance that is shrunk towards the pooled covariance and its diagonal. The score is the logistic
function of the difference of the two log-densities, computed with cached inverse Cholesky factors. Counting runs over
Arrow batches in blocks of bounded size; a long text is counted block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, narrow, released, whole_text

BLOCK = 1 << 19  # bytes counted at a time
FIT_ROWS = 20_000  # labelled rows the classifier learns from at most, half of them per class
CLASSES = {"space": b" \t\n\r\x0b\x0c", "digit": b"0123456789", "shout": b"!?", "symbol": b"#$%&*+<=>@\\^_`{|}~/[]", "stop": b".,;:'\"()-", "line": b"\n"}
STRETCH = 1 << 18  # bytes hashed at a time
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if not _powers or len(_powers["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", INVERSE)):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span ``data[start:end]`` (rising, apart), a stretch of the data at a time."""
    if len(data) > 2 * STRETCH and len(start) > 1:
        cuts = np.unique(np.concatenate([np.searchsorted(start, np.arange(0, len(data), STRETCH)), [len(start)]]))
        return np.concatenate([span_hashes(data[start[a]:end[b - 1]], start[a:b] - start[a], end[a:b] - start[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    out = (sums[end] - sums[start]) * down[start]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


_KINDS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in CLASSES.items()}
_KINDS["upper"] = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_KINDS["char"] = (np.arange(256) & 0xC0) != 0x80
_KINDS["wide"] = np.arange(256) >= 0xC0
COUNTS = [*_KINDS, "words", "upper_words", "repeat", "long_words", "marked_words", "distinct"]


def count_block(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text (texts end at ``cuts[1:]``), and the distinct words as (text, hash) arrays."""
    n = len(cuts) - 1
    out = np.zeros((n, len(COUNTS)))
    at = np.minimum(cuts[:-1], max(len(data) - 1, 0))
    empty = cuts[1:] == cuts[:-1]
    if not len(data):
        return out, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for k, name in enumerate(_KINDS):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_KINDS[name][data], out=sums[1:])
        out[:, k] = sums[cuts[1:]] - sums[cuts[:-1]]
        if name == "upper":
            upper = sums
        elif name == "symbol":
            marks = sums
        elif name == "shout":
            shouts = sums
    word = ~_KINDS["space"][data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[at[~empty]] = word[at[~empty]]
    start = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    text = np.searchsorted(cuts, start, "right") - 1
    names = span_hashes(data, start, end)
    size = end - start
    per_text = lambda flags: np.bincount(text, flags, n)
    base = len(_KINDS)
    out[:, base] = per_text(np.ones(len(text)))
    out[:, base + 1] = per_text((upper[end] - upper[start]) * 2 > size)
    same = np.zeros(len(text))
    same[1:] = (names[1:] == names[:-1]) & (text[1:] == text[:-1])
    out[:, base + 2] = per_text(same)
    out[:, base + 3] = per_text(size > 20)
    out[:, base + 4] = per_text((marks[end] - marks[start]) + (shouts[end] - shouts[start]) > 0)
    order = np.lexsort((names, text))
    text, names = text[order], names[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (names[1:] != names[:-1])
    return out, text[new], names[new]


def count_texts(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Counts of every text in one Arrow buffer, in blocks of some ``block`` bytes; longer texts are cut at white space."""
    total = np.zeros((len(offsets) - 1, len(COUNTS)))
    row = 0
    while row < len(total):
        stop = max(int(np.searchsorted(offsets, offsets[row] + block, "right")) - 1, row)
        if stop > row:
            cuts = offsets[row:stop + 1] - offsets[row]
            counts, text, _ = count_block(data[offsets[row]:offsets[stop]], cuts)
            counts[:, -1] = np.bincount(text, minlength=len(counts))
            total[row:stop] = counts
            row = stop
            continue
        at, end, words = int(offsets[row]), int(offsets[row + 1]), []
        while at < end:
            cut = min(at + block, end)
            if cut < end:
                spaces = np.flatnonzero(_KINDS["space"][data[at:cut]])
                cut = at + int(spaces[-1]) + 1 if len(spaces) else cut
            counts, _, names = count_block(data[at:cut], np.array([0, cut - at]))
            total[row] += counts[0]
            words = [np.union1d(words[0], names)] if words else [names]
            at = cut
        total[row, -1] = len(words[0])
        row += 1
    return total


SHARES = [("upper", "char"), ("digit", "char"), ("shout", "char"), ("symbol", "char"), ("stop", "char"), ("line", "char"), ("wide", "char"), ("char", "words"),
          ("upper_words", "words"), ("repeat", "words"), ("long_words", "words"), ("marked_words", "words"), ("distinct", "words")]
PRIOR = {"char": 60.0, "words": 10.0}  # a short text is taken to go on like the usual good text for so many characters or words


def usual_rates(counts: np.ndarray) -> np.ndarray:
    """Overall shares, the starting point for short texts."""
    c = {name: counts[:, k].sum() for k, name in enumerate(COUNTS)}
    return np.array([(c[a] + 1e-3) / (c[b] + 1.0) for a, b in SHARES])


def statistics(counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Logarithms of shares and of the length, near to normal within a class."""
    c = {name: counts[:, k] for k, name in enumerate(COUNTS)}
    shares = [np.log((c[a] + max(rate * PRIOR[b], 0.05)) / (c[b] + PRIOR[b])) for (a, b), rate in zip(SHARES, rates, strict=True)]
    return np.stack([np.log(c["words"] + PRIOR["words"]), *shares], 1)


@dataclass
class Discriminant:
    """Per class: log prior minus half the log determinant, mean, inverse Cholesky factor."""

    rates: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    parts: list[tuple[float, np.ndarray, np.ndarray]]
    constant: float | None = None

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        x = statistics(counts, self.rates)
        z = np.clip((x - self.middle) / self.scale, -30, 30)
        logs = [c - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for c, mean, inverse in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(counts: np.ndarray, y: np.ndarray, shrink: float = 0.1, ridge: float = 0.05, shares: tuple[float, float] | None = None) -> Discriminant:
    """Class covariances shrunk by ``shrink`` to the pooled covariance, with ``ridge`` of its mean variance on the diagonal.

    ``shares`` are the shares of the labels 0 and 1 among all training rows, where the rows given are a sample with others.
    Without rows of both classes the score is the share of label 1, and 1 where there is no label at all.
    """
    if len(y) and shares is None:
        shares = (float((y == 0).mean()), float((y == 1).mean()))
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(np.zeros(0), np.zeros(0), np.ones(0), [], shares[1] if len(y) else 1.0)
    rates = usual_rates(counts[y == 1])
    x = statistics(counts, rates)
    d = x.shape[1]
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())  # rows count as in the whole table
    middle = weight @ x
    scale = np.sqrt(weight @ (x - middle) ** 2) + 1e-6
    z = np.clip((x - middle) / scale, -30, 30)
    each = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(s * shares[k] for k, s in enumerate(each))
    parts = []
    for k, own in enumerate(each):
        s = (1 - shrink) * own + shrink * pooled + ridge * np.trace(pooled) / d * np.eye(d)
        factor = np.linalg.cholesky(s)
        parts.append((float(np.log(shares[k]) - np.log(np.diag(factor)).sum()), z[y == k].mean(0), np.linalg.inv(factor)))
    return Discriminant(rates, middle, scale, parts)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary column without nulls."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8), offsets


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        data, offsets = _bytes_of(batch.column(batch.schema.get_field_index("body")))
        yield batch, count_texts(data, offsets)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          fit_rows: int = FIT_ROWS) -> Discriminant:
    """Learn from at most ``fit_rows`` rows with a 0/1 label whose crc32(id) mod 4 is not 2, chosen by a hash of the id.

    The sample gives the mean and covariance of each class. How the classes share the rows is counted over all labelled
    training rows, so a bounded sample has no effect on the prior; counts and the sample's statistics reach the driver.
    """
    known = narrow(labels, id=id_col, label=label_col).filter(F.col("label").isin(0, 1) & (crc_mod("id", 4) != 2)).distinct()
    halves = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(fit_rows // 2) for k in (0, 1)]
    sample = F.broadcast(halves[0].unionByName(halves[1]))  # fit_rows ids at most
    texts = narrow(docs, id=id_col, text=text_col).join(sample, "id").select("label", whole_text().cast("binary").alias("body"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in counted(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    got = texts.mapInArrow(released(rows), "label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(COUNTS))
    order = np.lexsort(x.T[::-1]) if len(got) else np.zeros(0, int)
    size = {r["label"]: r["n"] for r in narrow(docs, id=id_col).join(known, "id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    return fit(x[order], got["label"].to_numpy(int)[order], shares=(size.get(0, 0) / total, size.get(1, 0) / total) if total else None)


def quality_scores(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``, from the text alone.

    Null and empty texts are scored like any other (all counts zero). ``held_out`` is false for a null id. Repeated rows
    get equal scores. An empty table gives no rows.
    """
    body = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False)).alias("held_out"), whole_text(text_col).cast("binary").alias("body"))
    known = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in counted(batches):
            score = known.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(body.dtypes)["doc_id"]
    return body.mapInArrow(released(rows), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the classifier does not reject; one pass, nothing is joined."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in counted(batches):
            yield batch.drop_columns(["body"]).filter(pa.array(model.value.score(x) >= threshold))

    given = docs.select(*columns, whole_text(text_col).cast("binary").alias("body"))
    return given.mapInArrow(released(rows), given.drop("body").schema).toDF(*docs.columns)
