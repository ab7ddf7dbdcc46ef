"""Katz scores against a plain dictionary version, and distributions that sum to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from boxloom.llm import katz


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def factors_of(counts):
    times = Counter(counts)
    spare = 6 * times[6] / times[1] if times[1] else 1.0
    out = {}
    for r in range(1, 6):
        v = ((r + 1) * times[r + 1] / (r * times[r]) - spare) / (1 - spare) if times[r] and spare < 1 else 0
        out[r] = v if 0 < v < 1 else 1 - 0.5 / r
    return out


def taken(c, d):
    return c * d[c] if c <= 5 else c - 0.01


class Plain:
    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for words in texts:
            line = ["<s>", *words, "</s>"]
            self.one.update(line[1:])
            for a, b in zip(line, line[1:]):
                self.two[a][b] += 1
        self.total = sum(self.one.values())
        d = factors_of(self.one.values())
        kept = {w: taken(c, d) for w, c in self.one.items()}
        self.left = (self.total - sum(kept.values())) / self.total if self.total else 1.0
        self.p = {w: k / self.total for w, k in kept.items()}
        self.d2 = factors_of([c for x in self.two.values() for c in x.values()])

    def single(self, w):
        return self.p.get(w, self.left)

    def pair(self, h, w):
        seen = self.two.get(h)
        if not seen:
            return self.single(w)
        total = sum(seen.values())
        if w in seen:
            return taken(seen[w], self.d2) / total
        kept = sum(taken(c, self.d2) for c in seen.values())
        return (total - kept) / total / (1 - sum(self.single(x) for x in seen)) * self.single(w)

    def score(self, words):
        line = ["<s>", *words, "</s>"]
        return sum(math.log10(self.pair(a, b)) for a, b in zip(line, line[1:]))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def rows():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "The", "x" * 300]
    out = [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=r.randint(0, 60)))) for i in range(150)]
    return out + [(None, "w1 w2 w3"), (900, None), (901, ""), (902, " \n\t"), (903, "never seen before"), (3, out[3][1]), (904, " ".join(f"w{i % 50}" for i in range(20000)))]


@pytest.mark.parametrize("block,bucket", [(1 << 20, 1 << 20), (700, 2000)])
def test_against_plain(spark, block, bucket):
    data = rows()
    df = spark.createDataFrame([(i, t, "a", False) for i, t in data], "doc_id long, text string, word string, train boolean").repartition(4)
    got = sorted(map(tuple, katz.katz_scores(df, bucket_bytes=bucket, part_bytes=3000, block=block).collect()), key=str)
    train = [words_of(t) for i, t in data if not held(i)]
    model = Plain(train)
    counts, n, v = model.one, model.total, len(model.one)
    want = []
    for i, t in data:
        tokens = [*words_of(t), "</s>"]
        want.append((i, held(i), len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), model.score(tokens[:-1])))
    assert any(x[1] for x in want)
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)
    for h in ["<s>", *list(counts)[:40], "unheard"]:
        if h != "</s>":
            assert sum(model.pair(h, w) for w in counts) + model.pair(h, "<unknown>") == pytest.approx(1, abs=1e-9)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.katz_scores(empty).collect() == []
    alone = next(i for i in range(100) if held(i))
    got = katz.katz_scores(spark.createDataFrame([(alone, "some text")], "doc_id long, text string")).collect()
    assert [tuple(x) for x in got] == [(alone, True, 3, 0, 0, 0.0, 0.0)]


def test_discounts_stay_in_range():
    for times in ([0, 5, 3, 2, 1, 1, 1], [0, 0, 0, 0, 0, 0, 0], [0, 1, 9, 9, 9, 9, 9]):
        d = katz.discounts(np.array(times, float))
        assert ((d[1:] > 0) & (d[1:] < 1)).all()
