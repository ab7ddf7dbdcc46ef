"""Prefix trie by range minima against a trie built plainly."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from boxloom.llm import prefix_trie as P


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain(rows):
    nodes = {}
    seqs = rebuilt(rows)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        sub = [k for k in nodes if k[:len(key)] == key]
        kids = lambda k: [x for x in nodes if len(x) == len(k) + 1 and x[:len(k)] == k]
        words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        ends = sorted(c for c in members if len(seqs[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids(key)), sum(not kids(k) for k in sub),
                    sum((len(nodes[k]) - 1) * words(k) for k in sub), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, key binary, shard int").repartition(4)


def same_turns(rows):
    """Turns of one number in one conversation must not differ: their order is by digest."""
    return len({(c, t) for c, t, *_ in rows}) == len({tuple(r) for r in rows})


def some(seed, n, ids):
    r = random.Random(seed)
    texts = ["a", "b c", "", None, "d e f", "g\th"]
    out = []
    for c in r.sample(range(ids), n):
        for t in range(r.choice([1, 2, 3, 3, 4, 6])):
            out.append((c, t if t or r.random() < 0.9 else None, r.choice(["user", "user", None]), r.choice(texts)))
    return out


@pytest.mark.parametrize("seed,n,ids,shard", [(1, 40, 60, 1000), (2, 120, 150, 7), (3, 60, 4000, 3), (4, 30, 31, 1), (5, 1, 2, 5)])
def test_against_plain(spark, seed, n, ids, shard):
    rows = some(seed, n, ids)
    rows += [(None, 0, "user", "lost"), (9000, 0, None, None)]
    rows += [(c, t, "user", f"copy {t}") for c in range(5000, 5030) for t in range(5)]  # copies
    rows += [(6001, t, "user", f"long {t}") for t in range(300)] + [(6002, t, "user", f"long {t}") for t in range(200)]
    assert same_turns([x for x in rows if x[0] is not None])
    got = P.prefix_trie(frame(spark, rows), shard).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_very_long_text_and_repeated_rows(spark):
    rows = [(20, 0, "user", "word " * 300_000), (21, 0, "user", "x"), (20, 1, "user", "y"), (40, 0, "u", "t"), (40, 0, "u", "t")]
    assert sorted(map(tuple, P.prefix_trie(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_turnless_and_empty(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]  # no base, and the only turn is among the first three
    got = [tuple(x) for x in P.prefix_trie(frame(spark, rows)).collect()]
    assert got == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert P.prefix_trie(frame(spark, [])).collect() == []


def test_lists_of_ids_are_chained(spark, monkeypatch):
    monkeypatch.setattr(P, "LIST", 7)
    pairs = spark.createDataFrame([(b"k", i) for i in range(100)] + [(b"m", 5), (b"", -3)], "key binary, conv_id long")
    got = {bytes(x.key): (x.n, x.least, x.ends_sha256) for x in P.end_digests(pairs).collect()}
    h = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {b"k": (100, 0, h(range(100))), b"m": (1, 5, h([5])), b"": (1, -3, h([-3]))}


def test_extents():
    r = np.random.default_rng(1)
    values = r.integers(0, 5, 60)
    table = P.RangeMinimum(values)
    for at in range(60):
        for bound in range(6):
            high = at
            while high + 1 < 60 and values[high + 1] >= bound:
                high += 1
            low = at
            while low - 1 >= 0 and values[low] >= bound:
                low -= 1
            assert table.right(np.array([at]), np.array([bound]))[0] == high
            assert table.left(np.array([at]), np.array([bound]))[0] == low
