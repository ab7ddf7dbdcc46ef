"""Suffix arrays, common prefixes and removed passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from boxloom.llm import suffix_dedup as sd


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    r = random.Random(seed)
    text = bytes(r.choice(b"ab" if seed % 2 else bytes(range(200))) for _ in range(700)) * 2
    data = np.frombuffer(text, np.uint8)
    order = sd.suffix_array(data.astype(np.int16) + 1, 50)
    shared = sd.common_prefixes(data, order, 50, strip=32)
    tails = [text[i:i + 50] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(text)))
    assert tails == sorted(tails)
    for k in range(1, len(tails)):
        want = next((i for i, (a, b) in enumerate(zip(tails[k - 1], tails[k])) if a != b), min(len(tails[k - 1]), len(tails[k])))
        if want < 50 and min(len(tails[k - 1]), len(tails[k])) == 50:
            assert shared[k] == want
        elif want >= 50:
            assert shared[k] >= 50


def brute(rows, passage):
    first = {}
    for doc_id, text in rows:
        body = (text or "").encode()
        if doc_id is not None:
            for i in range(len(body) - passage + 1):
                s = body[i:i + passage]
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        body = (text or "").encode()
        gone = [False] * len(body)
        for i in range(len(body) - passage + 1):
            if doc_id is not None and first[body[i:i + passage]] < doc_id:
                gone[i:i + passage] = [True] * passage
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(body, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "été", "stone", "\x00", "river", "a", "漢字"])
    prose = lambda n: " ".join(word() + str(r.randint(0, 30)) for _ in range(n))
    shared = [prose(30) for _ in range(6)]
    rows = [(i, prose(r.randint(0, 40)) + r.choice(["", *shared]) + prose(r.randint(0, 30)) + r.choice(["", *shared])) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(8)] + [(600, "ab" * 3000), (601, "ab" * 40), (602, None), (603, ""), (None, rows[3][1]), (604, "x" * 49), (605, prose(2000)), (606, "é" * 30)]
    rows += [(7, rows[7][1]), (7, "other " + rows[3][1]), (-4, rows[9][1])]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, tag int, body string").repartition(5)
    for shard in (sd.SHARD, 900):
        got = sd.suffix_dedup(df, shard=shard, bucket_bytes=3000, part_bytes=2000)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.suffix_dedup(df).collect() == []


def test_keys_that_collide(monkeypatch):
    """Different passages under one key are told apart by their bytes."""
    monkeypatch.setattr(sd, "powers", lambda n: (np.ones(n, np.uint64), np.ones(n, np.uint64)))
    out = sd.Stretches(1, 1, 50)
    base = bytes(range(60, 110))
    out.shard([(1, 0, 0, np.frombuffer(base, np.uint8))])
    blobs = [b for kind, _, b in out.rows() if kind == sd.TEXTS]
    for doc_id, body in ((2, base[::-1]), (3, base), (4, base[::-1])):
        out.shard([(doc_id, 0, 0, np.frombuffer(body, np.uint8))])
        blobs += [b for kind, _, b in out.rows() if kind == sd.TEXTS]
    assert sd.across_shards(blobs, 50)[0].tolist() == [3, 4]
