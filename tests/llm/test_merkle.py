"""Merkle manifest by butterfly exchange against trees hashed plainly."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from boxloom.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    n_chars = n_chars + more if n_chars is not None else None
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes, fanout):
    """Root, and for each leaf the steps (texts in front and behind)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            low = i // fanout * fanout
            run = nodes[low:low + fanout]
            steps[k].append(("".join(run[:i - low]), "".join(run[i - low + 1:])))
        nodes = [H(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], steps


def plain(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found, subroots = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, steps = climb([leaf_of(r) for r in own], fanout)
        subroots.append(root)
        found.append((own, steps))
    root, tops = climb(subroots, fanout)
    out = []
    for (own, steps), subroot, top in zip(found, subroots, tops):
        for r, s in zip(own, steps):
            path = s + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf_of(r, 1 if tampered else 0)
            for front, behind in path:
                acc = H(front, acc, behind)
            out.append((r[0], leaf_of(r), subroot, root, H(*[f + b for f, b in path]), acc, acc == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string, root int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("fanout,block,n", [(2, 4, 150), (2, 4096, 60), (3, 9, 200), (4, 4, 120), (2, 2, 33)])
def test_against_plain(spark, fanout, block, n):
    r = random.Random(n)
    langs = ["en", "en", "en", "en", "de", None, "", "ü", "z"]
    rows = [(i, r.choice(["a", None, ""]), r.choice(langs), r.choice([None, 5, 2**40]), r.choice([None, "", "text", "é" * 9, "1:2", "-"])) for i in r.sample(range(-5, 10**6), n)]
    rows += [(None, "a", "en", 1, "t"), (None, None, None, None, None), (77, "a", "en", 1, "t"), (77, "a", "en", 2, "t"), (7, "s", "en", 3, "long " * 200_000)]
    rows += [(99, "a", "de", 1, "same")] * 3
    got = M.verify(M.merkle_manifest(frame(spark, rows), fanout, block, M.every_seventh())).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, fanout)
    assert {x.verified for x in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 16, 17])
def test_sizes_around_a_block(spark, n):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    assert sorted(map(tuple, M.verify(M.merkle_manifest(frame(spark, rows), 2, 4, M.every_seventh())).collect()), key=str) == plain(rows, 2)


def test_empty(spark):
    assert M.verify(M.merkle_manifest(frame(spark, []))).collect() == []


def test_proofs_hold_for_their_leaf_only(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", i, f"text {i}") for i in range(40)]
    m = M.merkle_manifest(frame(spark, rows), block=8)
    assert m.filter(M.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert m.filter(M.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0
    assert m.select("root").distinct().count() == 1
