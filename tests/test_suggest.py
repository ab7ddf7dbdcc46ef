"""Suggested templates against a comparison of all signatures."""

import random

import pytest

from boxloom.operators import templates as TP

PAGES, KNOWN = "doc_id bigint, page_number int, signature string", "signature string, vendor bigint, samples bigint"


def signature(r, n):
    return "|".join(f"{i}:{r.choice('aaabbc')}" for i in range(n))


def wanted(pages, known, above=0.6, top=5):
    out = set()
    for d, p, s in pages:
        mine = s.split("|")
        shared = [(sum(a == b for a, b in zip(mine, t.split("|"))) / len(mine), t, v, m) for t, v, m in known if len(t.split("|")) == len(mine)]
        best = sorted((x for x in shared if x[0] > above), key=lambda x: (-x[0], x[1]))[:top]
        out |= {(d, p, t, v, m, a, i + 1) for i, (a, t, v, m) in enumerate(best)}
    return out


def some(seed, sizes):
    r = random.Random(seed)
    pages = [(i, 1, signature(r, r.choice(sizes))) for i in range(60)]
    known = [(s, i, i + 2) for i, s in enumerate(sorted({signature(r, r.choice(sizes)) for _ in range(150)} | {x[2] for x in pages[:20]}))]
    return pages, known


def got(df):
    return {(r.doc_id, r.page_number, r.template, r.vendor, r.samples, r.similarity, r.rank) for r in df.collect()}


@pytest.mark.parametrize("seed,sizes,top", [(1, [1, 2, 3, 5, 10], 5), (2, [6, 8], 2), (3, [4, 14], 3)])
def test_suggest(spark, seed, sizes, top):
    pages, known = some(seed, sizes)
    df = TP.suggest(spark.createDataFrame(pages, PAGES), spark.createDataFrame(known, KNOWN), top=top)
    assert got(df) == wanted(pages, known, top=top)


def test_short_signatures_meet_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(TP, "_alike_by_rare_parts", lambda *a: (_ for _ in ()).throw(AssertionError("pairs by parts")))
    pages, known = some(4, [10])
    assert got(TP.suggest(spark.createDataFrame(pages, PAGES), spark.createDataFrame(known, KNOWN))) == wanted(pages, known)
    assert TP.suggest(spark.createDataFrame([], PAGES), spark.createDataFrame(known, KNOWN)).collect() == []
