"""Embedding links, counts and components against all pairs."""

import math

import numpy as np
import pytest

from boxloom.llm.embeddings import embedding_dedup


def plain(rows, limit=0.93):
    def good(e, label, i):
        return i is not None and label is not None and e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e) and any(e)

    n = len(rows)
    unit = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if good(e, g, i) else None for i, e, g in rows]
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= limit] for i in range(n)]
    label = list(range(n))
    for start in range(n):
        stack = [start]
        while stack:
            a = stack.pop()
            for b in link[a]:
                if label[b] != label[start] and label[b] == b and b != start:
                    label[b] = label[start]
                    stack.append(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        own = [rows[j][0] for j in range(n) if label[j] == label[k] and rows[j][0] is not None]
        least = min(own) if own and link[k] else i
        out.append((i, len(link[k]), least, least == i))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell,block", [(4096, 2048), (20, 7)])
def test_against_all_pairs(spark, cell, block):
    r = np.random.default_rng(3)
    rows = []
    for group in range(12):
        middle = r.normal(size=8)
        for _ in range(int(r.integers(1, 14))):
            rows.append([len(rows) + 10, (middle + r.normal(size=8) * 0.25).astype(np.float32).tolist(), int(group % 3)])
    for k in range(40):
        rows.append([500 + k, rows[0][1], rows[0][2]])
    rows += [[1, None, 0], [2, [], 0], [3, [0.0] * 8, 0], [4, [math.nan] + [1.0] * 7, 0], [5, [None] + [1.0] * 7, 0], [6, [math.inf] + [1.0] * 7, 0], [7, rows[0][1], None], [None, rows[0][1], rows[0][2]],
             [8, [1.0, 0.0], 0], [9, [1.0, 0.1], 0], [800, [x * 1e30 for x in rows[0][1]], rows[0][2]]]
    df = spark.createDataFrame([(*x, "n", True) for x in rows], "vec_id long, embedding array<float>, label int, cid string, kept boolean").repartition(4)
    got = embedding_dedup(df, cell=cell, block=block).collect()
    exact = [[i, None if e is None else [None if v is None else float(np.float32(v)) for v in e], g] for i, e, g in rows]
    assert sorted(map(tuple, got), key=str) == plain(exact)


def test_empty(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_one_id_with_two_vectors(spark):
    """Rows are told apart by their vectors, not by their ids: both rows of the id link with each other."""
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (2, [0.0, 1.0], 0)]
    got = sorted(tuple(x) for x in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
