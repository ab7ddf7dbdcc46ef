import numpy as np
from pyspark.sql import functions as F

from boxloom.ml import nearest as NN

SCHEMA = "label int, vec_id bigint, embedding array<double>"


def brute(rows, k):
    want = {}
    for label, vid, vec in rows:
        own = sorted((float(np.sqrt(((np.array(vec) - np.array(o)) ** 2).sum())), oid) for ol, oid, o in rows if ol == label and oid != vid)[:k]
        want[vid] = [(round(d, 9), o) for d, o in own]
    return {v: w for v, w in want.items() if w}


def found(spark, rows, k, pivots):
    got = {}
    for r in NN.neighbours(spark.createDataFrame(rows, SCHEMA), k, pivots).collect():
        got.setdefault(r.vec_id, []).append((r.nth, round(r.distance, 9), r.other))
    return {v: [(d, o) for _, d, o in sorted(rows)] for v, rows in got.items()}


def test_cells_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(c, c * 1000 + i, [float(v) for v in rng.integers(0, 5, size=3)]) for c, n in ((0, 90), (1, 12), (2, 1)) for i in range(n)]
    rows += [(0, 900 + i, [1.0, 1.0, 1.0]) for i in range(40)]
    for pivots in (1, 9, 64):
        assert found(spark, rows, 4, pivots) == brute(rows, 4)


def test_blocks_inside_a_cell(spark, monkeypatch):
    monkeypatch.setattr(NN, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(7, i, [float(v) for v in rng.normal(size=4)]) for i in range(120)]
    assert found(spark, rows, 5, 3) == brute(rows, 5)


def test_null_and_repeated_rows(spark):
    rows = [(1, 1, [0.0, 1.0]), (1, 1, [0.0, 1.0]), (1, 2, [0.0, 2.0]), (1, 3, None), (None, 4, [0.0, 1.0])]
    assert found(spark, rows, 5, 4) == {1: [(1.0, 2)], 2: [(1.0, 1)]}


def test_comparisons_grow_slower_than_pairs(spark):
    rng = np.random.default_rng(1)
    work = {}
    for n in (1000, 4000):
        centers = rng.uniform(0, 1000, size=(n // 20, 3))
        rows = [(0, i, [float(v) for v in centers[i % len(centers)] + rng.normal(size=3)]) for i in range(n)]
        _, home, far, _ = NN.steps(spark.createDataFrame(rows, SCHEMA), 5, int(n ** 0.5) * 2)
        work[n] = home.unionByName(far).agg(F.sum(F.size("left") * F.size("right").cast("long"))).first()[0]
    assert work[4000] < 0.1 * 4000 ** 2
    assert work[4000] < 8 * work[1000]


def test_visitors_come_in_bounded_pieces(spark, monkeypatch):
    """What a task sends at once grows neither with the batch nor with the cells met."""
    monkeypatch.setattr(NN, "PIECE", 16, raising=False)
    rng = np.random.default_rng(8)
    rows = [(c, c * 1000 + i, [float(v) for v in rng.normal(size=24)]) for c in (0, 1) for i in range(300)]
    _, _, far, _ = NN.steps(spark.createDataFrame(rows, SCHEMA).coalesce(1), 5, 6)
    assert far.agg(F.max(F.size("left"))).first()[0] <= 16
    assert found(spark, rows, 5, 6) == brute(rows, 5)
