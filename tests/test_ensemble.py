"""Posterior label probabilities and the combined predictor."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from boxloom.ml import ensemble as EN, features as FE, train as TR
from boxloom.ml.marginals import sequence_probabilities
from boxloom.plans import workflows as WF

SCHEMA = "doc_id bigint, page_number int, entity_seq bigint, label string, text string, x bigint, y bigint, width bigint, height bigint"


def some(seed, pages, n):
    r = random.Random(seed)
    text = {"a": ["12", "7"], "b": ["Xy", "12"], "c": ["q-1", "Xy"]}
    rows = []
    for d in range(pages):
        for i in range(n if d else 2 * n):
            label = "abc"[(i + r.choice([0, 0, 0, 1])) % 3]
            rows.append((d, 1, i, label, r.choice(text[label]), 100 * "abc".index(label), 10 * i, 20, 8))
    return rows


def test_marginals_against_all_paths(spark):
    train, boxes = (spark.createDataFrame(some(s, k, 5), SCHEMA) for s, k in ((1, 6), (2, 3)))
    labels = ["a", "b", "c"]
    order, moves, seen = TR.sequence_tables(train)
    move = {(x.label, x.following): x.n + 1 for x in moves.collect()}
    move = {(p, q): move.get((p, q), 1) for p in labels for q in labels}
    sums = {p: sum(move[p, q] for q in labels) for p in labels}
    emits = {(x.label, x["shape"]): x.n for x in seen.collect()}
    total = {p: sum(n for (a, _), n in emits.items() if a == p) for p in labels}
    want = {}
    for d in range(3):
        page = TR.sequence_tables(boxes)[0].filter(F.col("doc_id") == d).orderBy("place").collect()
        page = page[:7]  # all paths of a few boxes
        mass = {}
        for path in itertools.product(labels, repeat=len(page)):
            p = 1.0
            for t, (label, box) in enumerate(zip(path, page)):
                p *= (emits.get((label, box["shape"]), 0) + 1) / (total[label] + 2) * (move[path[t - 1], label] / sums[path[t - 1]] if t else 1)
            for label, box in zip(path, page):
                mass[box.entity_seq, label] = mass.get((box.entity_seq, label), 0) + p
        for box in page:
            whole = sum(mass[box.entity_seq, x] for x in labels)
            want[d, box.entity_seq] = [mass[box.entity_seq, x] / whole for x in labels]
    kept = boxes.join(spark.createDataFrame(list(want), "doc_id long, entity_seq long"), ["doc_id", "entity_seq"])
    for chunk in (1000, 2, 3):
        got = {(x.doc_id, x.entity_seq): x.probs for x in sequence_probabilities(kept, train, labels, chunk).collect()}
        assert set(got) == set(want)
        for k, p in got.items():
            assert p == pytest.approx(want[k], abs=1e-9)


def test_combined_predictor(spark):
    """Fitted, averaged, better than chance; the workflow takes it where it is sure."""
    train, new = (spark.createDataFrame(some(s, k, 12), SCHEMA) for s, k in ((3, 12), (4, 4)))
    rows = TR.stable(FE.assemble(train, False))
    small = {"maxIter": 2, "maxDepth": 2}
    fitted = EN.fit(rows, train, forest={"numTrees": 5, "maxDepth": 4}, boosted=(small, small))
    out = EN.predict(fitted, FE.assemble(new, False), new).join(new.select("doc_id", "entity_seq", "label"), ["doc_id", "entity_seq"]).collect()
    assert len(out) == new.count() and fitted.labels == ["a", "b", "c"]
    assert all(sum(x.probs) == pytest.approx(1) and x.confidence == max(x.probs) for x in out)
    assert sum(x.predicted == x.label for x in out) / len(out) > 0.9
    from boxloom.operators import positions as P

    ranges = P.position_ranges(train.withColumn("doc_type", F.lit("t")), ["doc_type", "label"])
    top = WF.suggest_labels(new.drop("label").withColumn("doc_type", F.lit("t")), fitted.models["forest"], ranges, False, fitted, 0.6)
    assert top.filter("model = 'hybrid'").count() > 0 if "model" in top.columns else top.count() > 0
