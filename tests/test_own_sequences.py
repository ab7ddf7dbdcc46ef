"""Sequences learned from and predicted for the same boxes."""

from boxloom.operators import grouping, sequences as SQ

BOX = "doc_id long, page_number int, entity_seq long, label string, x long, y long, height long"


def rows():
    out = []
    for doc in range(40):
        for line in range(3):
            labels = ["A", "B", "C", "", None][: 1 + (doc + line) % 5]
            out += [(doc, 1, 10 * line + i, v, 50 * i, 100 * line, 10) for i, v in enumerate(labels)]
        if doc % 4 == 0:
            out.append((doc, 1, 99, "A", 0, 0, 10))
    return out


def test_the_same_as_learning_first(spark):
    boxes = spark.createDataFrame(rows(), BOX)
    want = sorted(map(tuple, SQ.predict_sequences(boxes, SQ.label_sequences(boxes)).collect()))
    assert sorted(map(tuple, SQ.predict_own_sequences(boxes).collect())) == want and len(want) > 40


def test_rows_are_made_once_and_stay(spark, monkeypatch):
    made = []
    monkeypatch.setattr(SQ, "band_groups", lambda *a, **k: made.append(1) or grouping.band_groups(*a, **k))
    out = SQ.predict_own_sequences(spark.createDataFrame(rows(), BOX))
    assert len(made) == 1
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
