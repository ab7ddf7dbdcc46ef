"""Scores that follow from the place of a box: made once for every distinct place, the same where places are many."""

import pytest
from pyspark.sql import functions as F

from boxloom.operators import positions as P, ranking as K

BOX = "doc_id long, page_number int, entity_seq long, doc_type string, label string, x long, y long, width long, height long"
ROWS = [(i, 1, 1, "ab"[i % 2] if i % 7 else None, f"L{i % 3}", i % 4, 10 * (i % 3), 5, 5 + i % 2) for i in range(200)] + [
    (900, 1, 1, "a", "L0", None, 0, 5, 5), (901, 1, 1, "c", "L0", 1, 0, 5, 5), (902, 1, 1, "a", None, 99, 99, 99, 99)]


def test_a_place_is_scored_once(spark):
    boxes = spark.createDataFrame(ROWS, BOX)
    ranges = P.position_ranges(boxes.filter("doc_id < 40 OR label IS NULL"), ["doc_type", "label"])
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(p):
        seen.add(1)
        return float(sum(s.p for s in p))

    out = P.label_probabilities(boxes, ranges, also={"whole": counted})
    assert {round(r.whole, 9) for r in out.collect()} == {1.0}
    places = boxes.filter("doc_type IN ('a', 'b') AND x IS NOT NULL").select("doc_type", "x", "y", "width", "height").distinct().count()
    assert out.count() > 3 * places >= seen.value


@pytest.mark.parametrize("most", [1, 100])
def test_few_or_many_places(spark, most, monkeypatch):
    boxes = spark.createDataFrame(ROWS, BOX)
    ranges = P.position_ranges(boxes.filter("doc_id < 40 OR label IS NULL"), ["doc_type", "label"])
    monkeypatch.setattr(P._at_places, "__defaults__", (most,))
    table = {}
    for r in ranges.collect():
        table.setdefault(r.doc_type, []).append(r)
    sides = ("x", "y", "width", "height")
    predicted = {r.doc_id: (r.predicted, r.position_score) for r in P.position_predict(boxes, ranges).collect()}
    probs = {r.doc_id: {s.label: s.p for s in r.probs} for r in P.label_probabilities(boxes, ranges, also={"entropy": K.entropy}).collect()}
    for row in ROWS:
        doc, kind, place = row[0], row[3], row[5:]
        fits = [] if kind is None or None in place else [
            (sum(r[f"{c}_min"] <= v <= r[f"{c}_max"] for c, v in zip(sides, place)), r.label) for r in table.get(kind, [])]
        best = max((n for n, _ in fits), default=0)
        names = sorted((label for n, label in fits if n == best), key=lambda v: (v is not None, v or ""))
        assert predicted[doc] == (names[0] if best > 2 else "unknown", best / 4)
        hits = {label: n for n, label in fits if n}
        assert probs.get(doc, {}) == {label: n / sum(hits.values()) for label, n in hits.items()}
