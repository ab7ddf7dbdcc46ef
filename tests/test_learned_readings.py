"""Learned texts and their confidence from one table of readings."""

import re

from boxloom.operators import corrections as C
from boxloom.plans import q_corrections as Q


def test_one_table_gives_what_two_joins_give(spark):
    learned = spark.createDataFrame([("A", "1O", "10"), ("A", "I0", "10"), ("A", "10", "1O"), ("A", "x", "y"), ("B", "x", ""), (None, "x", "z")], "label string, ocr_original string, corrected string")
    progress = spark.createDataFrame([("A", 0.99), ("B", 0.6)], "label string, accuracy double")
    rows = [(i, label, text, 0.5, 0.25, label == "A") for i, (label, text) in enumerate(
        (label, text) for label in ("A", "B", "C", None) for text in ("1O", "I0", "10", "x", "y", "", "77", None))]
    boxes = spark.createDataFrame(rows, "doc_id long, label string, ocr_original string, ocr_confidence double, position_score double, numeric_label boolean")
    plain = boxes.join(learned, ["label", "ocr_original"], "left").selectExpr("* except (corrected)", "coalesce(corrected, ocr_original) AS corrected")
    cols = ["doc_id", "corrected", "confidence", "needs_review"]
    want = sorted(map(str, C.correction_confidence(plain, learned, progress).select(*cols).collect()))
    assert sorted(map(str, C.learned_confidence(boxes, learned, progress).select(*cols).collect())) == want and len(want) == len(rows)
    some = {r.doc_id: r for r in C.learned_confidence(boxes, learned, progress, replaced=True).select(*cols).collect()}
    full = {r.doc_id: r for r in C.learned_confidence(boxes, learned, progress).select(*cols, "ocr_original").collect()}
    assert len(some) == len(rows) and any(r.confidence for r in some.values())
    for doc, r in full.items():
        changed = r.corrected is not None and r.corrected != r.ocr_original
        assert some[doc] == ((doc, r.corrected, r.confidence, r.needs_review) if changed else (doc, r.corrected, None, None))


def test_boxes_are_dealt_once(spark, sf):
    """The boxes themselves go through one exchange, by label and reading, not one for each question."""
    plan = Q.scored(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join LeftOuter, .*", plan)
    assert sum("rightHint=(strategy=broadcast)" not in j for j in joins) == 1
