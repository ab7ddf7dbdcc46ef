"""Template retrieval by bounds against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import sequences as SQ, templates as TP
from boxloom.scale import PAGE

SCHEMA = ("doc_id long, page_number int, entity_seq long, label string, text string, x long, y long, width long, height long, doc_type string")
LABELS = ["a", "b", "c", "d", "e", "f", "g", "", "h"]


def pages(seed, n, kinds):
    """Pages of some layouts, shaken a little; every layout has its own labels and places."""
    r = random.Random(seed)
    layouts = []
    for _ in range(9):
        layouts.append([(r.choice(LABELS), r.randrange(0, 2400, 130), r.randrange(0, 3400, 120)) for _ in range(r.randint(2, 14))])
    rows = []
    for doc in range(n):
        for s, (label, x, y) in enumerate(r.choice(layouts)):
            if r.random() < 0.9:
                rows.append((doc, 1, s, label, r.choice(["12", "AB1", "x y z", "", "a long text here"]), x + r.randint(0, 6), y + r.randint(0, 6), 100, 30 + r.randint(0, 9), kinds[doc % len(kinds)]))
    return rows


@pytest.mark.parametrize("seed,kinds,threshold", [(1, ["p", "q"], 0.7), (2, ["unknown", "p"], 0.5), (3, ["p"], 0.62)])
def test_best_of_all_pairs(spark, seed, kinds, threshold):
    known = TP.stored(TP.learn(spark.createDataFrame(pages(seed, 80, kinds), SCHEMA)))
    boxes = spark.createDataFrame(pages(seed, 60, [*kinds, "never seen"]), SCHEMA)
    got = {(x.doc_id, x.template_id): x.score for x in TP.match(boxes, known, threshold).collect()}
    own = boxes.groupBy(*PAGE).agg(F.min("doc_type").alias("doc_type"), F.collect_set(F.when(F.col("label") != "", F.col("label"))).alias("labels"))
    own = own.join(TP.page_tables(boxes), PAGE, "left").fillna(0, ["tables"])
    lists = known.fields.groupBy("template_id").agg(F.collect_set("label").alias("all"), F.collect_set(F.when(F.col("required"), F.col("label"))).alias("req"))
    kind = known.templates.select("template_id", F.col("doc_type").alias("t"))
    has = [x.t for x in kind.select("t").distinct().collect()]
    every = own.crossJoin(lists.join(kind, "template_id")).filter((F.col("doc_type") == F.col("t")) | (F.col("doc_type") == "unknown") | ~F.col("doc_type").isin(has))
    part = lambda c: F.size(F.array_intersect(c, "labels")) / F.greatest(F.size(c), F.lit(1))
    field = (part("req") * 0.6 + part("all") * 0.4) * F.greatest(F.lit(0.0), 1 - F.size(F.array_except("labels", "all")) * 0.05)
    pairs = every.select(*PAGE, "tables", "template_id", field.alias("field_score"))
    sequences = SQ.bin_sequences(boxes).select(*PAGE, "sequence").distinct()
    scored = TP.exact_scores(boxes, pairs, sequences, known).collect()
    best = {}
    for x in scored:
        best[x.doc_id] = max(best.get(x.doc_id, (0, "")), (x.score, x.template_id))
    wanted = {(d, t): s for d, (s, t) in best.items() if s >= threshold}
    assert len(scored) > 2 * len(best) > 0 and wanted
    assert got == wanted


def test_template_of_two_pages(spark):
    """A layout that only two pages of many share is learned, and a third page of it finds it."""
    common = [(d, 1, s, label, "12", 100 * s, 200, 90, 30, "p") for d in range(400) for s, label in enumerate("ab")]
    rare = [(d, 1, s, label, "12", 1500 + 100 * s, 3000, 90, 30, "p") for d in (1000, 1001) for s, label in enumerate("xyz")]
    known = TP.stored(TP.learn(spark.createDataFrame(common + rare, SCHEMA)))
    assert sorted(x.samples for x in known.templates.collect()) == [2, 400]
    third = [(7, 1, s, label, "13", 1502 + 100 * s, 3001, 90, 30, "p") for s, label in enumerate("xyz")]
    found = TP.match(spark.createDataFrame(third, SCHEMA), known).join(known.templates.select("template_id", "samples"), "template_id").collect()
    assert [(x.doc_id, x.samples) for x in found] == [(7, 2)]


def test_no_templates_and_no_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(pages(1, 20, ["p"]), SCHEMA)
    assert TP.match(some, TP.stored(TP.learn(empty))).collect() == []
    assert TP.match(empty, TP.stored(TP.learn(some))).collect() == []
    with pytest.raises(ValueError):
        TP.match(some, TP.stored(TP.learn(some)), 0.2)


def test_no_table_as_long_as_the_boxes_is_cut(spark, monkeypatch):
    boxes = spark.createDataFrame([(d, 1, s, label, "12", 200 * s, 200 * s, 90, 30, "p") for d in range(200) for s, label in enumerate("abcdefgh")], SCHEMA)
    known, rows = TP.stored(TP.learn(boxes)), []
    monkeypatch.setattr(TP, "cut", lambda df, cut=TP.cut: rows.append((out := cut(df)).count()) or out)
    assert TP.match(boxes, known).count() == 200
    assert rows and max(rows) < 200
