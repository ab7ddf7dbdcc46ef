"""Work on ordinary pages stays where the boxes lie."""

import pytest

from boxloom.operators import relations as R
from boxloom.plans import catalog
from boxloom.plans.fixture import doc_type, entities


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["ensemble", "neighbours", "relational_features", "prediction_groups"])
def test_no_box_is_shuffled(spark, sf, name):
    entities(spark, sf)
    assert exchanges(catalog.QUERIES[name](spark, sf)) == 0


def test_neighbours_of_long_pages(spark, monkeypatch):
    rows = [(1, 1, i, 10 * (i * 7 % 30), 40 * (i % 3), 5, 10) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_number int, entity_seq bigint, x bigint, y bigint, width bigint, height bigint")
    short = sorted(R.row_neighbours(df).collect())
    monkeypatch.setattr(R, "usual_pages", lambda *a, **k: False)
    assert short == sorted(R.row_neighbours(df).collect()) and len(short) == 90


def test_sequences_are_decoded_in_place(spark, sf):
    from boxloom.ml import train as TR

    assert exchanges(TR.decode_sequences(entities(spark, sf))) == 0


def test_rows_of_a_page_are_made_once_for_a_match(spark, sf, monkeypatch):
    """Pages bring their row sequences; they are not made again for every round of scores."""
    from boxloom.operators import templates as TP

    seen = []
    exact = TP.exact_scores
    monkeypatch.setattr(TP, "exact_scores", lambda boxes, pairs, sequences, *rest: seen.append(sequences) or exact(boxes, pairs, sequences, *rest))
    boxes = entities(spark, sf).filter("doc_id < 60").withColumn("doc_type", doc_type())
    assert TP.match(boxes, TP.stored(TP.learn(boxes))).count() > 0
    assert seen == [None, None]
