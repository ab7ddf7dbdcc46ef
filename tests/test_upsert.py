"""Changes of different origin that meet at one key."""

from pyspark.sql import functions as F

from boxloom.operators import merge as M
from boxloom.streaming import jobs as J


def test_reviews_of_two_boxes_at_one_id_stay(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    changes = spark.createDataFrame([(1, 7, "old", 1), (1, 7, "x", 2), (1, 8, "y", 2), (3, 9, "z", 1)], "id long, box long, text string, at int")
    got = M.upsert(base, changes, "id", F.col("at"), ["text"], ("box",))
    assert sorted(map(tuple, got.collect())) == [(1, "x", "review"), (1, "y", "review"), (2, "b", "base"), (3, "z", "new")]


def test_a_review_changes_its_own_document(spark, tmp_path):
    note = "struct(array(named_struct('annotation_id', id, 'text_value', text, 'confidence_score', 1.0D)) AS reviewed_annotations, doc AS document_id, at AS feedback_timestamp)"
    drops = spark.createDataFrame([("1", "a", "old", "2024-01-01"), ("1", "a", "new", "2024-01-02"), ("2", "b", "y", "2024-01-01")], "doc string, id string, text string, at string")
    drops.selectExpr(f"inline(array({note}))").write.option("compression", "gzip").json(f"{tmp_path}/in")
    J.merge_feedback(J.feedback_source(spark, f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    base = spark.createDataFrame([(1, "a", "x", 0.5), (2, "a", "x", 0.5), (2, "c", "z", 0.5)], "doc_id long, id string, text string, confidence double")
    got = J.current(base, f"{tmp_path}/table", "doc_id")
    assert sorted(map(tuple, got.collect())) == [(1, "a", "new", 1.0), (2, "a", "x", 0.5), (2, "b", "y", 1.0), (2, "c", "z", 0.5)]
