"""Failures beside results, and rules given by name."""

from pyspark.sql import Observation, functions as F

from boxloom.operators import process as PR, quality as Q


def test_columns(spark):
    rows = spark.createDataFrame([(1, "12"), (2, "x"), (3, ""), (4, None), (5, "7")], "id long, t string")
    seen = Observation("columns")
    got = PR.process_rows(rows, F.col("t") != "", F.col("t").try_cast("bigint"), seen).collect()
    assert [(x.value, x.error) for x in got] == [(12, None), (None, "failed"), (None, "invalid input"), (None, "invalid input"), (7, None)]
    assert seen.get == {"processed": 2, "invalid": 2, "failed": 1}


def test_python_function(spark):
    rows = spark.createDataFrame([(i, "10" if i else "0") for i in range(4)] + [(9, None), (10, "none")], "id long, t string")

    def divide(row):
        return None if row["t"] == "none" else 100.0 / int(row["t"])

    seen = Observation("function")
    got = {x.id: (x.value, x.error) for x in PR.process_with(rows, F.col("t").isNotNull(), divide, "double", seen).collect()}
    assert got[1] == got[2] == got[3] == (10.0, None)
    assert got[0][0] is None and got[0][1].startswith("ZeroDivisionError")
    assert got[9] == (None, "invalid input") and got[10] == (None, "failed")
    assert seen.get == {"processed": 3, "invalid": 1, "failed": 2}
    assert PR.process_with(rows.limit(0), F.lit(True), divide, "double").collect() == []


def test_rules_by_name(spark):
    fields = spark.createDataFrame([(1, 1, 0, "a", "x", 0, 0, 10, 10), (1, 1, 1, "a", "", 500, 500, 10, 10)],
                                   "doc_id long, page_number int, entity_seq long, field_name string, text string, x long, y long, width long, height long")
    empty = lambda f: f.filter("text = ''")
    rules = {**Q.CONSISTENCY_RULES, "text_present": empty}
    found = {r["rule"]: r["count"] for r in Q.consistency_errors(fields, rules).groupBy("rule").count().collect()}
    assert found == {"field_name_consistency": 1, "text_present": 1}
    assert Q.consistency_errors(fields, {}).count() == 0
    score = Q.consistency_score(fields, fields, rules=rules).first()
    assert (score["total_errors"], score.score) == (2, 0.0)
