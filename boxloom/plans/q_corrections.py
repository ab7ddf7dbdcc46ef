"""Mining and use of OCR corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections as C, positions as P
from ..scale import checked_broadcast
from .fixture import DOC_TYPE_SQL, doc_type, entities
from .q_columns import ERROR_SQL
from .q_joins import RANGES_SQL
from .registry import query

KEY = ["doc_id", "entity_seq"]

CORR_SQL = """
corr AS (SELECT doc_id, entity_seq, label, ocr_original, text AS corrected, ocr_confidence, 'v1' AS source FROM po_entities WHERE line_no > 0 AND ocr_original <> '' AND text <> '' AND ocr_original <> text
 UNION ALL SELECT doc_id, entity_seq, label, ocr_original, text, ocr_confidence, 'v2' FROM po_entities WHERE line_no = 0 AND ocr_original <> '' AND ocr_original <> text)"""


def corr(spark, d):
    e = entities(spark, d)
    v2 = e.filter("line_no = 0").withColumn("corrected_value", F.when(F.col("was_corrected"), F.col("text")).otherwise(F.col("ocr_original")))
    return C.union_corrections(e.filter("line_no > 0"), v2)


@query("corrections", f"WITH {CORR_SQL} SELECT doc_id, entity_seq, label, ocr_original, corrected, source FROM corr")
def corrections(spark, d):
    return corr(spark, d).select(*KEY, "label", "ocr_original", "corrected", "source")


@query("union_corrections", f"WITH {CORR_SQL} SELECT source, count(*) AS n, count(DISTINCT doc_id) AS pages FROM corr GROUP BY source")
def union_corrections(spark, d):
    return corr(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("pages"))


@query("corrections_by_label", f"WITH {CORR_SQL} SELECT label, count(*) AS n FROM corr GROUP BY label")
def corrections_by_label(spark, d):
    return C.by_label(corr(spark, d))


@query("common_errors", f"WITH {CORR_SQL}, k AS (SELECT {ERROR_SQL.replace('text', 'corrected')} AS error_type FROM corr) SELECT error_type, count(*) AS n FROM k GROUP BY error_type")
def common_errors(spark, d):
    return C.common_errors(corr(spark, d))


@query("improvements", f"WITH {CORR_SQL} SELECT label, ocr_original AS from_text, corrected AS to_text, count(*) AS n, min(ocr_confidence) AS min_confidence, max(ocr_confidence) AS max_confidence FROM corr GROUP BY ALL")
def improvements(spark, d):
    return C.improvements(corr(spark, d))


@query("learning_report", f"""WITH {CORR_SQL}, k AS (SELECT {ERROR_SQL.replace('text', 'corrected')} AS error_type FROM corr)
SELECT 'summary' AS section, 'files' AS name, count(DISTINCT doc_id) AS value FROM po_entities UNION ALL SELECT 'summary', 'corrections', count(*) FROM corr
UNION ALL SELECT 'by_label', label, count(*) FROM corr GROUP BY label UNION ALL SELECT 'by_error', error_type, count(*) FROM k GROUP BY error_type""")
def learning_report(spark, d):
    return C.learning_report(entities(spark, d), corr(spark, d))


@query("learned_corrections", f"WITH {CORR_SQL} SELECT label, ocr_original, arg_max(corrected, doc_id * 10000 + entity_seq) AS corrected FROM corr GROUP BY label, ocr_original")
def learned_corrections(spark, d):
    return C.learned_corrections(corr(spark, d))


@query("text_shapes", f"""WITH {CORR_SQL} SELECT label, count(*) FILTER (regexp_matches(corrected, '^[0-9]+$')) AS numeric,
 count(*) FILTER (NOT regexp_matches(corrected, '^[0-9]+$') AND regexp_matches(corrected, '^[A-Z0-9]+$')) AS alphanumeric_upper,
 count(*) FILTER (regexp_matches(corrected, '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}$')) AS date_mdy FROM corr GROUP BY label""")
def text_shapes(spark, d):
    return C.text_shapes(corr(spark, d))


RUN_SQL = f"""{CORR_SQL},
run AS (SELECT doc_id, entity_seq, label, row_number() OVER (PARTITION BY label ORDER BY doc_id, entity_seq) AS n FROM corr),
acc AS (SELECT *, least(0.5E0 + n * 0.01E0, 0.99E0) AS accuracy FROM run)"""


@query("running_accuracy", f"WITH {RUN_SQL} SELECT doc_id, entity_seq, label, n, round(accuracy, 6) AS accuracy FROM acc")
def running_accuracy(spark, d):
    return C.running_accuracy(corr(spark, d)).select(*KEY, "label", "n", F.round("accuracy", 6).alias("accuracy"))


@query("plateau", f"""WITH {RUN_SQL} SELECT label, n, accuracy >= 0.95E0 OR (n >= 50 AND max(accuracy) OVER w - min(accuracy) OVER w < 0.02E0) AS stop FROM acc
WINDOW w AS (PARTITION BY label ORDER BY n ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def plateau(spark, d):
    return C.plateau(C.running_accuracy(corr(spark, d))).select("label", "n", "stop")


@query("learning_status", f"""WITH {CORR_SQL}, p AS (SELECT label, count(*) AS n, least(0.5E0 + count(*) * 0.01E0, 0.99E0) AS accuracy FROM corr GROUP BY label)
SELECT label, n, round(accuracy, 6) AS accuracy, round((SELECT avg(accuracy) FROM p), 6) AS overall, (SELECT bool_and(accuracy >= 0.95E0) FROM p) AS complete, (SELECT CAST(sum(n) AS BIGINT) FROM p) AS total FROM p""")
def learning_status(spark, d):
    s = C.learning_status(corr(spark, d))
    return s.withColumn("accuracy", F.round("accuracy", 6)).withColumn("overall", F.round("overall", 6))


@query("history_cap", f"""WITH {CORR_SQL} SELECT doc_id, entity_seq, label, age FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id DESC, entity_seq DESC) AS age FROM corr) WHERE age <= 100""")
def history_cap(spark, d):
    return C.history_cap(corr(spark, d), 100).select(*KEY, "label", F.col("age").cast("long").alias("age"))


@query("correct_text")
def correct_text(spark, d):
    return C.correct_text(entities(spark, d), C.learned_corrections(corr(spark, d))).select(*KEY, "label", "ocr_original", "corrected")


CONF_SQL = f"""{RANGES_SQL}, {CORR_SQL},
lc AS (SELECT label, ocr_original, arg_max(corrected, doc_id * 10000 + entity_seq) AS corrected FROM corr GROUP BY label, ocr_original),
pg AS (SELECT label, count(*) AS n, least(0.5E0 + count(*) * 0.01E0, 0.99E0) AS accuracy, bool_or(regexp_matches(corrected, '^[0-9]+$')) AS numeric_label FROM corr GROUP BY label),
b AS (SELECT e.doc_id, e.entity_seq, e.label, e.text, e.ocr_original, e.was_corrected, e.ocr_confidence, p.position_score, coalesce(l.corrected, e.ocr_original) AS corrected,
  coalesce(numeric_label, false) AS numeric_label, coalesce(accuracy > 0.9E0, false) AS late
 FROM po_entities e JOIN pr p USING (doc_id, entity_seq) LEFT JOIN lc l USING (label, ocr_original) LEFT JOIN pg USING (label)),
cf AS (SELECT b.*, least(1.0E0, ocr_confidence * CASE WHEN late THEN 0.2E0 ELSE 0.3E0 END + position_score * 0.3E0
  + CASE WHEN k.corrected IS NOT NULL THEN 0.9E0 WHEN regexp_matches(b.corrected, '^[0-9]+$') AND numeric_label THEN 0.8E0 ELSE 0.5E0 END * 0.2E0
  + CASE WHEN s.corrected IS NOT NULL THEN 0.9E0 ELSE 0.5E0 END * CASE WHEN late THEN 0.4E0 ELSE 0.2E0 END) AS confidence
 FROM b LEFT JOIN (SELECT DISTINCT label, corrected FROM lc) k ON b.label = k.label AND b.corrected = k.corrected
 LEFT JOIN lc s ON b.label = s.label AND b.ocr_original = s.ocr_original AND b.corrected = s.corrected)"""


def scored(spark, d, only="true", replaced=False):
    """Learned text and confidence of the boxes that ``only`` names; what is learned comes from all of them."""
    e = entities(spark, d).withColumn("doc_type", doc_type())
    c = corr(spark, d)
    numeric = checked_broadcast(C.text_shapes(c).select("label", (F.col("numeric") > 0).alias("numeric_label")))
    placed = P.position_predict(e.filter(only), P.position_ranges(e.filter("was_corrected"), ["doc_type", "label"]))
    ready = placed.join(numeric, "label", "left").withColumn("numeric_label", F.coalesce("numeric_label", F.lit(False)))
    return C.learned_confidence(ready, C.learned_corrections(c), C.by_label(c).withColumn("accuracy", C.accuracy(F.col("n"))), replaced)


@query("correction_confidence", f"WITH {CONF_SQL} SELECT doc_id, entity_seq, round(confidence, 8) AS confidence, round(confidence, 8) < 0.8E0 AS needs_review FROM cf")
def correction_confidence(spark, d):
    s = scored(spark, d).withColumn("confidence", F.round("confidence", 8))
    return s.select(*KEY, "confidence", (F.col("confidence") < 0.8).alias("needs_review"))


@query("resolve_text", f"""WITH {CONF_SQL} SELECT doc_id, entity_seq, CASE WHEN was_corrected THEN text WHEN round(confidence, 8) > 0.8E0 AND corrected <> ocr_original THEN corrected ELSE ocr_original END AS resolved,
 CASE WHEN was_corrected THEN 'user' WHEN round(confidence, 8) > 0.8E0 AND corrected <> ocr_original THEN 'learned' ELSE 'ocr' END AS origin FROM cf""")
def resolve_text(spark, d):
    # What a user corrected needs no learned text and stays where it is; a reading that nothing replaces stays at any confidence.
    user = entities(spark, d).filter("was_corrected").select("*", F.lit(None).cast("string").alias("corrected"), F.lit(None).cast("double").alias("confidence"))
    rest = scored(spark, d, "NOT coalesce(was_corrected, false)", replaced=True).withColumn("confidence", F.round("confidence", 8))
    return C.resolve_text(user).select(*KEY, "resolved", "origin").unionByName(C.resolve_text(rest).select(*KEY, "resolved", "origin"))
