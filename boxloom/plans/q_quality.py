"""Validation of datasets, pages and fields; business rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping as G, process as PR, quality as Q, rules as RU
from .fixture import DOC_TYPE_SQL, doc_type, entities, table
from .q_grouping import chain_sql
from .registry import query

KEY = ["doc_id", "entity_seq"]

ITEMS_SQL = """
it AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE concat(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), '-0000-0000-0000-000000000000') END AS document_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'lost' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'purchase_order' END AS document_type FROM orders),
fl AS (SELECT doc_id, 1 AS page_number, entity_seq, label AS field_name, ocr_original AS text_value, x - 140 AS x, y, width, height, ocr_confidence + 0.3E0 AS cs0, least(ocr_confidence + 0.3E0, 1.0E0) AS confidence_score FROM po_entities),
fg AS (SELECT doc_id, bool_and(trim(text_value) <> '') AS complete, bool_and(confidence_score >= 0.7E0 AND x >= 0 AND y >= 0) AS accurate, count(*) AS n_fields, count(DISTINCT field_name) AS used FROM fl GROUP BY doc_id),
ck AS (SELECT it.doc_id, concat_ws(',', 'document_id', 'status', CASE WHEN document_type IS NOT NULL THEN 'document_type' END) AS keys, coalesce(complete, false) AS fields_complete, coalesce(accurate, false) AS fields_accurate,
  coalesce(accurate, false) AND status IN ('pending', 'in_progress', 'completed', 'validated') AS is_accurate, length(document_id) = 36 AND length(document_id) - length(replace(document_id, '-', '')) = 4 AS named,
  coalesce(n_fields, 0) AS n_fields, coalesce(used, 0) AS used FROM it LEFT JOIN fg USING (doc_id))"""


def items(spark, d):
    k = F.col("o_orderkey")
    state = F.create_map(F.lit("F"), F.lit("completed"), F.lit("O"), F.lit("pending"), F.lit("P"), F.lit("in_progress"))[F.col("o_orderstatus")]
    name = F.when(k % 13 == 0, k.cast("string")).otherwise(F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit("-0000-0000-0000-000000000000")))
    return table(spark, d, "orders").select(k.alias("doc_id"), name.alias("document_id"), F.coalesce(state, F.lit("lost")).alias("status"),
                                            F.when(k % 11 != 0, "purchase_order").alias("document_type"))


def fields(spark, d):
    return entities(spark, d).select(
        "doc_id", "page_number", "entity_seq", F.col("label").alias("field_name"), F.col("ocr_original").alias("text_value"), (F.col("x") - 140).alias("x"),
        "y", "width", "height", F.least(F.col("ocr_confidence") + 0.3, F.lit(1.0)).alias("confidence_score"))


SCORES_SQL = f"""{ITEMS_SQL},
qs AS (SELECT count(*) FILTER (fields_complete) / count(*) AS completeness, count(*) FILTER (is_accurate) / count(*) AS accuracy,
  count(*) FILTER (keys = (SELECT arg_min(keys, doc_id) FROM ck)) / count(*) AS schema_consistency, 1.0E0 AS annotation_consistency, count(*) FILTER (named) / count(*) AS naming_consistency,
  count(*) FILTER (used = (SELECT count(DISTINCT field_name) FROM fl)) / count(*) AS name_coverage, count(*) AS total_items, count(*) FILTER (fields_complete) AS completed_items, count(*) FILTER (fields_accurate) AS accurate_items FROM ck),
qq AS (SELECT *, (schema_consistency + annotation_consistency + naming_consistency) / 3 AS consistency,
  completeness * 0.4E0 + accuracy * 0.3E0 + (schema_consistency + annotation_consistency + naming_consistency) / 3 * 0.3E0 AS overall FROM qs)"""

SCORE_COLS = ["completeness", "accuracy", "schema_consistency", "annotation_consistency", "naming_consistency", "name_coverage", "consistency", "overall"]


def score_row(spark, d):
    s = Q.quality_scores(items(spark, d), fields(spark, d))
    for c in SCORE_COLS:
        s = s.withColumn(c, F.round(c, 8))
    return s


@query("completeness", f"WITH {SCORES_SQL} SELECT round(completeness, 8) AS completeness, total_items, completed_items FROM qq")
def completeness(spark, d):
    return score_row(spark, d).select("completeness", "total_items", "completed_items")


@query("accuracy", f"WITH {SCORES_SQL} SELECT round(accuracy, 8) AS accuracy, total_items, accurate_items FROM qq")
def accuracy(spark, d):
    return score_row(spark, d).select("accuracy", "total_items", "accurate_items")


@query("consistency", f"WITH {SCORES_SQL} SELECT " + ", ".join(f"round({c}, 8) AS {c}" for c in SCORE_COLS[2:]) + " FROM qq")
def consistency(spark, d):
    return score_row(spark, d).select(*SCORE_COLS[2:])


@query("quality_details", f"WITH {SCORES_SQL} SELECT " + ", ".join(f"round({c}, 8) AS {c}" for c in SCORE_COLS) + ", total_items, completed_items, accurate_items FROM qq")
def quality_details(spark, d):
    return score_row(spark, d).select(*SCORE_COLS, "total_items", "completed_items", "accurate_items")


def _five_sql(name: str, value: str, src: str) -> str:
    return f"""SELECT '{name}' AS measure, avg(v) AS mean, median(v) AS median, coalesce(stddev_samp(v), 0) AS std, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {src})"""


@query("dataset_statistics", f"""WITH {ITEMS_SQL}, s AS ({_five_sql('confidence_cents', 'round(confidence_score * 100)', 'fl')} UNION ALL {_five_sql('area', 'width * height', 'fl')}
 UNION ALL {_five_sql('fields_per_document', 'n_fields', 'ck')} UNION ALL {_five_sql('text_length', 'length(text_value)', 'fl')})
SELECT measure, round(mean, 6) AS mean, median, round(std, 5) AS std, min, max FROM s""")
def dataset_statistics(spark, d):
    return Q.dataset_statistics(items(spark, d), fields(spark, d)).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 5))


@query("dataset_distributions", f"""WITH {ITEMS_SQL} SELECT 'status' AS kind, status AS name, count(*) AS n FROM it GROUP BY status UNION ALL SELECT 'document_type', coalesce(document_type, 'unknown'), count(*) FROM it GROUP BY 2
UNION ALL SELECT 'field_name', field_name, count(*) FROM fl GROUP BY field_name UNION ALL SELECT 'documents', 'distinct', count(DISTINCT document_id) FROM it""")
def dataset_distributions(spark, d):
    it, fl = items(spark, d), fields(spark, d)

    def part(df, kind, name):
        return df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")

    distinct = it.agg(F.count_distinct("document_id").alias("n")).select(F.lit("documents").alias("kind"), F.lit("distinct").alias("name"), "n")
    return part(it, "status", F.col("status")).unionByName(part(it, "document_type", F.coalesce("document_type", F.lit("unknown")))).unionByName(
        part(fl, "field_name", F.col("field_name"))).unionByName(distinct)


@query("quality_bands", f"""WITH {ITEMS_SQL}, q AS (SELECT doc_id, round((avg(confidence_score) + CASE WHEN bool_and(trim(text_value) <> '') THEN 1.0E0 ELSE 0.5E0 END) / 2, 9) AS s FROM fl GROUP BY doc_id)
SELECT CASE WHEN s >= 0.9E0 THEN 'excellent' WHEN s >= 0.7E0 THEN 'good' WHEN s >= 0.5E0 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM q GROUP BY band""")
def quality_bands(spark, d):
    return Q.quality_bands(fields(spark, d))


@query("approx_statistics")
def approx_statistics(spark, d):
    return Q.approx_statistics(fields(spark, d))


DUP_SQL = "dp AS (SELECT doc_id, field_name, count(*) AS n, min(entity_seq) AS first, max(entity_seq) AS last FROM fl GROUP BY doc_id, field_name HAVING count(*) > 1)"


@query("check_duplicates", f"WITH {ITEMS_SQL}, {DUP_SQL} SELECT * FROM dp")
def check_duplicates(spark, d):
    return Q.check_duplicates(fields(spark, d)).drop("page_number")


@query("check_types", """WITH r AS (SELECT doc_id, entity_seq, CASE WHEN entity_seq % 17 = 0 THEN NULL ELSE label END AS fn, CASE WHEN entity_seq % 19 = 0 THEN NULL ELSE text END AS tv, CASE WHEN doc_id % 23 = 0 THEN concat('x', CAST(x AS VARCHAR)) ELSE CAST(x AS VARCHAR) END AS xs FROM po_entities)
SELECT doc_id, entity_seq, 'field_name must be string' AS problem FROM r WHERE fn IS NULL UNION ALL SELECT doc_id, entity_seq, 'text_value must be string' FROM r WHERE tv IS NULL
UNION ALL SELECT doc_id, entity_seq, 'bounding_box.x must be number' FROM r WHERE TRY_CAST(xs AS DOUBLE) IS NULL""")
def check_types(spark, d):
    raw = entities(spark, d).select(
        "doc_id", "page_number", "entity_seq", F.when(F.col("entity_seq") % 17 != 0, F.col("label")).alias("field_name"), F.when(F.col("entity_seq") % 19 != 0, F.col("text")).alias("text_value"),
        F.when(F.col("doc_id") % 23 == 0, F.concat(F.lit("x"), F.col("x").cast("string"))).otherwise(F.col("x").cast("string")).alias("x"), *[F.col(c).cast("string").alias(c) for c in ("y", "width", "height")])
    return Q.check_types(raw).drop("page_number")


POS_SQL = """ps AS (SELECT doc_id, entity_seq, 'negative coordinates not allowed' AS problem FROM fl WHERE x < 0 OR y < 0
 UNION ALL SELECT doc_id, entity_seq, 'width and height must be positive' FROM fl WHERE width <= 0 OR height <= 0
 UNION ALL SELECT doc_id, entity_seq, 'unusual aspect ratio' FROM fl WHERE width > 0 AND height > 0 AND (width / height > 20 OR width / height < 0.05))"""


@query("check_coordinates", f"WITH {ITEMS_SQL}, {POS_SQL} SELECT * FROM ps")
def check_coordinates(spark, d):
    return Q.check_coordinates(fields(spark, d)).drop("page_number")


CONS_SQL = f"""{DUP_SQL}, {POS_SQL},
ov AS (SELECT count(*) AS n FROM fl a JOIN fl b ON a.doc_id = b.doc_id AND a.entity_seq < b.entity_seq AND a.x < b.x + b.width AND a.x + a.width > b.x AND a.y < b.y + b.height AND a.y + a.height > b.y),
ce AS (SELECT (SELECT n FROM ov) + (SELECT count(*) FROM dp) + (SELECT count(*) FROM ps) AS total_errors, (SELECT count(*) FROM it) AS items)"""


@query("consistency_score", f"WITH {ITEMS_SQL}, {CONS_SQL} SELECT items, total_errors, round(greatest(0.0E0, 1 - total_errors / items), 8) AS score, greatest(0.0E0, 1 - total_errors / items) >= 0.85E0 AS passed FROM ce")
def consistency_score(spark, d):
    return Q.consistency_score(items(spark, d), fields(spark, d)).withColumn("score", F.round("score", 8))


AQ_SQL = """
tf AS (SELECT *, CASE WHEN label = 'Unit price' THEN 'number' WHEN label = 'Delivery date' THEN 'date' ELSE 'text' END AS field_type,
  CASE WHEN label = 'Unit price' THEN TRY_CAST(replace(ocr_original, ',', '') AS DOUBLE) IS NOT NULL WHEN label = 'Delivery date' THEN coalesce(try_strptime(trim(ocr_original), '%Y-%m-%d'), try_strptime(trim(ocr_original), '%d-%m-%Y')) IS NOT NULL ELSE ocr_original <> '' END AS normal FROM po_entities),
hits AS (SELECT a.doc_id, count(*) AS n FROM po_entities a JOIN po_entities b ON a.doc_id = b.doc_id AND a.entity_seq < b.entity_seq AND a.x <= b.x + b.width AND a.x + a.width >= b.x AND a.y <= b.y + b.height AND a.y + a.height >= b.y GROUP BY a.doc_id),
ag AS (SELECT doc_id, avg(ocr_confidence) AS confidence, count(*) FILTER (NOT was_corrected AND trim(ocr_original) <> '') / count(*) AS completeness, count(*) FILTER (normal) / count(*) AS fmt, count(*) AS c FROM tf GROUP BY doc_id),
aq AS (SELECT doc_id, confidence, completeness, greatest(0.0E0, least(1.0E0, (1 + fmt) / 2 - CASE WHEN c < 2 THEN 0 ELSE coalesce(n, 0) / (c * (c - 1) / 2) END)) AS consistency FROM ag LEFT JOIN hits USING (doc_id))"""


def quality_fields(spark, d):
    kind = F.when(F.col("label") == "Unit price", "number").when(F.col("label") == "Delivery date", "date").otherwise("text")
    return entities(spark, d).select(
        "doc_id", "page_number", "entity_seq", F.col("label").alias("field_name"), F.col("ocr_original").alias("text_value"), "x", "y", "width", "height",
        F.col("ocr_confidence").alias("confidence_score"), kind.alias("field_type"), (~F.col("was_corrected")).alias("is_valid"), (1 - (F.col("entity_seq") % 10) / F.lit(20.0)).alias("quality"))


@query("annotation_quality", f"WITH {AQ_SQL} SELECT doc_id, round(confidence, 8) AS confidence, round(completeness, 8) AS completeness, round(consistency, 8) AS consistency, round(confidence * 0.4E0 + completeness * 0.4E0 + consistency * 0.2E0, 8) AS quality FROM aq")
def annotation_quality(spark, d):
    q = Q.annotation_quality(quality_fields(spark, d)).drop("page_number")
    return q.select("doc_id", *[F.round(c, 8).alias(c) for c in ("confidence", "completeness", "consistency", "quality")])


@query("quality_metric_report", f"""WITH {AQ_SQL} SELECT metric, count(*) AS n, round(avg(value), 6) AS average, round(min(value), 8) AS low, round(max(value), 8) AS high
FROM (SELECT 'confidence' AS metric, confidence AS value FROM aq UNION ALL SELECT 'completeness', completeness FROM aq UNION ALL SELECT 'consistency', consistency FROM aq) GROUP BY metric""")
def quality_metric_report(spark, d):
    r = Q.metric_report(Q.annotation_quality(quality_fields(spark, d)), ["confidence", "completeness", "consistency"])
    return r.select("metric", "n", F.round("average", 6).alias("average"), F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


VF_SQL = """
vf AS (SELECT doc_id, entity_seq, label, ocr_original AS t, ocr_confidence AS c, 1 - (entity_seq % 10) / 20.0E0 AS q, CASE WHEN label = 'Unit price' THEN 'number' WHEN label = 'Delivery date' THEN 'date' ELSE 'text' END AS k FROM po_entities),
ve AS (SELECT *, CASE WHEN t = '' THEN 'Field value is required' WHEN k = 'number' AND TRY_CAST(replace(t, ',', '') AS DOUBLE) IS NULL THEN concat('Invalid number format: ', t)
  WHEN k = 'date' AND coalesce(try_strptime(trim(t), '%Y-%m-%d'), try_strptime(trim(t), '%Y/%m/%d'), try_strptime(trim(t), '%d-%m-%Y'), try_strptime(trim(t), '%d/%m/%Y')) IS NULL THEN concat('Invalid date format: ', t) END AS error FROM vf),
vp AS (SELECT doc_id, count(*) AS fields, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL) AS valid, avg(c) AS confidence, avg(q) AS quality FROM ve GROUP BY doc_id)"""


@query("validate_field", f"""WITH {VF_SQL} SELECT doc_id, entity_seq, error, CASE WHEN error IS NULL THEN concat_ws(',', CASE WHEN c < 0.7E0 THEN 'low_confidence' END, CASE WHEN q < 0.8E0 THEN 'low_quality' END) ELSE '' END AS warnings,
 error IS NULL AS is_valid FROM ve""")
def validate_field(spark, d):
    return Q.validate_field(quality_fields(spark, d)).select(*KEY, "error", "warnings", "is_valid")


def checked_pages(spark, d):
    return Q.validate_page(Q.validate_field(quality_fields(spark, d)))


@query("validate_page", f"WITH {VF_SQL} SELECT doc_id, fields, errors, valid, round(confidence, 10) AS confidence, round(quality, 10) AS quality, round(valid / fields * 100, 8) AS completion, errors = 0 AS is_valid FROM vp")
def validate_page(spark, d):
    p = checked_pages(spark, d).drop("page_number")
    return p.withColumn("confidence", F.round("confidence", 10)).withColumn("quality", F.round("quality", 10)).withColumn("completion", F.round("completion", 8))


DOCS_SQL = f"""{VF_SQL},
vd AS (SELECT o_orderkey AS doc_id, concat_ws('; ', CASE WHEN o_orderkey % 11 = 0 THEN 'Document type is unknown' END, CASE WHEN o_orderkey % 29 = 0 AND vp.fields IS NULL THEN 'Page information is missing' END,
  CASE WHEN (CASE WHEN o_orderkey % 29 = 0 THEN 99 ELSE coalesce(vp.fields, 0) END) <> coalesce(vp.fields, 0) THEN 'Annotation count mismatch' END) AS errors FROM orders LEFT JOIN vp ON vp.doc_id = o_orderkey)"""


def documents_checked(spark, d):
    pages = checked_pages(spark, d)
    n = pages.groupBy("doc_id").agg(F.sum("fields").alias("n"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")).join(n, "doc_id", "left").select(
        "doc_id", F.when(F.col("doc_id") % 11 != 0, "purchase_order").alias("document_type"), F.when(F.col("doc_id") % 29 == 0, 1).otherwise(0).alias("page_count"),
        F.when(F.col("doc_id") % 29 == 0, 99).otherwise(F.coalesce("n", F.lit(0))).alias("annotation_count"))
    return Q.validate_document(docs, pages)


@query("validate_document", f"WITH {DOCS_SQL} SELECT doc_id, errors, errors = '' AS is_valid FROM vd")
def validate_document(spark, d):
    return documents_checked(spark, d)


@query("batch_validation_summary", f"""WITH {DOCS_SQL} SELECT count(*) AS total, count(*) FILTER (errors = '') AS valid, count(*) FILTER (errors <> '') AS invalid,
 CAST(sum(CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, '; ')) END) AS BIGINT) AS problems, round(count(*) FILTER (errors = '') / count(*), 8) AS rate FROM vd""")
def batch_validation_summary(spark, d):
    return Q.batch_summary(documents_checked(spark, d)).withColumn("rate", F.round("rate", 8))


@query("annotation_batch_report", f"""WITH {VF_SQL} SELECT count(*) FILTER (errors = 0) AS valid_pages, count(*) FILTER (errors > 0) AS invalid_pages, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(fields) AS BIGINT) AS total_fields,
 CAST(sum(valid) AS BIGINT) AS validated_fields, round(avg(confidence), 6) AS average_confidence, round(avg(quality), 6) AS average_quality FROM vp""")
def annotation_batch_report(spark, d):
    r = Q.annotation_batch_report(checked_pages(spark, d))
    return r.withColumn("average_confidence", F.round("average_confidence", 6)).withColumn("average_quality", F.round("average_quality", 6))


@query("validate_item", f"""WITH {ITEMS_SQL}, bx AS (SELECT doc_id, bool_or(width < 10 OR height < 10 OR x < 0 OR y < 0 OR width / height > 20 OR width / height < 0.05) AS bb, bool_or(trim(text_value) = '') AS bt FROM fl GROUP BY doc_id),
v AS (SELECT it.doc_id, concat_ws('; ', CASE WHEN status NOT IN ('pending', 'in_progress', 'completed', 'validated') THEN 'invalid status' END, CASE WHEN NOT (length(document_id) = 36) THEN 'invalid document_id' END,
  CASE WHEN bb IS NULL THEN 'no annotations' END, CASE WHEN bb THEN 'invalid bounding_box' END, CASE WHEN bt THEN 'empty text_value' END) AS errors FROM it LEFT JOIN bx USING (doc_id))
SELECT doc_id, errors, errors = '' AS is_valid FROM v""")
def validate_item(spark, d):
    return Q.validate_item(items(spark, d), fields(spark, d))


@query("completeness_gate", f"WITH {ITEMS_SQL} SELECT count(*) AS n, round(count(*) FILTER (document_id IS NOT NULL AND status IS NOT NULL) / count(*), 8) AS rate, count(*) >= 10 AND count(*) FILTER (document_id IS NOT NULL AND status IS NOT NULL) / count(*) >= 0.9 AS passed FROM it")
def completeness_gate(spark, d):
    return Q.completeness_gate(items(spark, d)).withColumn("rate", F.round("rate", 8))


@query("basic_requirements", f"WITH {ITEMS_SQL} SELECT count(*) AS total_items, count(*) FILTER (status = 'pending') AS missing_fields, count(*) FILTER (status = 'pending') = 0 AND count(*) >= 10 AS passed FROM it")
def basic_requirements(spark, d):
    return Q.basic_requirements(items(spark, d).withColumn("status", F.when(F.col("status") != "pending", F.col("status"))))


@query("split_sizes", """SELECT count(*) AS total_size, CAST(floor(count(*) * 0.7E0) AS BIGINT) AS train_size, CAST(floor(count(*) * 0.2E0) AS BIGINT) AS validation_size, CAST(floor(count(*) * 0.1E0) AS BIGINT) AS test_size,
 floor(count(*) * 0.7E0) >= 100 AND floor(count(*) * 0.2E0) >= 20 AND floor(count(*) * 0.1E0) >= 10 AS split_valid FROM orders""")
def split_sizes(spark, d):
    return Q.split_sizes(table(spark, d, "orders"))


@query("validation_report", f"""WITH {SCORES_SQL}, {CONS_SQL}, n AS (SELECT count(*) AS c FROM it)
SELECT total_items, CAST(0 AS BIGINT) AS missing_fields, true AS basic_passed, round(completeness, 8) AS completeness, round(accuracy, 8) AS accuracy, round(consistency, 8) AS consistency, round(overall, 8) AS overall, total_errors,
 round(greatest(0.0E0, 1 - total_errors / items), 8) AS consistency_score, greatest(0.0E0, 1 - total_errors / items) >= 0.85E0 AS consistency_passed, CAST(floor(c * 0.7E0) AS BIGINT) AS train_size, CAST(floor(c * 0.2E0) AS BIGINT) AS validation_size,
 CAST(floor(c * 0.1E0) AS BIGINT) AS test_size, c >= 143 AS split_valid, overall >= 0.8E0 AS quality_passed, false AS validation_passed, concat_ws('; ', 'improve data quality', CASE WHEN overall < 0.8E0 THEN 'check annotation accuracy' END, CASE WHEN total_errors > 0 THEN 'review preprocessing' END) AS advice
FROM qq, ce, n""")
def validation_report(spark, d):
    r = Q.validation_report(items(spark, d), fields(spark, d))
    for c in ("completeness", "accuracy", "consistency", "overall", "consistency_score"):
        r = r.withColumn(c, F.round(c, 8))
    return r


@query("sum_check", """
WITH l AS (SELECT doc_id, line_no, max(CAST(string_split(text, ' ')[1] AS DECIMAL(14,4))) FILTER (label = 'Quantity') AS q, max(CASE WHEN label = 'Unit price' THEN TRY_CAST(text AS DECIMAL(14,4)) END) AS u FROM po_entities WHERE label IN ('Quantity', 'Unit price') GROUP BY doc_id, line_no),
s AS (SELECT doc_id, sum(q * u) AS c, count(*) AS lines FROM l WHERE q <> 0 AND u <> 0 GROUP BY doc_id),
t AS (SELECT doc_id, CAST(replace(text, 'Total ', '') AS DECIMAL(18,4)) AS st FROM po_entities WHERE label = 'Net amount (total)')
SELECT doc_id, lines, CAST(round(c * 100) AS BIGINT) AS calculated_cents, CAST(round(st * 100) AS BIGINT) AS stated_cents, abs(st - c) <= 0.01 AS is_valid FROM s JOIN t USING (doc_id)""")
def sum_check(spark, d):
    return RU.sum_check(entities(spark, d)).drop("page_number")


@query("business_rules", """
WITH r AS (SELECT doc_id, entity_seq, label, ocr_original AS text, TRY_CAST(replace(regexp_extract(ocr_original, '([0-9,]+\\.?[0-9]*)', 1), ',', '') AS DECIMAL(18,4)) AS v FROM po_entities),
nd AS (SELECT doc_id, entity_seq, label, CASE label WHEN 'Order number' THEN 'Shipping line' WHEN 'Delivery date' THEN 'Order number' ELSE 'Quantity' END AS need FROM r WHERE label IN ('Order number', 'Delivery date', 'Unit price'))
SELECT doc_id, entity_seq, label, 'format' AS rule FROM r WHERE (label = 'Order number' AND NOT regexp_matches(text, '^[0-9]{10}$')) OR (label = 'Quantity' AND NOT regexp_matches(text, '^[0-9]+\\.[0-9]{3}\\s+[A-Za-z0-9_]{2}$'))
 OR (label = 'Delivery date' AND NOT regexp_matches(text, '^[0-9]{2}-[0-9]{2}-[0-9]{4}$'))
UNION ALL SELECT doc_id, entity_seq, label, 'range' FROM r WHERE (label = 'Quantity' AND coalesce(v < 0.001 OR v > 999999.999, true)) OR (label = 'Unit price' AND coalesce(v < 0.0001 OR v > 999999.9999, true))
UNION ALL SELECT doc_id, entity_seq, label, 'dependency' FROM nd WHERE NOT EXISTS (SELECT 1 FROM po_entities e WHERE e.doc_id = nd.doc_id AND e.label = nd.need)""")
def business_rules(spark, d):
    return RU.business_rules(entities(spark, d).withColumn("text", F.col("ocr_original"))).drop("page_number")


@query("required_fields", """SELECT o.doc_id, f.field FROM (SELECT DISTINCT doc_id FROM po_entities) o CROSS JOIN (VALUES ('Shipping line'), ('Case mark'), ('Net amount (total)')) f(field)
WHERE NOT EXISTS (SELECT 1 FROM po_entities e WHERE e.doc_id = o.doc_id AND e.label = f.field)""")
def required_fields(spark, d):
    e = entities(spark, d)
    return RU.required_fields(e.withColumnRenamed("label", "field"), e.select("doc_id", "page_number").distinct(), ["Shipping line", "Case mark", "Net amount (total)"]).drop("page_number")


LINE50 = chain_sql("cl50", "y, x", "y", "g > 50")


@query("line_item_check", f"""WITH {LINE50}, li2 AS (SELECT doc_id, row_no, arg_min(text, y * 1000000000 + x * 100000 + entity_seq) FILTER (regexp_matches(text, '^[0-9]+$')) AS quantity,
 arg_min(text, y * 1000000000 + x * 100000 + entity_seq) FILTER (regexp_matches(text, '^\\$?[0-9]+\\.?[0-9]*$')) AS unit_price FROM cl50 GROUP BY doc_id, row_no)
SELECT doc_id, row_no, quantity, unit_price, CASE WHEN TRY_CAST(quantity AS DOUBLE) <= 0 OR TRY_CAST(unit_price AS DOUBLE) < 0 THEN 'invalid quantity or price' END AS problem FROM li2 WHERE quantity IS NOT NULL AND unit_price IS NOT NULL""")
def line_item_check(spark, d):
    return RU.line_item_check(G.line_items(entities(spark, d), 50)).select("doc_id", "row_no", "quantity", "unit_price", "problem")


@query("template_completeness", """SELECT doc_id, round((max((label = 'Order number')::INT) + max((label = 'Shipping line')::INT) + max((label = 'Quantity')::INT)) / 3, 8) AS rate,
 concat_ws(',', CASE WHEN NOT bool_or(label = 'Order number') THEN 'Order number' END, CASE WHEN NOT bool_or(label = 'Shipping line') THEN 'Shipping line' END, CASE WHEN NOT bool_or(label = 'Quantity') THEN 'Quantity' END) AS missing_required,
 concat_ws(',', CASE WHEN NOT bool_or(label = 'Case mark') THEN 'Case mark' END) AS missing_optional FROM po_entities GROUP BY doc_id""")
def template_completeness(spark, d):
    t = RU.template_completeness(entities(spark, d), ["Order number", "Shipping line", "Quantity"], ["Case mark"])
    return t.drop("page_number").withColumn("rate", F.round("rate", 8))


@query("rule_registry", """SELECT doc_id, entity_seq, text <> '' AS has_text, ocr_confidence >= 0.7E0 AS sure, width >= 100 AS wide, round(((text <> '')::INT + (ocr_confidence >= 0.7E0)::INT + (width >= 100)::INT) / 3, 8) AS success_rate FROM po_entities""")
def rule_registry(spark, d):
    rules = {"has_text": lambda: F.col("text") != "", "sure": lambda: F.col("ocr_confidence") >= 0.7, "wide": lambda: F.col("width") >= 100}
    return Q.rule_registry(entities(spark, d), rules, KEY).withColumn("success_rate", F.round("success_rate", 8))


@query("process_rows", """SELECT doc_id, entity_seq, label, CASE WHEN ocr_original <> '' THEN TRY_CAST(ocr_original AS BIGINT) END AS value,
 CASE WHEN ocr_original = '' THEN 'invalid input' WHEN TRY_CAST(ocr_original AS BIGINT) IS NULL THEN 'failed' END AS error FROM po_entities WHERE label IN ('Order number', 'Item number')""")
def process_rows(spark, d):
    """Numbers read from the first readings; readings that are empty or no number stay, with their error."""
    numbers = entities(spark, d).filter(F.col("label").isin("Order number", "Item number"))
    done = PR.process_rows(numbers, F.col("ocr_original") != "", F.col("ocr_original").try_cast("bigint"))
    return done.select(*KEY, "label", "value", "error")


@query("process_counts", """SELECT label, count(*) FILTER (TRY_CAST(ocr_original AS BIGINT) IS NOT NULL) AS processed, count(*) FILTER (ocr_original = '') AS invalid,
 count(*) FILTER (ocr_original <> '' AND TRY_CAST(ocr_original AS BIGINT) IS NULL) AS failed FROM po_entities WHERE label IN ('Order number', 'Item number') GROUP BY label""")
def process_counts(spark, d):
    done = process_rows(spark, d)
    return done.groupBy("label").agg(
        F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error") == PR.INVALID).alias("invalid"), F.count_if(F.col("error") == PR.FAILED).alias("failed"))
