"""Sources, sinks and conversions between label layouts."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import convert as V, quality as Q
from ..scale import cut, shared_dir
from ..sources import readers as RD, writers as WR
from .fixture import entities, table
from .q_grouping import PARTS_SQL
from .q_quality import quality_fields
from .registry import query

KEY = ["doc_id", "entity_seq"]
RN = "row_number() OVER (PARTITION BY doc_id ORDER BY line_no, entity_seq)"


def folder(spark, d, name: str) -> str:
    tag = hashlib.md5(d.encode()).hexdigest()[:8]
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/files_{tag}/{name}"


@query("v1_to_v2", f"""SELECT doc_id, format('ent_{{:03d}}', {RN} - 1) AS entity_id, CASE WHEN line_no > 0 THEN format('ITEM_{{:05d}}', line_no) ELSE '-' END AS group_id, label, text, round(x / 2480, 8) AS x_normalized, round(y / 3508, 8) AS y_normalized, was_corrected FROM po_entities""")
def v1_to_v2(spark, d):
    docs = V.page_documents(V.entity_rows(entities(spark, d)))
    e = docs.select("doc_id", F.explode("entities").alias("e"))
    return e.select("doc_id", "e.entity_id", "e.group_id", F.col("e.label.primary").alias("label"), F.col("e.text.value").alias("text"), F.round("e.position.x_normalized", 8).alias("x_normalized"),
                    F.round("e.position.y_normalized", 8).alias("y_normalized"), "e.ocr_results.was_corrected")


@query("v1_to_v2_groups", f"""WITH n AS (SELECT *, {RN} - 1 AS place FROM po_entities) SELECT doc_id, format('ITEM_{{:05d}}', line_no) AS group_id, 'item_line' AS group_type, arg_min(y, place) AS y_position, count(*) AS members,
 min(format('ent_{{:03d}}', place)) AS first_entity FROM n WHERE line_no > 0 GROUP BY doc_id, line_no""")
def v1_to_v2_groups(spark, d):
    return V.entity_groups(V.entity_rows(entities(spark, d))).drop("page_number")


@query("v2_repair", """
WITH c AS (SELECT doc_id, entity_seq, label, text, x + width / 2 AS cx, y + height / 2 AS cy FROM po_entities),
r AS (SELECT a.doc_id, a.entity_seq, count(*) FILTER (abs(a.cy - b.cy) < 30) AS rr, count(*) FILTER (abs(a.cy - b.cy) < 30 OR abs(a.cx - b.cx) < 50) AS sr,
  count(*) FILTER (a.label = 'Item number' AND b.label IN ('Part number', 'Quantity', 'Unit price') AND abs(a.cy - b.cy) < 50) AS dr FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.entity_seq <> b.entity_seq GROUP BY a.doc_id, a.entity_seq)
SELECT e.doc_id, e.entity_seq, CASE WHEN y + height / 2 < 3508 * 0.15E0 THEN 'header' WHEN y + height / 2 > 3508 * 0.85E0 THEN 'footer' ELSE 'body' END AS region,
 CASE WHEN x + width / 2 < 1240 THEN CASE WHEN y + height / 2 < 1754 THEN 'top_left' ELSE 'bottom_left' END ELSE CASE WHEN y + height / 2 < 1754 THEN 'top_right' ELSE 'bottom_right' END END AS quadrant,
 length(text) AS text_length, regexp_matches(replace(replace(text, '.', ''), ',', ''), '^[0-9]+$') AS is_numeric, regexp_matches(text, '^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}') AS is_date,
 regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]') AS is_uppercase, width * height AS area, label IN ('Quantity', 'Unit price', 'Net amount', 'Total') AS means_quantity,
 coalesce(sr, 0) + coalesce(dr, 0) AS relations, coalesce(rr, 0) AS row_relations, coalesce(dr, 0) AS detail_relations, ocr_original FROM po_entities e LEFT JOIN r USING (doc_id, entity_seq)""")
def v2_repair(spark, d):
    return V.repaired(entities(spark, d)).select(*KEY, "region", "quadrant", F.col("text_length").cast("long").alias("text_length"), "is_numeric", "is_date", "is_uppercase", "area", "means_quantity", "relations", "row_relations", "detail_relations", "ocr_original")


@query("bboxdata_to_items", """
WITH RECURSIVE o2 AS (SELECT doc_id, y, row_number() OVER (PARTITION BY doc_id ORDER BY y, entity_seq) AS rn FROM po_entities WHERE line_no = 0),
w AS (SELECT doc_id, rn, y, y AS base, CAST(1 AS BIGINT) AS row_no FROM o2 WHERE rn = 1 UNION ALL SELECT o2.doc_id, o2.rn, o2.y, CASE WHEN o2.y - w.base <= 15 THEN w.base ELSE o2.y END, CASE WHEN o2.y - w.base <= 15 THEN w.row_no ELSE w.row_no + 1 END FROM w JOIN o2 ON o2.doc_id = w.doc_id AND o2.rn = w.rn + 1),
g AS (SELECT doc_id, format('ITEM_{:05d}', line_no) AS group_id, false AS made, min(y) AS y_position, count(*) AS n FROM po_entities WHERE line_no > 0 GROUP BY doc_id, line_no UNION ALL SELECT doc_id, format('item_{:05d}', row_no), true, min(y), count(*) FROM w GROUP BY doc_id, row_no)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y_position, group_id) AS place FROM g""")
def bboxdata_to_items(spark, d):
    e = entities(spark, d).withColumn("group_id", F.when(F.col("line_no") > 0, F.format_string("ITEM_%05d", "line_no")).otherwise("-"))
    return V.item_groups(e).drop("page_number")


@query("flatten_groups", "SELECT doc_id, entity_seq, line_no, label, text, x, y, width, height FROM po_entities")
def flatten_groups(spark, d):
    return V.flat_labels(V.nested_groups(entities(spark, d))).drop("page_number")


@query("relabel", "SELECT doc_id, entity_seq, CASE label WHEN 'Delivery date' THEN 'Shipping date' ELSE label END AS label FROM po_entities")
def relabel(spark, d):
    return V.flat_labels(V.relabel_groups(V.nested_groups(entities(spark, d)), {"Delivery date": "Shipping date"})).select(*KEY, "label")


KEYS_SQL = """
k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('20250808_110604_20240909', lpad(CAST(o_custkey AS VARCHAR), 6, '0'), '-0001_page001_label.json') WHEN 1 THEN concat('20240909_', lpad(CAST(o_custkey AS VARCHAR), 6, '0'), '_20250808110604-0001_page001_label.json')
  WHEN 2 THEN concat('doc', CAST(o_custkey AS VARCHAR), '_page_002_label.json') ELSE concat('doc', CAST(o_custkey AS VARCHAR), '_page002.json') END AS name FROM orders),
r AS (SELECT o_orderkey, name, CASE o_orderkey % 4 WHEN 0 THEN concat('20240909_', substring(name, 25, 6), '_20250808110604-0001_page001_label.json') WHEN 1 THEN name WHEN 2 THEN replace(name, '_page_', '_page') ELSE replace(name, '.json', '_label.json') END AS new_key FROM k)"""


@query("rename_page_keys", f"WITH {KEYS_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY new_key ORDER BY name <> new_key, o_orderkey) AS rn, count(*) OVER (PARTITION BY new_key) AS copies FROM r) SELECT new_key, name AS old_key, copies FROM z WHERE rn = 1")
def rename_page_keys(spark, d):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    six = F.lpad(c, 6, "0")
    name = F.when(k == 0, F.concat(F.lit("20250808_110604_20240909"), six, F.lit("-0001_page001_label.json"))).when(
        k == 1, F.concat(F.lit("20240909_"), six, F.lit("_20250808110604-0001_page001_label.json"))).when(
        k == 2, F.concat(F.lit("doc"), c, F.lit("_page_002_label.json"))).otherwise(F.concat(F.lit("doc"), c, F.lit("_page002.json")))
    return V.rename_keys(table(spark, d, "orders").select("o_orderkey", name.alias("name")), "name", "o_orderkey")


@query("bbox_normalize_input", "SELECT doc_id, entity_seq, x AS bx, y AS by, CASE WHEN entity_seq % 3 = 2 AND label = 'Quantity' THEN 100 ELSE width END AS bw, height AS bh FROM po_entities")
def bbox_normalize_input(spark, d):
    k = F.col("entity_seq") % 3
    e = entities(spark, d)
    mixed = e.select(
        *KEY, F.when(k == 0, F.struct("x", "y", "width", "height")).alias("bbox"), F.when(k == 1, F.col("x")).alias("x"), F.when(k == 1, F.col("y")).alias("y"), F.when(k == 2, F.col("x")).alias("left"), F.when(k == 2, F.col("y")).alias("top"),
        F.when((k > 0) & ~((k == 2) & (F.col("label") == "Quantity")), F.col("width")).alias("width"), F.when(k > 0, F.col("height")).alias("height"))
    return V.any_box(mixed).select(*KEY, "bx", "by", "bw", "bh")


@query("words_to_entities", "SELECT doc_id, format('ent_{:03d}', row_number() OVER (PARTITION BY doc_id ORDER BY entity_seq) - 1) AS entity_id, ocr_original AS text, x, y, width, height FROM po_entities WHERE ocr_original <> ''")
def words_to_entities(spark, d):
    w = F.struct("entity_seq", F.col("ocr_original").alias("text"), F.struct("x", "y", "width", "height").alias("bbox"))
    pages = entities(spark, d).groupBy("doc_id", F.expr("entity_seq div 10000").alias("part")).agg(F.array_sort(F.collect_list(w)).alias("words"))
    return V.words_to_entities(pages, ["doc_id"]).select("doc_id", "entity_id", "text", "x", "y", "width", "height")


@query("ocr_pack", """WITH l AS (SELECT doc_id, line_no, string_agg(trim(ocr_original), ' ' ORDER BY entity_seq) AS line FROM po_entities WHERE ocr_confidence > 0.3E0 AND trim(ocr_original) <> '' GROUP BY doc_id, line_no),
n AS (SELECT doc_id, count(*) AS total_lines, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS total_characters FROM l GROUP BY doc_id)
SELECT e.doc_id, count(*) FILTER (trim(ocr_original) <> '') AS total_words, round(avg(ocr_confidence), 10) AS average_confidence, any_value(total_lines) AS total_lines, any_value(total_characters) AS total_characters FROM po_entities e LEFT JOIN n USING (doc_id) GROUP BY e.doc_id""")
def ocr_pack(spark, d):
    w = entities(spark, d).withColumn("text", F.col("ocr_original"))
    return V.ocr_statistics(w, V.pack_ocr(w, "line_no", 0.3)).drop("page_number").withColumn("average_confidence", F.round("average_confidence", 10))


@query("ocr_lines", "SELECT doc_id, line_no, string_agg(trim(ocr_original), ' ' ORDER BY entity_seq) AS line, count(*) AS words FROM po_entities WHERE ocr_confidence > 0.3E0 AND trim(ocr_original) <> '' GROUP BY doc_id, line_no")
def ocr_lines(spark, d):
    return V.pack_ocr(entities(spark, d).withColumn("text", F.col("ocr_original")), "line_no", 0.3).drop("page_number")


LOOK_SQL = """
q AS (SELECT o_orderkey AS request_id, concat('20240101_120000_c', CAST(o_custkey AS VARCHAR)) AS stem, CAST(o_orderkey % 5 + 1 AS INT) AS page FROM orders),
f AS (SELECT DISTINCT concat(CASE WHEN l_partkey % 3 = 0 THEN '20240101_120000' ELSE '20240202_130000' END, '_c', CAST(l_partkey AS VARCHAR), CASE l_suppkey % 3 WHEN 0 THEN concat('_page', lpad(CAST(l_linenumber AS VARCHAR), 3, '0')) WHEN 1 THEN concat('_page_', lpad(CAST(l_linenumber AS VARCHAR), 3, '0')) ELSE '' END, '_label.json') AS name FROM lineitem),
c AS (SELECT regexp_extract(name, '^[0-9]{8}_[0-9]{6}_(.+)_page_?([0-9]{3})_label\\.json$', 1) AS core, regexp_extract(name, '^[0-9]{8}_[0-9]{6}_(.+)_page_?([0-9]{3})_label\\.json$', 2) AS pg, min(name) AS n3 FROM f GROUP BY ALL),
j AS (SELECT q.request_id, f1.name AS n1, f2.name AS n2, c.n3, f4.name AS n4 FROM q LEFT JOIN f f1 ON f1.name = concat(stem, '_page', lpad(CAST(page AS VARCHAR), 3, '0'), '_label.json') LEFT JOIN f f2 ON f2.name = concat(stem, '_page_', lpad(CAST(page AS VARCHAR), 3, '0'), '_label.json')
 LEFT JOIN c ON c.core = substring(stem, 17) AND c.pg = lpad(CAST(page AS VARCHAR), 3, '0') LEFT JOIN f f4 ON f4.name = concat(stem, '_label.json'))"""


@query("src_label_lookup", f"WITH {LOOK_SQL} SELECT request_id, coalesce(n1, n2, n3, n4) AS name, CASE WHEN n1 IS NOT NULL THEN 'page' WHEN n2 IS NOT NULL THEN 'underscore' WHEN n3 IS NOT NULL THEN 'core' WHEN n4 IS NOT NULL THEN 'file' END AS found_by FROM j")
def src_label_lookup(spark, d):
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("20240101_120000_c"), F.col("o_custkey").cast("string")).alias("stem"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("page"))
    li = table(spark, d, "lineitem")
    page = F.lpad(F.col("l_linenumber").cast("string"), 3, "0")
    kind = F.col("l_suppkey") % 3
    name = F.concat(F.when(F.col("l_partkey") % 3 == 0, "20240101_120000").otherwise("20240202_130000"), F.lit("_c"), F.col("l_partkey").cast("string"),
                    F.when(kind == 0, F.concat(F.lit("_page"), page)).when(kind == 1, F.concat(F.lit("_page_"), page)).otherwise(""), F.lit("_label.json"))
    return V.label_lookup(requests, li.select(name.alias("name")).distinct())


TYPE_CASE = "CASE WHEN label = 'Unit price' THEN 'number' WHEN label = 'Delivery date' THEN 'date' ELSE 'text' END"


@query("snk_coco", f"SELECT concat(CAST(doc_id AS VARCHAR), '_1') AS image_id, concat(CAST(doc_id AS VARCHAR), '_', CAST(entity_seq AS VARCHAR)) AS id, {TYPE_CASE} AS category_id, [x, y, width, height] AS bbox, width * height AS area, 0 AS iscrowd, {{'text': text, 'confidence': ocr_confidence, 'field_name': label}} AS attributes FROM po_entities")
def snk_coco(spark, d):
    kind = F.when(F.col("label") == "Unit price", "number").when(F.col("label") == "Delivery date", "date").otherwise("text")
    return WR.coco(entities(spark, d).withColumn("field_type", kind).withColumn("confidence", F.col("ocr_confidence")))


# --- files: written from the tables, read back by the readers ---------------------------------------------------------


def flat_pages(spark, d):
    e = entities(spark, d)
    box = F.struct("entity_seq", "x", "y", "width", "height", "label", "text", F.col("line_no").cast("string").alias("group_id"), "ocr_original", "ocr_confidence", "was_corrected")
    pages = e.groupBy("doc_id", F.expr("entity_seq div 10000").alias("part")).agg(F.array_sort(F.collect_list(box)).alias("bboxes"))
    return pages.select(F.concat(F.lit("po_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), (F.col("part") + 1).alias("pageNumber"), F.lit("purchase_order").alias("class"), "bboxes")


@query("src_labels_v1", "SELECT concat('po_', CAST(doc_id AS VARCHAR), '.pdf') AS file_name, 1 AS page_number, 'purchase_order' AS doc_class, row_number() OVER (PARTITION BY doc_id ORDER BY entity_seq) AS entity_seq, x, y, width, height, label, text, CAST(line_no AS VARCHAR) AS group_id, ocr_original, ocr_confidence, was_corrected FROM po_entities")
def src_labels_v1(spark, d):
    path = folder(spark, d, "labels_v1")
    WR.json(flat_pages(spark, d), path)
    return RD.labels_v1(spark, path, None, multiline=False).drop("file")


@query("src_labels_v2", f"""SELECT concat('po_', CAST(doc_id AS VARCHAR)) AS file_name, 1 AS page_number, 'purchase_order' AS document_type, {RN} AS entity_seq, format('ent_{{:03d}}', {RN} - 1) AS entity_id, label, text, x, y, width, height, ocr_original, ocr_confidence,
 text AS corrected_value, was_corrected FROM po_entities WHERE doc_id NOT IN (SELECT doc_id FROM po_entities GROUP BY doc_id HAVING round(avg(ocr_confidence), 6) < 0.7E0)""")
def src_labels_v2(spark, d):
    path = folder(spark, d, "labels_v2")
    docs = V.page_documents(V.entity_rows(entities(spark, d)))
    meta = F.struct(F.concat(F.lit("po_"), F.col("doc_id").cast("string")).alias("filename"), F.col("page_number").alias("pageNumber"), F.lit("purchase_order").alias("document_type"))
    version = F.when(F.round("overall_confidence", 6) < 0.7, "1.0").otherwise(F.col("annotation_version"))
    WR.json(docs.select(version.alias("annotation_version"), meta.alias("document_metadata"), "entities"), path)
    return RD.labels_v2(spark, path, None, multiline=False).drop("file")


@query("src_annotations_grouped", """SELECT concat('po_', CAST(doc_id AS VARCHAR)) AS file_name, 'purchase_order' AS doc_class, format('item_{:05d}', line_no) AS group_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS item_pos,
 row_number() OVER (PARTITION BY doc_id, line_no ORDER BY entity_seq) - 1 AS pos, label, text, x, y, width, height FROM po_entities""")
def src_annotations_grouped(spark, d):
    path = folder(spark, d, "grouped")
    groups = V.nested_groups(entities(spark, d))
    item = F.struct(F.format_string("item_%05d", "line_no").alias("group_id"), "labels")
    pages = groups.groupBy("doc_id", F.expr("line_no div 1000").alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    WR.json(pages.select(F.concat(F.lit("po_"), F.col("doc_id").cast("string")).alias("file_name"), F.lit("purchase_order").alias("class"), "items"), path)
    return RD.annotations_grouped(spark, path, None, multiline=False).drop("file")


@query("src_annotations_regions", """SELECT concat('po_', CAST(doc_id AS VARCHAR)) AS file_name, 'purchase_order' AS document_type, CAST(1 AS BIGINT) AS page_number,
 row_number() OVER (PARTITION BY doc_id ORDER BY entity_seq) - 1 AS pos, label, text, ocr_confidence AS confidence, x, y, width, height FROM po_entities""")
def src_annotations_regions(spark, d):
    """The layout with pages and regions, written a page to a line and read back a region to a row."""
    path = folder(spark, d, "regions")
    region = F.struct("entity_seq", "label", "text", F.array("x", "y", "width", "height").alias("bbox"), F.col("ocr_confidence").alias("confidence"))
    pages = entities(spark, d).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    one = F.array(F.struct(F.col("page_number").cast("long").alias("page_number"), "regions"))
    WR.json(pages.select(F.concat(F.lit("po_"), F.col("doc_id").cast("string")).alias("file_name"), F.lit("purchase_order").alias("document_type"), one.alias("pages")), path)
    return RD.annotations_regions(spark, path, None, multiline=False).drop("file")


@query("snk_coco_categories", f"""WITH c AS (SELECT {TYPE_CASE} AS name, count(*) AS n FROM po_entities GROUP BY 1),
v(id, name) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(WR.CATEGORIES, 1))}) SELECT id, name, coalesce(n, 0) AS annotations FROM v LEFT JOIN c USING (name)""")
def snk_coco_categories(spark, d):
    """The category list that goes with the annotations, with how many annotations each has."""
    return WR.coco_categories(snk_coco(spark, d))


@query("src_jsonl", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang <> 'de'")
def src_jsonl(spark, d):
    path = folder(spark, d, "samples")
    rows = table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "lang", "source", "n_chars")).alias("value"), "lang")
    broken = rows.select(F.when(F.col("lang") == "de", F.concat(F.lit("{broken "), F.col("value"))).otherwise(F.col("value")).alias("value"))
    broken.write.mode("overwrite").text(path)
    return RD.jsonl(spark, path, "doc_id bigint, lang string, source string, n_chars bigint")


@query("src_csv_stats", "SELECT label, count(*) AS n, count(*) FILTER (was_corrected) AS corrected, CAST(r.run AS INT) AS run FROM po_entities, (VALUES (1), (2)) r(run) GROUP BY label, r.run")
def src_csv_stats(spark, d):
    path = folder(spark, d, "stats")
    stats = entities(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if("was_corrected").alias("corrected"))
    stats.limit(0).write.mode("overwrite").option("header", "true").csv(path)
    for run in (1, 2):
        WR.append_stats(stats.withColumn("run", F.lit(run)), path)
    return spark.read.schema("label string, n bigint, corrected bigint, run int").option("header", "true").csv(path)


FILE_IDS = 512  # document ids to a file: a large source is many files, written, listed and hashed each on its own


@query("src_file_catalog", f"""SELECT concat('source=', source, '/bucket=', CAST(doc_id // {FILE_IDS} AS VARCHAR)) AS folder, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS size, 'unknown' AS kind,
 md5(string_agg(concat(coalesce(text, ''), chr(10)), '' ORDER BY doc_id)) AS hash FROM documents GROUP BY source, doc_id // {FILE_IDS}""")
def src_file_catalog(spark, d):
    """The documents as text files per source and stretch of ids, listed with the hash of the content; other names are not listed."""
    path = folder(spark, d, "catalog")
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("bucket", F.expr(f"doc_id div {FILE_IDS}"))
    docs.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "doc_id").select("text", "source", "bucket").write.mode("overwrite").partitionBy("source", "bucket").text(path)
    files = RD.file_catalog(spark, path, [".txt"], hashed=True, glob="part-*")
    return files.select(F.array_join(F.slice(F.split("path", "/"), -3, 2), "/").alias("folder"), "size", "kind", "hash")


def export_rows(spark, d):
    return entities(spark, d).select("doc_id", "page_number", "entity_seq", F.col("label").alias("field_name"), "text", "x", "y", "width", "height", F.col("ocr_confidence").alias("confidence"))


EXPORT = "doc_id bigint, page_number int, entity_seq bigint, field_name string, text string, x bigint, y bigint, width bigint, height bigint, confidence double"
EXPORT_SQL = "SELECT doc_id, page_number, entity_seq, label AS field_name, text, x, y, width, height, ocr_confidence AS confidence FROM po_entities"


@query("snk_json", EXPORT_SQL)
def snk_json(spark, d):
    path = folder(spark, d, "export_json")
    WR.json(export_rows(spark, d), path)
    return spark.read.schema(EXPORT).json(path)


@query("snk_csv", EXPORT_SQL)
def snk_csv(spark, d):
    path = folder(spark, d, "export_csv")
    WR.csv(export_rows(spark, d), path)
    return spark.read.schema(EXPORT).option("header", "true").csv(path)


@query("snk_xml", EXPORT_SQL)
def snk_xml(spark, d):
    path = folder(spark, d, "export_xml")
    WR.xml(export_rows(spark, d), path)
    return spark.read.schema(EXPORT).format("xml").option("rowTag", "annotation").load(path)


@query("snk_annotations", "SELECT count(*) AS count, '1.0' AS version FROM po_entities")
def snk_annotations(spark, d):
    path = folder(spark, d, "annotations_out")
    WR.annotations(export_rows(spark, d), path, "2024-01-01T00:00:00")
    return spark.read.schema("created string, count bigint, version string").json(f"{path}/info").select("count", "version")


@query("src_annotations", EXPORT_SQL)
def src_annotations(spark, d):
    path = folder(spark, d, "annotations_in")
    WR.annotations(export_rows(spark, d), path, "2024-01-01T00:00:00")
    return RD.annotations(spark, path, EXPORT)


@query("append_annotation_fields", "SELECT doc_id, entity_seq, label AS field_name, ocr_confidence AS confidence_score FROM po_entities UNION ALL SELECT doc_id, entity_seq + 100000, 'Remark', 1.0E0 FROM po_entities WHERE label = 'Order number'")
def append_annotation_fields(spark, d):
    path = folder(spark, d, "fields")
    base = quality_fields(spark, d)
    base.write.mode("overwrite").parquet(path)
    asked = entities(spark, d).filter("label = 'Order number'").select("doc_id", "page_number", F.array(F.struct((F.col("entity_seq") + 100000).alias("entity_seq"), F.lit("Remark").alias("field_name"), F.col("text").alias("text_value"))).alias("fields"))
    rows = asked.select("doc_id", "page_number", F.inline("fields"))
    full = rows.select("*", *[F.lit(v).cast("long").alias(c) for c, v in (("x", 0), ("y", 0), ("width", 100), ("height", 30))], F.lit(1.0).alias("confidence_score"), F.lit("text").alias("field_type"), F.lit(False).alias("is_valid"), F.lit(1.0).alias("quality"))
    good = Q.validate_field(full).filter("is_valid").select(base.columns)
    good.write.mode("append").parquet(path)
    return spark.read.schema(base.schema).parquet(path).select("doc_id", "entity_seq", "field_name", "confidence_score")


@query("snk_group_json", f"WITH {PARTS_SQL} SELECT type, count(*) AS groups FROM (SELECT DISTINCT doc_id, group_id, type FROM g) GROUP BY type")
def snk_group_json(spark, d):
    from ..operators.grouping import part_number_groups

    path = folder(spark, d, "group_pages")
    groups = part_number_groups(entities(spark, d))
    label = F.struct("entity_seq", "label", "text", F.array("x", "y", "width", "height").alias("bbox"))
    nested = groups.groupBy("doc_id", "group_id", "type", F.expr("entity_seq div 10000").alias("part")).agg(F.array_sort(F.collect_list(label)).alias("labels"), F.max("item_number").alias("item_number"))
    nested = cut(nested)  # written twice
    for version in ("1", "2"):
        WR.group_pages(nested, path, version)
    return spark.read.schema("doc_id bigint, group_id string, type string, item_number string, version int").json(path).filter("version = 2").groupBy("type").agg(F.count("*").alias("groups"))
