"""Aggregations, rankings, running figures and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping as G, layout as L, positions as P, ranking as K, rules as RU, sequences as SQ, sets as ST, stats as S
from ..scale import beside
from .fixture import DOC_TYPE_SQL, doc_type, entities, table
from .q_grouping import ROWS20, chain_sql
from .q_joins import RANGES_SQL
from .registry import query

KEY = ["doc_id", "entity_seq"]


def typed(spark, d):
    return entities(spark, d).withColumn("doc_type", doc_type())


@query("label_distribution", f"SELECT {DOC_TYPE_SQL} AS doc_type, label, count(*) AS n FROM po_entities GROUP BY ALL")
def label_distribution(spark, d):
    return S.label_distribution(typed(spark, d), "doc_type", "label")


@query("label_cube", f"""WITH t AS (SELECT {DOC_TYPE_SQL} AS doc_type, label, CASE WHEN was_corrected THEN 'corrected' ELSE 'original' END AS status FROM po_entities)
SELECT label, status, doc_type, count(*) AS n, grouping(label, status, doc_type) AS level FROM t GROUP BY GROUPING SETS ((label), (status), (doc_type), ())""")
def label_cube(spark, d):
    e = typed(spark, d).withColumn("status", F.when(F.col("was_corrected"), "corrected").otherwise("original"))
    return S.label_cube(e, ["label", "status", "doc_type"])


@query("decimals_mode", f"""WITH t AS (SELECT {DOC_TYPE_SQL} AS doc_type, length(regexp_extract(text, '\\.([0-9]+)', 1)) AS dec FROM po_entities WHERE label = 'Quantity' AND ocr_confidence > 0.9E0),
c AS (SELECT doc_type, dec, count(*) AS n FROM t WHERE dec > 0 GROUP BY ALL) SELECT doc_type, arg_max(dec, n * 100 - dec) AS decimals, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY doc_type""")
def decimals_mode(spark, d):
    return S.decimals_mode(typed(spark, d)).withColumn("decimals", F.col("decimals").cast("long"))


@query("date_format_vote", f"""WITH t AS (SELECT {DOC_TYPE_SQL} AS doc_type, text FROM po_entities WHERE label = 'Delivery date' AND ocr_confidence > 0.9E0)
SELECT doc_type, CASE WHEN bool_and(regexp_matches(text, '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}')) THEN 'MM-DD-YYYY' WHEN bool_and(regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) THEN 'YYYY-MM-DD'
 WHEN bool_and(regexp_matches(text, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')) THEN 'MM/DD/YYYY' END AS format, count(*) AS n FROM t GROUP BY doc_type""")
def date_format_vote(spark, d):
    return S.date_format_vote(typed(spark, d))


SEQ_SQL = f"""{ROWS20},
sq AS (SELECT r.doc_id, row_no, string_agg(e.label, ' > ' ORDER BY e.x, e.y, e.entity_seq) AS sequence, count(*) AS boxes FROM r20 r JOIN po_entities e USING (doc_id, entity_seq) GROUP BY r.doc_id, row_no HAVING count(*) > 1),
ls AS (SELECT sequence, boxes, count(*) AS n FROM sq GROUP BY ALL)"""


@query("label_sequences", f"WITH {SEQ_SQL} SELECT sequence, boxes, n, (SELECT count(DISTINCT doc_id) FROM po_entities) AS pages, n >= (SELECT count(DISTINCT doc_id) FROM po_entities) * 0.3 AS frequent FROM ls")
def label_sequences(spark, d):
    return SQ.label_sequences(entities(spark, d))


@query("predict_relations", f"""WITH {SEQ_SQL}, bst AS (SELECT boxes, sequence, n, row_number() OVER (PARTITION BY boxes ORDER BY n DESC, sequence DESC) AS rn FROM ls)
SELECT doc_id, row_no, bst.sequence AS predicted, least(bst.n / 10, 1.0E0) AS confidence FROM sq JOIN bst ON sq.boxes = bst.boxes AND rn = 1""")
def predict_relations(spark, d):
    return SQ.predict_own_sequences(entities(spark, d)).drop("page_number")


@query("cooccurrence", """WITH b AS (SELECT doc_id, CAST(floor((y + height / 2) / 30) AS BIGINT) AS bin, entity_seq, label FROM po_entities)
SELECT label, other, count(*) AS rows FROM (SELECT DISTINCT a.doc_id, a.bin, a.label, b.label AS other FROM b a JOIN b ON a.doc_id = b.doc_id AND a.bin = b.bin AND a.entity_seq <> b.entity_seq) GROUP BY label, other""")
def cooccurrence(spark, d):
    return SQ.cooccurrence(entities(spark, d))


@query("text_patterns", """
WITH g AS (SELECT label, count(*) AS n, min(text) AS a, max(text) AS b, min(reverse(text)) AS c, max(reverse(text)) AS e, avg(length(text)) AS length_mean, stddev_pop(length(text)) AS length_std,
  concat_ws(',', CASE WHEN count(*) FILTER (regexp_matches(text, '^[0-9]+$')) > count(*) * 0.5 THEN 'numeric' END, CASE WHEN count(*) FILTER (regexp_matches(text, '^[A-Z0-9]+$')) > count(*) * 0.5 THEN 'alphanumeric' END,
   CASE WHEN count(*) FILTER (regexp_matches(text, '^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}')) > count(*) * 0.5 THEN 'date' END) AS patterns FROM po_entities GROUP BY label),
p AS (SELECT *, substring(a, 1, CAST(coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, 1, i) = substring(b, 1, i))), 0) AS INT)) AS pre,
  reverse(substring(c, 1, CAST(coalesce(list_max(list_filter(range(1, least(length(c), length(e)) + 1), lambda i: substring(c, 1, i) = substring(e, 1, i))), 0) AS INT))) AS suf FROM g)
SELECT label, patterns, round(length_mean, 6) AS length_mean, round(length_std, 6) AS length_std, n, CASE WHEN n > 3 AND length(pre) > 2 THEN pre END AS prefix, CASE WHEN n > 3 AND length(suf) > 2 THEN suf END AS suffix FROM p""")
def text_patterns(spark, d):
    return SQ.text_patterns(entities(spark, d)).withColumn("length_mean", F.round("length_mean", 6)).withColumn("length_std", F.round("length_std", 6))


@query("document_statistics", """
WITH p AS (SELECT trim(text) AS t, lang, (n_chars % 100) / 100 AS q, doc_id % 7 = 0 AS noise, doc_id % 5 AS errors FROM documents),
l AS (SELECT lang, count(*) AS n FROM p WHERE lang IS NOT NULL GROUP BY lang)
SELECT count(*) AS total_pages, CAST(sum(length(t)) AS BIGINT) AS total_text_length, count(*) FILTER (length(t) = 0) AS blank_pages, round(avg(q) FILTER (q > 0), 8) AS avg_quality, min(q) FILTER (q > 0) AS min_quality,
 max(q) FILTER (q > 0) AS max_quality, count(*) FILTER (noise) AS pages_with_noise, count(*) FILTER (errors > 0) AS pages_with_errors, CAST(sum(errors) AS BIGINT) AS total_errors,
 (SELECT lang FROM l ORDER BY n DESC, lang DESC LIMIT 1) AS primary_language, (SELECT count(*) FROM l) AS languages FROM p""")
def document_statistics(spark, d):
    docs = table(spark, d, "documents").select("text", "lang", ((F.col("n_chars") % 100) / 100).alias("quality"), (F.col("doc_id") % 7 == 0).alias("noise"), (F.col("doc_id") % 5).alias("errors"))
    return S.document_statistics(docs).withColumn("avg_quality", F.round("avg_quality", 8))


@query("box_statistics", """SELECT doc_id, """ + ", ".join(
    f"round({f}({c}), 7) AS {n}_{k}" for c, n in (("width", "width"), ("height", "height"), ("width * height", "area"), ("ocr_confidence", "confidence"))
    for f, k in (("avg", "mean"), ("stddev_pop", "std"))) + ", " + ", ".join(
    f"{f}({c}) AS {n}_{f}" for c, n in (("width", "width"), ("height", "height"), ("width * height", "area"), ("ocr_confidence", "confidence")) for f in ("min", "max")) + " FROM po_entities GROUP BY doc_id")
def box_statistics(spark, d):
    s = S.box_statistics(entities(spark, d)).drop("page_number")
    for n in ("width", "height", "area", "confidence"):
        s = s.withColumn(f"{n}_mean", F.round(f"{n}_mean", 7)).withColumn(f"{n}_std", F.round(f"{n}_std", 7))
    return s


@query("document_text", "SELECT conv_id, string_agg(text, '\n\n' ORDER BY turn) AS full_text, count(*) AS pages FROM conversations GROUP BY conv_id")
def document_text(spark, d):
    return S.document_text(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("processing_summary", """SELECT user_id, count(*) AS operations, count(*) FILTER (event_type = 'view') AS pages, count(*) FILTER (event_type = 'click') AS annotations,
 count(*) FILTER (event_type = 'error') AS errors, max(ts) AS last_time FROM events GROUP BY user_id""")
def processing_summary(spark, d):
    op = F.when(F.col("event_type") == "view", "page").when(F.col("event_type") == "click", "annotation").otherwise(F.col("event_type"))
    return S.processing_summary(table(spark, d, "events").select("user_id", op.alias("operation"), "ts"), "user_id")


@query("collection_statistics", """WITH k AS (SELECT CASE WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.(png|jpg|jpeg|tiff|tif|bmp)$') THEN 'image' ELSE 'unknown' END AS kind, length(html) AS n FROM pages)
SELECT kind, count(*) AS files, CAST(sum(n) AS BIGINT) AS total_size, count(*) FILTER (n = 0) AS errors FROM k GROUP BY kind""")
def collection_statistics(spark, d):
    from ..functions.text import file_kind

    size = F.length("html")
    return table(spark, d, "pages").groupBy(file_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("files"), F.sum(size).alias("total_size"), F.count_if(size == 0).alias("errors"))


@query("training_readiness", """SELECT source, count(*) AS samples, count(*) >= 10 AS enough_for_rules, count(*) >= 50 AS enough_for_models, CASE WHEN count(*) < 10 THEN 'insufficient_data' ELSE 'success' END AS status FROM documents GROUP BY source""")
def training_readiness(spark, d):
    return S.training_readiness(table(spark, d, "documents"))


@query("difficulty", f"""WITH {ROWS20}, g AS (SELECT doc_id, count(DISTINCT row_no) AS grp FROM r20 GROUP BY doc_id),
b AS (SELECT doc_id, count(*) FILTER (was_corrected) AS c, avg(ocr_confidence) AS m FROM po_entities GROUP BY doc_id)
SELECT doc_id, round(least(c * 0.1E0 + (1 - m) * 0.5E0 + least(grp * 0.1E0, 0.3E0), 1.0E0), 9) AS difficulty FROM b JOIN g USING (doc_id)""")
def difficulty(spark, d):
    e = entities(spark, d)
    groups = G.band_groups(e).groupBy("doc_id", "page_number").agg(F.max("row_no").alias("groups"))
    return S.difficulty(e, groups).select("doc_id", F.round("difficulty", 9).alias("difficulty"))


PAGES_SQL = """
pgs AS (SELECT doc_id, 1 AS page_number, count(*) AS fields, count(*) FILTER (NOT was_corrected) AS valid, avg(ocr_confidence) AS confidence, avg(1 - (entity_seq % 10) / 20.0E0) AS quality FROM po_entities GROUP BY doc_id),
dcs AS (SELECT doc_id, count(*) AS pages, CAST(sum(fields) AS BIGINT) AS fields, CAST(sum(valid) AS BIGINT) AS valid, sum(valid) / sum(fields) AS rate FROM pgs GROUP BY doc_id),
dst AS (SELECT *, CASE WHEN rate >= 1 THEN 'completed' WHEN rate >= 0.5 THEN 'in_progress' ELSE 'pending' END AS status FROM dcs)"""


def page_rows(spark, d):
    return S.page_scores(entities(spark, d).withColumn("quality", 1 - (F.col("entity_seq") % 10) / F.lit(20.0)).withColumn("is_valid", ~F.col("was_corrected")))


@query("page_scores", f"WITH {PAGES_SQL} SELECT doc_id, fields, valid, round(confidence, 10) AS confidence, round(quality, 10) AS quality, round(valid / fields * 100, 8) AS completion FROM pgs")
def page_scores(spark, d):
    p = page_rows(spark, d).drop("page_number")
    return p.withColumn("confidence", F.round("confidence", 10)).withColumn("quality", F.round("quality", 10)).withColumn("completion", F.round("completion", 8))


@query("doc_completion", f"WITH {PAGES_SQL} SELECT doc_id, pages, fields, valid, round(rate, 8) AS rate, status FROM dst")
def doc_completion(spark, d):
    return S.doc_completion(page_rows(spark, d)).withColumn("rate", F.round("rate", 8))


@query("collection_rate", f"WITH {PAGES_SQL} SELECT count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(fields) AS BIGINT) AS annotations, round(count(*) FILTER (status = 'completed') / count(*), 8) AS completion_rate FROM dst")
def collection_rate(spark, d):
    return S.collection_rate(S.doc_completion(page_rows(spark, d))).withColumn("completion_rate", F.round("completion_rate", 8))


@query("coverage", "SELECT doc_id, round(least(sum(width * height) / (595 * 842), 1.0E0), 8) AS coverage FROM po_entities GROUP BY doc_id")
def coverage(spark, d):
    return S.coverage(entities(spark, d)).select("doc_id", F.round("coverage", 8).alias("coverage"))


@query("mapping_confidence", """WITH m AS (SELECT doc_id, label, CASE WHEN was_corrected THEN NULL ELSE ocr_confidence END AS c FROM po_entities)
SELECT doc_id, round(least(0.7E0 * avg(coalesce(c, 0.5E0)) + 0.3E0 * count(DISTINCT CASE WHEN label IN ('Order number', 'Shipping line', 'Quantity', 'Net amount (total)') THEN label END) / 4, 1.0E0), 9) AS confidence FROM m GROUP BY doc_id""")
def mapping_confidence(spark, d):
    m = entities(spark, d).select("doc_id", "page_number", F.col("label").alias("field"), F.when(~F.col("was_corrected"), F.col("ocr_confidence")).alias("confidence"))
    return S.mapping_confidence(m, ["Order number", "Shipping line", "Quantity", "Net amount (total)"]).select("doc_id", F.round("confidence", 9).alias("confidence"))


@query("daily_processing", """SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS kinds, round(count(*) * 100 / (SELECT count(*) FROM events), 8) AS percent FROM events GROUP BY ALL""")
def daily_processing(spark, d):
    ev = table(spark, d, "events")
    total = ev.agg(F.count("*").alias("t"))
    return S.daily(ev, "ts", "event_type").transform(beside, total).withColumn("percent", F.round(F.col("n") * 100 / F.col("t"), 8)).drop("t")


@query("run_metrics", """SELECT user_id, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed,
 round(count(*) FILTER (event_type <> 'error') * 100 / count(*), 8) AS success_rate, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM events GROUP BY user_id""")
def run_metrics(spark, d):
    ev = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("ok"), F.col("ts").cast("timestamp").alias("ts"))
    return S.run_metrics(ev, "user_id").withColumn("success_rate", F.round("success_rate", 8))


@query("error_category_report", """WITH c AS (SELECT rule AS category, count(*) AS n FROM (SELECT CASE WHEN ocr_original = '' THEN 'empty' WHEN length(ocr_original) > length(text) THEN 'extra' WHEN length(ocr_original) < length(text) THEN 'missing' ELSE 'other' END AS rule FROM po_entities WHERE ocr_original <> text) GROUP BY rule)
SELECT category, n, (SELECT category FROM c ORDER BY n DESC, category DESC LIMIT 1) AS most_common, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total FROM c""")
def error_category_report(spark, d):
    o, t = F.col("ocr_original"), F.col("text")
    kind = F.when(o == "", "empty").when(F.length(o) > F.length(t), "extra").when(F.length(o) < F.length(t), "missing").otherwise("other")
    return S.error_report(entities(spark, d).filter(o != t).select(kind.alias("category")))


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, d):
    return S.label_distribution(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "status")


@query("duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return S.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("structure_flags", "SELECT doc_id, bool_or(y < 3508 * 0.2E0) AS has_header, bool_or(y > 3508 * 0.8E0) AS has_footer, bool_or(label = 'Item number') AS has_table FROM po_entities GROUP BY doc_id")
def structure_flags(spark, d):
    return S.structure_flags(entities(spark, d)).drop("page_number")


@query("page_quality", f"""WITH {chain_sql('ch10', 'y', 'y', 'g >= 10')}, {chain_sql('cx10', 'x', 'x', 'g >= 10')}, {chain_sql('ax', 'x', 'x', 'g >= 5')}, {chain_sql('ay', 'y', 'y', 'g >= 5')},
rw AS (SELECT doc_id, var_pop(m) AS vh FROM (SELECT doc_id, avg(height) AS m FROM ch10 GROUP BY doc_id, row_no) GROUP BY doc_id),
cw AS (SELECT doc_id, var_pop(m) AS vw FROM (SELECT doc_id, avg(width) AS m FROM cx10 GROUP BY doc_id, row_no) GROUP BY doc_id),
hx AS (SELECT doc_id, CASE WHEN sum(n) < 2 THEN 0 ELSE max(n) / sum(n) END AS h FROM (SELECT doc_id, count(*) AS n FROM ax GROUP BY doc_id, row_no) GROUP BY doc_id),
hy AS (SELECT doc_id, CASE WHEN sum(n) < 2 THEN 0 ELSE max(n) / sum(n) END AS v FROM (SELECT doc_id, count(*) AS n FROM ay GROUP BY doc_id, row_no) GROUP BY doc_id),
b AS (SELECT doc_id, avg(ocr_confidence) AS oc, count(*) FILTER (was_corrected) / count(*) AS cr, count(*) / 10 AS cp FROM po_entities GROUP BY doc_id)
SELECT doc_id, round(oc, 8) AS overall_confidence, round(cr, 8) AS correction_rate, round(cp, 8) AS completeness, round((1 / (1 + vh + vw) + (h + v) / 2) / 2, 8) AS layout_quality,
 round((oc + cr + cp + (1 / (1 + vh + vw) + (h + v) / 2) / 2) / 4, 8) AS overall_quality FROM b JOIN rw USING (doc_id) JOIN cw USING (doc_id) JOIN hx USING (doc_id) JOIN hy USING (doc_id)""")
def page_quality(spark, d):
    q = L.page_quality(entities(spark, d)).drop("page_number")
    for c in q.columns[1:]:
        q = q.withColumn(c, F.round(c, 8))
    return q


# --- rankings ------------------------------------------------------------------------------------------------------

IMP = "('Order number', 'Shipping line', 'Case mark', 'Item number', 'Part number', 'Delivery date', 'Quantity', 'Unit price', 'Net amount (total)')"


def predictions(spark, d):
    """Labels of the boxes with the OCR confidence as prediction confidence; part of them unknown."""
    label = F.when(F.col("entity_seq") % 11 == 0, "unknown").otherwise(F.col("label"))
    return entities(spark, d).withColumn("label", label).withColumn("confidence", F.col("ocr_confidence"))


PRED_SQL = "pred AS (SELECT doc_id, entity_seq, CASE WHEN entity_seq % 11 = 0 THEN 'unknown' ELSE label END AS label, x, y, ocr_confidence AS confidence FROM po_entities)"


@query("filter_important", f"WITH {PRED_SQL} SELECT doc_id, entity_seq, label, confidence FROM pred WHERE (label IN {IMP} AND confidence > 0.3E0) OR confidence > 0.7E0")
def filter_important(spark, d):
    c = F.col("confidence")
    return predictions(spark, d).filter((F.col("label").isin(K.IMPORTANT) & (c > 0.3)) | (c > 0.7)).select(*KEY, "label", "confidence")


@query("suggest_topk", f"""WITH {PRED_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, CAST(floor(x / 20) AS BIGINT), CAST(floor(y / 20) AS BIGINT) ORDER BY entity_seq) AS r1 FROM pred WHERE (label IN {IMP} AND confidence > 0.3E0) OR confidence > 0.7E0),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY confidence DESC, entity_seq) AS label_rank FROM a WHERE r1 = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, entity_seq) AS rank FROM b WHERE label_rank <= 2)
SELECT doc_id, entity_seq, label, confidence, label_rank, rank FROM c WHERE rank <= 10""")
def suggest_topk(spark, d):
    return K.suggest_topk(predictions(spark, d)).select(*KEY, "label", "confidence", F.col("label_rank").cast("long").alias("label_rank"), F.col("rank").cast("long").alias("rank"))


@query("suggest_top30", f"""WITH {PRED_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, y, x, entity_seq) AS rank FROM pred WHERE confidence >= 0.5E0 AND label <> 'unknown' AND (label IN {IMP} OR confidence > 0.8E0))
SELECT doc_id, entity_seq, label, confidence, rank FROM c WHERE rank <= 30""")
def suggest_top30(spark, d):
    return K.suggest_top(predictions(spark, d)).select(*KEY, "label", "confidence", F.col("rank").cast("long").alias("rank"))


@query("suggest_label_rules", """
WITH r AS (SELECT doc_id, entity_seq, y, text, lower(trim(text)) AS l FROM po_entities),
hl AS (SELECT doc_id, entity_seq, 0 AS i, 'Order number' AS label, 0.9E0 AS c FROM r WHERE regexp_matches(text, '^[0-9]{10}$')
 UNION ALL SELECT doc_id, entity_seq, 1, 'Part number', 0.85E0 FROM r WHERE regexp_matches(text, '^[A-Z][0-9]+[A-Z]*(-[0-9]+)?$')
 UNION ALL SELECT doc_id, entity_seq, 2, 'Delivery date', 0.95E0 FROM r WHERE regexp_matches(text, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$')
 UNION ALL SELECT doc_id, entity_seq, 3, 'Quantity', 0.9E0 FROM r WHERE regexp_matches(text, '^[0-9]+\\.[0-9]{3}\\s*(ST|PC|EA)?$')
 UNION ALL SELECT doc_id, entity_seq, 4, 'Unit price', 0.85E0 FROM r WHERE regexp_matches(text, '^[0-9]+\\.[0-9]{4}$')
 UNION ALL SELECT doc_id, entity_seq, 5, 'Net amount (total)', 0.95E0 FROM r WHERE position('total' IN l) > 0
 UNION ALL SELECT doc_id, entity_seq, 6, 'Net amount', 0.8E0 FROM r WHERE position('total' IN l) = 0 AND regexp_matches(text, '^[0-9]+\\.[0-9]{2}$')
 UNION ALL SELECT doc_id, entity_seq, 7, 'Shipping line', 0.95E0 FROM r WHERE regexp_matches(text, '^C[0-9]{7}$')
 UNION ALL SELECT doc_id, entity_seq, 8, 'Case mark', 0.9E0 FROM r WHERE regexp_matches(l, '(ymg|kofu|ishikawa)')
 UNION ALL SELECT doc_id, entity_seq, 9, 'Item number', 0.9E0 FROM r WHERE regexp_matches(text, '^000[0-9]{2}$')),
w AS (SELECT * FROM hl UNION ALL SELECT doc_id, entity_seq, 0, CASE WHEN y < 200 THEN 'Order number' WHEN y > 1500 THEN 'Net amount (total)' ELSE 'Part number' END,
  CASE WHEN y < 200 THEN 0.5E0 WHEN y > 1500 THEN 0.4E0 ELSE 0.3E0 END FROM r ANTI JOIN hl USING (doc_id, entity_seq))
SELECT doc_id, entity_seq, label, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_seq ORDER BY c DESC, i) AS rn FROM w) WHERE rn <= 3""")
def suggest_label_rules(spark, d):
    return entities(spark, d).select(*KEY, F.inline(K.label_rules(F.col("text"), F.col("y"))))


PROB_SQL = f"""{RANGES_SQL}, pb AS (SELECT doc_id, entity_seq, label, score / sum(score) OVER (PARTITION BY doc_id, entity_seq) AS p FROM sc WHERE score > 0)"""


def label_probs(spark, d, every=False, **also):
    e = typed(spark, d)
    return P.label_probabilities(e, P.position_ranges(e.filter("was_corrected"), ["doc_type", "label"]), also=also, every=every)


@query("alternatives", f"""WITH {PROB_SQL} SELECT doc_id, entity_seq, label, round(p, 8) AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_seq ORDER BY p DESC, label) AS rn FROM pb) WHERE rn BETWEEN 2 AND 4 AND p > 0.1E0""")
def alternatives(spark, d):
    return label_probs(spark, d).select(*KEY, F.inline(K.alternatives(F.col("probs")))).withColumn("p", F.round("p", 8))


@query("active_learning_topk", f"""WITH {PROB_SQL}, en AS (SELECT doc_id, entity_seq, -sum(p * ln(p + 1e-10)) AS h FROM pb GROUP BY ALL),
u AS (SELECT e.doc_id, e.entity_seq, round((1 - ocr_confidence) * 0.5E0 + h * 0.5E0, 9) AS uncertainty FROM po_entities e JOIN en USING (doc_id, entity_seq))
SELECT * FROM u ORDER BY uncertainty DESC, doc_id, entity_seq LIMIT 10""")
def active_learning_topk(spark, d):
    return K.active_learning(label_probs(spark, d, entropy=K.entropy).withColumn("confidence", F.col("ocr_confidence"))).select(*KEY, "uncertainty")


@query("reading_order", "SELECT doc_id, entity_seq, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, entity_seq) AS place FROM po_entities")
def reading_order(spark, d):
    return K.reading_order(entities(spark, d).select("doc_id", "page_number", "entity_seq", "x", "y")).select(*KEY, "place")


HIST_SQL = "hist AS (SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS score_cents, value >= 20 AS passed FROM events)"


def history(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("score_cents"), (F.col("value") >= 20).alias("passed"))


@query("running_mean_quality", f"""WITH {HIST_SQL} SELECT event_id, count(*) OVER w AS validations, count(*) FILTER (passed) OVER w AS passed_total, count(*) FILTER (NOT passed) OVER w AS failed_total,
 round(CAST(sum(score_cents) OVER w AS DOUBLE) / count(*) OVER w / 100, 6) AS mean_score FROM hist WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_mean_quality(spark, d):
    return K.running_quality(history(spark, d)).select("event_id", "validations", "passed_total", "failed_total", F.round("mean_score", 6).alias("mean_score"))


@query("quality_trend", f"""WITH {HIST_SQL}, r AS (SELECT * FROM hist ORDER BY ts DESC, event_id DESC LIMIT 10)
SELECT CASE WHEN count(*) < 2 THEN 'insufficient_data' WHEN arg_max(score_cents, ts) > arg_min(score_cents, ts) THEN 'improving' ELSE 'declining' END AS trend, round(avg(score_cents) / 100, 6) AS recent_average,
 min(score_cents) AS low_cents, max(score_cents) AS high_cents, count(*) AS points FROM r""")
def quality_trend(spark, d):
    return K.quality_trend(history(spark, d)).withColumn("recent_average", F.round("recent_average", 6))


@query("recent_files", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_files(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(10)


@query("version_log", "SELECT user_id, event_id, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def version_log(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts"))
    return K.version_log(ev, "user_id").select("user_id", "event_id", "action", "version")


@query("page_sequence_check", "SELECT conv_id, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS consecutive, count(*) AS pages FROM conversations GROUP BY conv_id")
def page_sequence_check(spark, d):
    return K.page_sequence(table(spark, d, "conversations"), "conv_id", "turn", 0)


@query("temporal_sequence", "SELECT doc_id, entity_seq, label, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, entity_seq) - 1 AS place FROM po_entities WHERE label IN ('Delivery date', 'Order number')")
def temporal_sequence(spark, d):
    return K.temporal_sequence(entities(spark, d)).select(*KEY, "label", "place")


# --- filters and sets --------------------------------------------------------------------------------------------------


@query("filter_confidence", "SELECT doc_id, entity_seq, text FROM po_entities WHERE ocr_confidence * 100 > 80 AND trim(ocr_original) <> ''")
def filter_confidence(spark, d):
    return entities(spark, d).filter((F.col("ocr_confidence") * 100 > 80) & (F.trim("ocr_original") != "")).select(*KEY, "text")


@query("filter_status", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_status(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_custkey")


@query("filter_type", f"SELECT doc_id, entity_seq FROM po_entities WHERE {DOC_TYPE_SQL} = 'invoice'")
def filter_type(spark, d):
    return typed(spark, d).filter("doc_type = 'invoice'").select(*KEY)


@query("filter_name", "SELECT doc_id, entity_seq, text FROM po_entities WHERE label = 'Quantity'")
def filter_name(spark, d):
    return entities(spark, d).filter("label = 'Quantity'").select(*KEY, "text")


@query("region_filter", """SELECT doc_id, entity_seq, b.field FROM po_entities e JOIN (VALUES ('order_number', 70, 105), ('case_mark', 1300, 1500), ('shipping_line', 1300, 1500), ('item_number', 1680, 1730), ('part_number', 1690, 1730),
 ('delivery_date', 1790, 1820), ('quantity', 1795, 1820), ('unit_price', 1795, 1820), ('total', 2100, 2135)) b(field, lo, hi) ON e.y BETWEEN lo AND hi""")
def region_filter(spark, d):
    return G.in_bands(entities(spark, d)).select(*KEY, "field")


@query("integrity_filter", """WITH f AS (SELECT doc_id, source, n_chars, md5(text) AS h FROM documents), x AS (SELECT min(doc_id) AS doc_id, h FROM f GROUP BY h)
SELECT f.doc_id, n_chars FROM f JOIN x ON f.doc_id = x.doc_id AND f.h = x.h WHERE n_chars BETWEEN 1 AND 5000""")
def integrity_filter(spark, d):
    from ..sources.readers import integrity

    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.md5("text").alias("hash"))
    expected = docs.groupBy(F.col("hash").alias("expected")).agg(F.min("doc_id").alias("doc_id"))
    return integrity(docs, expected, "doc_id", "n_chars", 5000).select("doc_id", "n_chars")


@query("augment_union", """SELECT doc_id, entity_seq, x, CAST(NULL AS INT) AS angle FROM po_entities UNION ALL SELECT doc_id, entity_seq, x + 5, 90 FROM po_entities WHERE label = 'Quantity'""")
def augment_union(spark, d):
    e = entities(spark, d).select(*KEY, "x")
    made = entities(spark, d).filter("label = 'Quantity'").select(*KEY, (F.col("x") + 5).alias("x"), F.lit(90).alias("angle"))
    return ST.augment_union(e, made)


EXPECTED = ["Order number", "Shipping line", "Case mark", "Part description", "Item number", "Part number", "Delivery date", "Quantity", "Unit price", "Net amount (total)"]


@query("missing_fields", """WITH x AS (SELECT * FROM (VALUES (1, 'Order number'), (2, 'Net amount (total)'), (3, 'Delivery date'), (4, 'Shipping line'), (5, 'Case mark'), (6, 'Part description'), (7, 'Item number'), (8, 'Part number'), (9, 'Quantity'), (10, 'Unit price')) v(i, label)),
dd AS (SELECT DISTINCT doc_id FROM po_entities), m AS (SELECT doc_id, i, label FROM dd CROSS JOIN x ANTI JOIN po_entities USING (doc_id, label))
SELECT doc_id, string_agg(label, ',' ORDER BY i) AS missing FROM m GROUP BY doc_id""")
def missing_fields(spark, d):
    m = RU.missing_fields(entities(spark, d), EXPECTED, ["Order number", "Net amount (total)", "Delivery date"])
    return m.select("doc_id", F.concat_ws(",", "missing").alias("missing"))


@query("field_overlap", """SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label IN ('Order number', 'Quantity', 'Case mark')), '') AS shared,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label NOT IN ('Order number', 'Quantity', 'Case mark')), '') AS extra FROM po_entities GROUP BY doc_id""")
def field_overlap(spark, d):
    return RU.field_overlap(entities(spark, d), ["Order number", "Quantity", "Case mark"]).drop("page_number")


@query("dedup_text_label", "SELECT doc_id, entity_seq, text, label FROM (SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY doc_id, entity_seq) AS rn FROM po_entities) WHERE rn = 1")
def dedup_text_label(spark, d):
    return ST.dedup_first(entities(spark, d).select(*KEY, "text", "label"), ["text", "label"], KEY)


@query("dedup_files", "WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept, count(*) OVER (PARTITION BY text) AS copies FROM documents) SELECT doc_id, kept, copies FROM h WHERE doc_id <> kept")
def dedup_files(spark, d):
    return ST.exact_copies(table(spark, d, "documents"), "doc_id", "text")


@query("new_rows_only", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def new_rows_only(spark, d):
    done = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ST.new_rows_only(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"]).select("o_orderkey")
