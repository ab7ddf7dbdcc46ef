"""Templates, field mapping and document classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.signature import reading_grid_signature
from ..ml import cluster as MC
from ..operators import layout as L, mapping as MP, stats as S, templates as TP
from ..scale import beside, materialized, parked, table_path
from ..schema import LABELS
from .fixture import DOC_TYPE_SQL, doc_type, entities, table
from .q_columns import GRID_SIG, LABEL_SIG
from .q_grouping import CHAINX, GAP_SQL
from .registry import query

KEY = ["doc_id", "entity_seq"]


def typed(spark, d):
    return entities(spark, d).withColumn("doc_type", doc_type())


def learn_sql(having: str) -> str:
    return f"""{LABEL_SIG},
sd AS (SELECT doc_id, signature, {DOC_TYPE_SQL} AS doc_type FROM sig),
gs AS (SELECT doc_type, signature, count(*) AS samples FROM sd GROUP BY ALL HAVING {having}),
ow AS (SELECT e.*, s.doc_type, s.signature, g.samples FROM po_entities e JOIN sd s USING (doc_id) JOIN gs g USING (doc_type, signature)),
fd AS (SELECT doc_type, signature, samples, label, count(*) AS n, avg(x / 2480) AS xn_mean, stddev_pop(x / 2480) AS xn_std, avg(y / 3508) AS yn_mean, stddev_pop(y / 3508) AS yn_std, avg(width / 2480) AS widthn_mean, avg(height / 3508) AS heightn_mean,
  avg(length(text)) FILTER (text <> '') AS length_mean, count(*) / samples AS share, count(*) FILTER (regexp_matches(text, '^[0-9]+$')) > count(*) * 0.5 AS is_num, count(*) FILTER (regexp_matches(text, '^[A-Z0-9]+$')) > count(*) * 0.5 AS is_aln,
  min(text) AS a, max(text) AS b, min(reverse(text)) AS c, max(reverse(text)) AS e FROM ow GROUP BY doc_type, signature, samples, label HAVING count(*) >= samples * 0.5),
fp AS (SELECT *, share >= 0.8 AS required, substring(a, 1, CAST(coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, 1, i) = substring(b, 1, i))), 0) AS INT)) AS pre,
  reverse(substring(c, 1, CAST(coalesce(list_max(list_filter(range(1, least(length(c), length(e)) + 1), lambda i: substring(c, 1, i) = substring(e, 1, i))), 0) AS INT))) AS suf FROM fd),
tn AS (SELECT doc_type, signature, samples, count(*) AS n_fields, string_agg(label, '>' ORDER BY round(yn_mean, 9), round(xn_mean, 9), label) AS field_order,
  substring(md5(concat(doc_type, '_', signature, '_', CAST(count(*) AS VARCHAR), '_', string_agg(label, '' ORDER BY label))), 1, 12) AS template_id FROM fd GROUP BY doc_type, signature, samples),
ff AS (SELECT fp.*, tn.template_id FROM fp JOIN tn USING (doc_type, signature)),
br AS (SELECT doc_id, CAST(floor((y + height / 2) / 30) AS BIGINT) AS bin, string_agg(label, ' > ' ORDER BY x, y, entity_seq) AS sequence FROM po_entities GROUP BY ALL HAVING count(*) > 1),
rt AS (SELECT tn.template_id, sequence, count(*) AS n FROM br JOIN sd USING (doc_id) JOIN tn USING (doc_type, signature) GROUP BY tn.template_id, sequence, tn.samples HAVING count(*) >= tn.samples * 0.3)"""


LEARN2 = learn_sql("count(*) >= 2")


@query("learn_templates", f"WITH {LEARN2} SELECT template_id, concat(doc_type, '_', signature) AS name, doc_type, signature, samples, n_fields, field_order FROM tn")
def learn_templates(spark, d):
    return known(spark, d).templates.select("template_id", "name", *TP.TKEY, "samples", "n_fields", "field_order")


FIELD_COLS = ["xn_mean", "yn_mean", "widthn_mean", "heightn_mean", "xn_std", "yn_std", "share"]


@query("template_fields", f"WITH {LEARN2} SELECT template_id, label, n, required, " + ", ".join(f"round({c}, 11) AS {c}" for c in FIELD_COLS) + " FROM ff")
def template_fields(spark, d):
    return known(spark, d).fields.select("template_id", "label", "n", "required", *[F.round(c, 11).alias(c) for c in FIELD_COLS])


@query("template_rows", f"WITH {LEARN2} SELECT template_id, sequence, n FROM rt")
def template_rows(spark, d):
    return known(spark, d).rows.select("template_id", "sequence", "n")


@query("template_relations", f"""WITH {LABEL_SIG}, b AS (SELECT doc_id, CAST(floor((y + height / 2) / 30) AS BIGINT) AS bin, entity_seq, label FROM po_entities)
SELECT DISTINCT {DOC_TYPE_SQL.replace('doc_id', 'a.doc_id')} AS doc_type, signature, a.label, b.label AS other FROM b a JOIN b ON a.doc_id = b.doc_id AND a.bin = b.bin AND a.entity_seq <> b.entity_seq JOIN sig ON sig.doc_id = a.doc_id""")
def template_relations(spark, d):
    return TP.template_relations(typed(spark, d))


AREAS_SQL = f"""{LABEL_SIG}, sd AS (SELECT doc_id, signature, {DOC_TYPE_SQL} AS doc_type FROM sig),
fp AS (SELECT *, row_number() OVER (PARTITION BY doc_type, signature ORDER BY doc_id) AS nth FROM sd),
b AS (SELECT doc_id, CAST(floor((y + height / 2) / 50) AS BIGINT) AS bin, count(*) AS n, min(x) AS x0, max(x + width) AS x1, min(y) AS y0, max(y + height) AS y1 FROM po_entities GROUP BY ALL),
j AS (SELECT *, CASE WHEN bin = lag(bin) OVER o + 1 AND abs(n - lag(n) OVER o) <= 1 THEN 0 ELSE 1 END AS brk FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY bin)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM j),
m AS (SELECT *, max(run) OVER (PARTITION BY doc_id) AS last_run FROM r),
tr AS (SELECT doc_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM m WHERE run < last_run GROUP BY doc_id, run HAVING count(*) >= 3),
ta AS (SELECT doc_type, signature, count(*) AS tables, min(x0) AS tx0, min(y0) AS ty0, max(x1) AS tx1, max(y1) AS ty1 FROM tr JOIN fp USING (doc_id) WHERE nth <= 3 GROUP BY doc_type, signature),
ze AS (SELECT fp.doc_type, fp.signature, e.*, CASE WHEN y < 3508 * 0.15E0 THEN 'header' WHEN y > 3508 * 0.85E0 THEN 'footer' END AS zone FROM po_entities e JOIN fp USING (doc_id) WHERE nth = 1),
ed AS (SELECT doc_type, signature, """ + ", ".join(
    f"{f}({v}) FILTER (zone = '{z}') AS {z}_{n}" for z in ("header", "footer") for n, f, v in (("x0", "min", "x"), ("y0", "min", "y"), ("x1", "max", "x + width"), ("y1", "max", "y + height"))) + """ FROM ze GROUP BY doc_type, signature)"""


@query("template_areas", f"WITH {AREAS_SQL} SELECT ed.*, coalesce(tables, 0) AS tables, tx0, ty0, tx1, ty1 FROM ed LEFT JOIN ta USING (doc_type, signature)")
def template_areas(spark, d):
    return TP.template_areas(typed(spark, d))


# Every page against every template of its type: label sets meet templates for the field score, boxes for the others.
MATCH_SQL = f"""{LEARN2},
pt AS (SELECT DISTINCT doc_id, {DOC_TYPE_SQL} AS doc_type FROM po_entities),
pl AS (SELECT DISTINCT doc_id, label FROM po_entities), pn AS (SELECT doc_id, count(*) AS labels FROM pl GROUP BY doc_id),
ls AS (SELECT doc_id, list_sort(list(label)) AS ls FROM pl GROUP BY doc_id), sk AS (SELECT doc_type, ls, row_number() OVER () AS sid FROM (SELECT DISTINCT doc_type, ls FROM ls JOIN pt USING (doc_id))),
ps AS (SELECT doc_id, sid FROM ls JOIN pt USING (doc_id) JOIN sk USING (doc_type, ls)), sl AS (SELECT sid, unnest(ls) AS label, len(ls) AS labels FROM sk),
cd AS (SELECT pt.doc_id, tn.template_id FROM pt JOIN tn USING (doc_type)),
tc AS (SELECT template_id, count(*) AS nall, count(*) FILTER (required) AS nreq FROM ff GROUP BY template_id),
fs AS (SELECT sid, f.template_id, any_value(labels) AS labels, count(*) AS hit, count(*) FILTER (f.required) AS rhit FROM sl JOIN sk USING (sid) JOIN ff f ON f.label = sl.label AND f.doc_type = sk.doc_type GROUP BY ALL),
fsc AS (SELECT ps.doc_id, fs.template_id, (rhit / greatest(nreq, 1) * 0.6E0 + hit / greatest(nall, 1) * 0.4E0) * greatest(0.0E0, 1 - (labels - hit) * 0.05E0) AS field_score FROM fs JOIN tc USING (template_id) JOIN ps USING (sid)),
bx AS (SELECT e.doc_id, c.template_id, (greatest(0.0E0, 1 - abs(x / 2480 - xn_mean) / greatest(xn_std * 3, 0.1E0)) + greatest(0.0E0, 1 - abs(y / 3508 - yn_mean) / greatest(yn_std * 3, 0.1E0))) / 2 AS pos,
  CASE WHEN abs(length(text) - round(length_mean)) < 5 OR (is_num AND regexp_matches(text, '^[0-9]+$')) OR (is_aln AND regexp_matches(text, '^[A-Za-z0-9]+$')) THEN 1.0E0 ELSE 0.0E0 END AS pat
 FROM po_entities e JOIN cd c USING (doc_id) JOIN ff f ON f.template_id = c.template_id AND f.label = e.label),
bs AS (SELECT doc_id, template_id, avg(pos) AS position_score, avg(pat) AS pattern_score FROM bx GROUP BY ALL),
rw AS (SELECT template_id, count(*) AS wanted FROM rt GROUP BY template_id), pr AS (SELECT DISTINCT doc_id, sequence FROM br), hr AS (SELECT DISTINCT doc_id FROM pr),
rh AS (SELECT doc_id, template_id, count(*) AS hits FROM pr JOIN rt USING (sequence) GROUP BY ALL),
tb AS (SELECT doc_id, CAST(floor((y + height / 2) / 50) AS BIGINT) AS bin, count(*) AS n FROM po_entities GROUP BY ALL),
tj AS (SELECT *, CASE WHEN bin = lag(bin) OVER o + 1 AND abs(n - lag(n) OVER o) <= 1 THEN 0 ELSE 1 END AS brk FROM tb WINDOW o AS (PARTITION BY doc_id ORDER BY bin)),
tu AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM tj), tm AS (SELECT *, max(run) OVER (PARTITION BY doc_id) AS last_run FROM tu),
pg AS (SELECT doc_id, count(*) AS tables FROM (SELECT doc_id, run FROM tm WHERE run < last_run GROUP BY doc_id, run HAVING count(*) >= 3) GROUP BY doc_id),
t3 AS (SELECT template_id, sum(tables) AS wanted_tables FROM (SELECT template_id, doc_id, row_number() OVER (PARTITION BY template_id ORDER BY doc_id) AS nth FROM sd JOIN tn USING (doc_type, signature)) JOIN pg USING (doc_id) WHERE nth <= 3 GROUP BY template_id),
st AS (SELECT f.doc_id, f.template_id, field_score, position_score, pattern_score, CASE WHEN wanted_tables > 0 AND tables > 0 THEN least(tables, wanted_tables) / wanted_tables END AS tp,
  CASE WHEN wanted > 0 AND hr.doc_id IS NOT NULL THEN coalesce(hits, 0) / wanted END AS rp FROM fsc f LEFT JOIN bs USING (doc_id, template_id) LEFT JOIN rw USING (template_id) LEFT JOIN rh USING (doc_id, template_id)
  LEFT JOIN hr ON hr.doc_id = f.doc_id LEFT JOIN pg ON pg.doc_id = f.doc_id LEFT JOIN t3 ON t3.template_id = f.template_id),
al AS (SELECT *, coalesce((tp + rp) / 2, tp, rp, 0.5E0) AS structure_score FROM st),
sc AS (SELECT *, round(field_score * 0.4E0 + coalesce(position_score, 0) * 0.3E0 + structure_score * 0.2E0 + coalesce(pattern_score, 0.5E0) * 0.1E0, 9) AS score FROM al),
mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template_id DESC) AS rn FROM sc) WHERE rn = 1 AND score >= 0.7E0)"""


def known(spark, d):
    """Learned templates, written once per application and input folder."""
    built = []

    def part(name):
        if not built:
            built.append(TP.learn(typed(spark, d)))
        return getattr(built[0], name)

    return TP.Templates(*[materialized(spark, f"templates_{n}", d, lambda n=n: part(n)) for n in ("templates", "fields", "rows", "tables")])


def matched(spark, d):
    """Best template per page, written once per application and input folder."""
    return materialized(spark, "templates_matched", d, lambda: TP.match(typed(spark, d), known(spark, d)))


@query("match_template", f"WITH {MATCH_SQL} SELECT doc_id, template_id, score, round(field_score, 7) AS field_score, round(structure_score, 7) AS structure_score FROM mt")
def match_template(spark, d):
    return matched(spark, d).select("doc_id", "template_id", "score", *[F.round(c, 7).alias(c) for c in ("field_score", "structure_score")])


PREDICT_SQL = f"""{MATCH_SQL},
pf AS (SELECT e.doc_id, e.entity_seq, f.label, m.score, f.template_id, f.required, sqrt((x / 2480 - xn_mean) * (x / 2480 - xn_mean) + (y / 3508 - yn_mean) * (y / 3508 - yn_mean)) / (greatest(xn_std, yn_std, 0.01E0) * 5) AS g,
  list_filter([CASE WHEN is_num AND regexp_matches(text, '^[0-9]+$') THEN 1.0E0 END, CASE WHEN is_aln AND regexp_matches(text, '^[A-Za-z0-9]+$') THEN 1.0E0 END, greatest(0.0E0, 1 - abs(length(text) - round(length_mean)) / 10),
   CASE WHEN f.n > 3 AND length(pre) > 2 THEN CASE WHEN starts_with(text, pre) THEN 1.0E0 ELSE 0.0E0 END END, CASE WHEN f.n > 3 AND length(suf) > 2 THEN CASE WHEN ends_with(text, suf) THEN 1.0E0 ELSE 0.0E0 END END], lambda v: v IS NOT NULL) AS ps
 FROM po_entities e JOIN mt m USING (doc_id) JOIN ff f ON f.template_id = m.template_id),
pq AS (SELECT *, round(greatest(0.0E0, 1 - g) * 0.6E0 + list_avg(ps) * 0.4E0, 9) AS s FROM pf),
pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_seq ORDER BY s DESC, label) AS rn FROM pq) WHERE rn = 1 AND s > 0.5E0)"""


@query("predict_with_template", f"WITH {PREDICT_SQL} SELECT doc_id, entity_seq, template_id, label AS predicted, round(s * score, 6) AS confidence FROM pp")
def predict_with_template(spark, d):
    e, k = typed(spark, d), known(spark, d)
    return TP.predict(e, matched(spark, d), k).select(*KEY, "template_id", "predicted", F.round("confidence", 6).alias("confidence"))


@query("template_missing_required", f"WITH {PREDICT_SQL} SELECT m.doc_id, m.template_id, f.label AS field FROM mt m JOIN ff f ON f.template_id = m.template_id AND f.required WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.doc_id = m.doc_id AND pp.label = f.label)")
def template_missing_required(spark, d):
    e, k = typed(spark, d), known(spark, d)
    m = matched(spark, d)
    return TP.missing_required(m, TP.predict(e, m, k), k).select("doc_id", "template_id", "field")


@query("update_template", f"""WITH {MATCH_SQL},
nb AS (SELECT m.template_id, e.label, e.doc_id, e.entity_seq, x / 2480 AS xn, y / 3508 AS yn, width / 2480 AS wn, height / 3508 AS hn FROM po_entities e JOIN mt m USING (doc_id)),
ni AS (SELECT *, row_number() OVER (PARTITION BY template_id, label ORDER BY doc_id, entity_seq) AS i, count(*) OVER (PARTITION BY template_id, label) AS m FROM nb),
ns AS (SELECT template_id, label, any_value(m) AS m, sum(pow(0.9E0, m - i) * 0.1E0 * xn) AS xa, sum(pow(0.9E0, m - i) * 0.1E0 * yn) AS ya, sum(pow(0.9E0, m - i) * 0.1E0 * wn) AS wa, sum(pow(0.9E0, m - i) * 0.1E0 * hn) AS ha FROM ni GROUP BY ALL)
SELECT f.template_id, f.label, f.n + coalesce(m, 0) AS n, round(pow(0.9E0, coalesce(m, 0)) * xn_mean + coalesce(xa, 0), 11) AS xn_mean, round(pow(0.9E0, coalesce(m, 0)) * yn_mean + coalesce(ya, 0), 11) AS yn_mean,
 round(pow(0.9E0, coalesce(m, 0)) * widthn_mean + coalesce(wa, 0), 11) AS widthn_mean, round(pow(0.9E0, coalesce(m, 0)) * heightn_mean + coalesce(ha, 0), 11) AS heightn_mean FROM ff f LEFT JOIN ns USING (template_id, label)""")
def update_template(spark, d):
    e, k = typed(spark, d), known(spark, d)
    return TP.update(k, e, matched(spark, d)).select("template_id", "label", "n", *[F.round(f"{c}_mean", 11).alias(f"{c}_mean") for c in ("xn", "yn", "widthn", "heightn")])


@query("template_statistics", f"""WITH {LEARN2} SELECT 'templates_per_type' AS section, doc_type AS name, count(*) AS n FROM tn GROUP BY doc_type UNION ALL SELECT 'samples_per_type', doc_type, CAST(sum(samples) AS BIGINT) FROM tn GROUP BY doc_type
UNION ALL SELECT 'field_coverage', label, count(DISTINCT template_id) FROM ff GROUP BY label""")
def template_statistics(spark, d):
    return TP.statistics(known(spark, d))


@query("field_coverage", f"WITH {LEARN2} SELECT label, count(DISTINCT template_id) AS templates, round(count(DISTINCT template_id) / (SELECT count(*) FROM tn), 8) AS share FROM ff GROUP BY label")
def field_coverage(spark, d):
    k = known(spark, d)
    total = k.templates.agg(F.count("*").alias("t"))
    per = k.fields.groupBy("label").agg(F.count_distinct("template_id").alias("templates"))
    return per.transform(beside, total).select("label", "templates", F.round(F.col("templates") / F.col("t"), 8).alias("share"))


@query("cluster_templates")
def cluster_templates(spark, d):
    return MC.cluster_rows(TP.presence(known(spark, d), LABELS), "template_id", 5, 42)


# Two layout templates with text shapes and relative positions (x, y, tolerance).
LAYOUTS = {
    "wide": {"layout": "table_based", "patterns": {"Order number": "[0-9]{10}$", "Quantity": r"[0-9]+\.000 ST$"}, "positions": {"Order number": (0.916, 0.032, 0.02), "Shipping line": (0.823, 0.381, 0.02)}},
    "plain": {"layout": "multi_column", "patterns": {"Order number": "[0-9]{10}$", "Case mark": "YMG"}, "positions": {"Order number": (0.916, 0.032, 0.02), "Case mark": (0.247, 0.379, 0.02)}},
}


@query("match_layout_template", f"""WITH {GAP_SQL}, {CHAINX},
ly AS (SELECT c.doc_id, CASE WHEN t.n > 0 THEN 'table_based' WHEN c.m >= 2 THEN 'multi_column' ELSE 'single_column' END AS pattern FROM (SELECT doc_id, max(row_no) AS m FROM chx GROUP BY doc_id) c LEFT JOIN (SELECT doc_id, count(*) AS n FROM gt GROUP BY doc_id) t USING (doc_id)),
fg AS (SELECT doc_id, bool_or(regexp_matches(text, '^[0-9]{{10}}$')) AS p1, bool_or(regexp_matches(text, '^[0-9]+\\.000 ST$')) AS p2, bool_or(regexp_matches(text, '^YMG')) AS p3,
  bool_or(abs((x + width / 2) / 2480 - 0.916E0) < 0.02E0 AND abs((y + height / 2) / 3508 - 0.032E0) < 0.02E0) AS q1, bool_or(abs((x + width / 2) / 2480 - 0.823E0) < 0.02E0 AND abs((y + height / 2) / 3508 - 0.381E0) < 0.02E0) AS q2,
  bool_or(abs((x + width / 2) / 2480 - 0.247E0) < 0.02E0 AND abs((y + height / 2) / 3508 - 0.379E0) < 0.02E0) AS q3 FROM po_entities GROUP BY doc_id),
sc AS (SELECT doc_id, round(CASE WHEN pattern = 'table_based' THEN 0.3E0 ELSE 0 END + p1::INT * 0.1E0 + p2::INT * 0.1E0 + q1::INT * 0.2E0 + q2::INT * 0.2E0, 6) AS w,
  round(CASE WHEN pattern = 'multi_column' THEN 0.3E0 ELSE 0 END + p1::INT * 0.1E0 + p3::INT * 0.1E0 + q1::INT * 0.2E0 + q3::INT * 0.2E0, 6) AS p FROM fg JOIN ly USING (doc_id))
SELECT doc_id, greatest(w, p) AS score, CASE WHEN greatest(w, p) > 0.5E0 THEN CASE WHEN w >= p THEN 'wide' ELSE 'plain' END END AS template FROM sc""")
def match_layout_template(spark, d):
    e = entities(spark, d)
    return TP.layout_templates(e, L.page_layout(e), LAYOUTS).drop("page_number")


VENDOR_SQL = f"""{GRID_SIG}, gv AS (SELECT doc_id, signature, o_custkey AS vendor FROM grid JOIN orders ON o_orderkey = doc_id),
vt AS (SELECT signature, arg_max(vendor, n * 10000000 + vendor) AS vendor, CAST(sum(n) AS BIGINT) AS samples FROM (SELECT signature, vendor, count(*) AS n FROM gv GROUP BY ALL) GROUP BY signature HAVING sum(n) >= 2)"""


def vendor_signatures(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("vendor"))
    return reading_grid_signature(entities(spark, d)).join(orders, "doc_id")


@query("learn_field_template", f"WITH {VENDOR_SQL} SELECT signature, vendor, samples FROM vt")
def learn_field_template(spark, d):
    return TP.signature_templates(vendor_signatures(spark, d), "vendor")


@query("suggest_template", f"""WITH {VENDOR_SQL},
ps AS (SELECT signature, unnest(string_split(signature, '|')) AS part, len(string_split(signature, '|')) AS n FROM (SELECT DISTINCT signature FROM gv)),
ts AS (SELECT signature AS template, vendor, samples, unnest(string_split(signature, '|')) AS part, len(string_split(signature, '|')) AS n FROM vt),
pr AS (SELECT signature, template, any_value(vendor) AS vendor, any_value(samples) AS samples, count(*) / any_value(n) AS similarity FROM ps JOIN ts USING (part, n) GROUP BY signature, template HAVING count(*) / any_value(n) > 0.6E0),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY similarity DESC, template) AS rank FROM pr) WHERE rank <= 5)
SELECT doc_id, template, rk.vendor, samples, similarity, rank FROM gv JOIN rk USING (signature)""")
def suggest_template(spark, d):
    sigs = parked(vendor_signatures(spark, d))
    known_ = TP.signature_templates(sigs, "vendor")
    return TP.suggest(sigs.drop("vendor"), known_).drop("page_number").withColumn("rank", F.col("rank").cast("long"))


def spoken(spark, d):
    """Boxes whose text names its label, as forms do."""
    return entities(spark, d).select("doc_id", "page_number", "entity_seq", F.concat_ws(": ", "label", "text").alias("text"), F.col("ocr_confidence").alias("confidence"))


def _sql_pattern(p: str) -> str:
    return "(?i)" + p.replace("'", "''")


def _map_sql() -> str:
    parts = []
    for name, (patterns, words, kind, _) in MP.ORDER_FIELDS.items():
        pat = "CASE " + " ".join(f"WHEN regexp_matches(t, '{_sql_pattern(p)}') THEN regexp_extract(t, '{_sql_pattern(p)}', 1)" for p in patterns) + " END"
        shape = {"alphanumeric": r"^(\S+)", "number": "^([0-9]+)", "currency": r"^\$?([0-9]+\.?[0-9]*)", "date": "^([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})", "text": r"^([^\n]+)"}[kind]
        word = "coalesce(" + ", ".join(
            f"CASE WHEN position('{w.lower()}' IN lower(t)) > 0 THEN nullif(trim(regexp_extract(trim(regexp_replace(trim(substring(t, position('{w.lower()}' IN lower(t)) + {len(w)})), '^[:|\\t]+', '')), '{shape}', 1)), '') END" for w in words) + ")"
        parts.append(f"SELECT doc_id, entity_seq, c, '{name}' AS field, {pat} AS p, {word} AS w FROM tx")
    return f"""tx AS (SELECT doc_id, entity_seq, ocr_confidence AS c, concat_ws(': ', label, text) AS t FROM po_entities),
ht AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE p IS NOT NULL OR w IS NOT NULL),
mg AS (SELECT doc_id, field, min(entity_seq) FILTER (p IS NOT NULL) AS fp, min(entity_seq) FILTER (p IS NULL) AS fw, max(c) FILTER (p IS NOT NULL) AS pc, arg_min(c, entity_seq) FILTER (p IS NULL) AS wc,
  arg_min(w, entity_seq) FILTER (p IS NULL) AS wv FROM ht GROUP BY doc_id, field),
mp AS (SELECT mg.*, (SELECT arg_min(h2.p, h2.entity_seq) FROM ht h2 WHERE h2.doc_id = mg.doc_id AND h2.field = mg.field AND h2.p IS NOT NULL AND h2.c = mg.pc) AS pv FROM mg),
mf AS (SELECT doc_id, field, fw IS NOT NULL AND (fp IS NULL OR fw < fp) AND (pc IS NULL OR wc * 0.8E0 >= pc) AS uw, pv, pc, wv, wc FROM mp),
mapped AS (SELECT doc_id, field, CASE WHEN uw THEN wv ELSE pv END AS value, CASE WHEN uw THEN wc * 0.8E0 ELSE pc END AS confidence, CASE WHEN uw THEN 'keyword' ELSE 'pattern' END AS source FROM mf)"""


MAP_SQL = _map_sql()


@query("map_fields", f"WITH {MAP_SQL} SELECT doc_id, field, value, round(confidence, 6) AS confidence, source FROM mapped")
def map_fields(spark, d):
    return MP.map_fields(spoken(spark, d)).drop("page_number").withColumn("confidence", F.round("confidence", 6))


@query("vendor_rules", f"WITH {MAP_SQL} SELECT o_custkey AS vendor, field, arg_max(value, doc_id) AS value, arg_max(source, doc_id) AS source, count(*) AS n FROM mapped JOIN orders ON o_orderkey = doc_id GROUP BY ALL")
def vendor_rules(spark, d):
    vendors = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.col("o_custkey").alias("vendor"))
    return MP.vendor_rules(MP.map_fields(spoken(spark, d)), vendors)


CLASS_SQL = """
kw AS (SELECT page_id, url, html, """ + " + ".join(
    f"CASE WHEN position('{w}' IN lower(html)) > 0 THEN {n} ELSE 0 END" for n, t in ((3, "high"), (2, "medium"), (1, "low"))
    for w in {"high": ["purchase order", "po number", "po#", "vendor", "ship to", "bill to"], "medium": ["item", "quantity", "unit price", "total", "delivery date"], "low": ["date", "description", "amount", "terms"]}[t]) + """ AS pts,
 position('<header' IN html) > 0 OR position('<h1' IN html) > 0 AS hh, position('<table' IN html) > 0 AS ht, (length(html) - length(replace(html, '<p', ''))) / 2 AS rg FROM pages),
ks AS (SELECT page_id, pts / 32.0E0 AS k, least(1.0E0, CASE WHEN hh THEN 0.3E0 ELSE 0 END + CASE WHEN ht THEN 0.4E0 ELSE 0 END + CASE WHEN rg > 10 THEN 0.3E0 ELSE 0 END) AS l,
  CASE WHEN regexp_matches(lower(url), '(po|purchase|order)') THEN 0.8E0 ELSE 0 END AS f FROM kw),
kl AS (SELECT *, list_filter([k, l, f], lambda v: v > 0) AS s FROM ks),
kc AS (SELECT *, round(CASE len(s) WHEN 0 THEN 0 WHEN 1 THEN s[1] WHEN 2 THEN (s[1] * 0.5E0 + s[2] * 0.3E0) / 0.8E0 ELSE (s[1] * 0.5E0 + s[2] * 0.3E0 + s[3] * 0.2E0) / 1.0E0 END, 9) AS c FROM kl)"""


@query("classify_po", f"WITH {CLASS_SQL} SELECT page_id, round(k, 8) AS keyword_score, round(l, 8) AS layout_score, f AS filename_score, round(c, 8) AS confidence, c >= 0.7E0 AS is_po FROM kc")
def classify_po(spark, d):
    h = F.col("html")
    pages = table(spark, d, "pages").withColumn("has_header", h.contains("<header") | h.contains("<h1")).withColumn("has_table", h.contains("<table")).withColumn("regions", F.regexp_count(h, F.lit("<p")))
    return MP.classify_documents(pages, "html", "url").select(
        "page_id", F.round("keyword_score", 8).alias("keyword_score"), F.round("layout_score", 8).alias("layout_score"), "filename_score", F.round("confidence", 8).alias("confidence"), "is_po")


@query("feedback_log", f"""SELECT {DOC_TYPE_SQL} AS doc_type, label, count(*) FILTER (ocr_confidence >= 0.7E0) AS accepted, count(*) FILTER (ocr_confidence < 0.7E0) AS rejected,
 round(avg(x) FILTER (ocr_confidence >= 0.7E0), 6) AS x, round(avg(y) FILTER (ocr_confidence >= 0.7E0), 6) AS y FROM po_entities GROUP BY ALL""")
def feedback_log(spark, d):
    f = MP.accepted_positions(typed(spark, d).withColumn("accepted", F.col("ocr_confidence") >= 0.7))
    return f.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("snk_template_import", f"""WITH {LEARN2}, cu AS (SELECT template_id, samples, n_fields FROM tn WHERE doc_type <> 'receipt'), im AS (SELECT template_id, samples * 10 AS samples, n_fields FROM tn WHERE doc_type <> 'invoice')
SELECT coalesce(cu.template_id, im.template_id) AS template_id, coalesce(im.samples, cu.samples) AS samples, coalesce(im.n_fields, cu.n_fields) AS n_fields,
 CASE WHEN im.template_id IS NULL THEN 'kept' WHEN cu.template_id IS NULL THEN 'added' ELSE 'replaced' END AS change FROM cu FULL JOIN im ON cu.template_id = im.template_id""")
def snk_template_import(spark, d):
    t = known(spark, d).templates
    new = t.filter("doc_type <> 'invoice'").withColumn("samples", F.col("samples") * 10)
    return MP.merge_imported(t.filter("doc_type <> 'receipt'"), new, ["template_id"], ["samples", "n_fields"])


@query("snk_template_export", f"WITH {LEARN2} SELECT template_id, doc_type, samples, n_fields FROM tn")
def snk_template_export(spark, d):
    path = table_path(spark, "templates_out", d)
    known(spark, d).templates.select("template_id", "doc_type", "samples", "n_fields").write.mode("overwrite").parquet(path)
    return spark.read.schema("template_id string, doc_type string, samples bigint, n_fields bigint").parquet(path)
