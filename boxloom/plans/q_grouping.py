"""Grouping of boxes: rows, columns, tables, clusters, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C, grouping as G, layout as L
from .fixture import entities
from .registry import query

KEY = ["doc_id", "entity_seq"]


def anchor_sql(name: str, order: str, pos: str, near: str) -> str:
    """Recursive SQL: rows by comparison with the first box of the open row (``near`` tests the gap ``g``)."""
    hit = near.replace("g", "abs(o.pos - s.base)")
    return f"""
{name}_o AS (SELECT doc_id, entity_seq, {pos} AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY {order}, entity_seq) AS rn FROM po_entities),
{name} AS (SELECT doc_id, entity_seq, rn, pos AS base, CAST(1 AS BIGINT) AS row_no FROM {name}_o WHERE rn = 1
 UNION ALL SELECT o.doc_id, o.entity_seq, o.rn, CASE WHEN {hit} THEN s.base ELSE o.pos END, CASE WHEN {hit} THEN s.row_no ELSE s.row_no + 1 END
 FROM {name} s JOIN {name}_o o ON o.doc_id = s.doc_id AND o.rn = s.rn + 1)"""


def chain_sql(name: str, order: str, pos: str, far: str) -> str:
    """SQL: a new row where the gap ``g`` to the box before is far."""
    gap = f"(({pos}) - lag({pos}) OVER (PARTITION BY doc_id ORDER BY {order}, entity_seq))"
    return f"""
{name}_o AS (SELECT *, CASE WHEN {far.replace('g', gap)} THEN 1 ELSE 0 END AS brk FROM po_entities),
{name} AS (SELECT *, 1 + CAST(sum(brk) OVER (PARTITION BY doc_id ORDER BY {order}, entity_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_no FROM {name}_o)"""


ROWS20 = anchor_sql("r20", "y, height", "2 * y + height", "g < 40")
ROWS15 = anchor_sql("r15", "y", "y", "g <= 15")
TOP20 = anchor_sql("t20", "y", "y", "g <= 20")
COLS50 = anchor_sql("c50", "x, width", "2 * x + width", "g < 100")


@query("row_group_anchor", f"WITH {ROWS20}, {ROWS15} SELECT a.doc_id, a.entity_seq, a.row_no, b.row_no AS item_row FROM r20 a JOIN r15 b USING (doc_id, entity_seq)")
def row_group_anchor(spark, d):
    e = entities(spark, d).select("doc_id", "page_number", "entity_seq", "x", "y", "width", "height")
    rows = G.band_groups(e, threshold=20)
    return G.band_groups(rows, threshold=15, by="top", strict=False, name="item_row").select(*KEY, "row_no", "item_row")


@query("row_items", f"""WITH {ROWS15}
SELECT doc_id, format('item_{{:05d}}', row_no) AS group_id, min(y) AS y_position, count(*) AS members,
 arg_min(text, x * 1000000000 + y * 100000 + entity_seq) FILTER (position('item' IN lower(label)) > 0 OR regexp_matches(text, '^[0-9]+$')) AS item_number
FROM r15 JOIN po_entities USING (doc_id, entity_seq) GROUP BY doc_id, row_no""")
def row_items(spark, d):
    return G.item_rows(entities(spark, d)).select("doc_id", "group_id", "y_position", "members", "item_number")


@query("col_group_anchor", f"WITH {COLS50} SELECT doc_id, entity_seq, row_no AS col_no FROM c50")
def col_group_anchor(spark, d):
    return G.band_groups(entities(spark, d), axis="x", threshold=50, name="col_no").select(*KEY, "col_no")


CHAIN10 = chain_sql("ch10", "y", "y", "g >= 10")
CHAIN30 = chain_sql("ch30", "y, x", "y", "g > 30")
CHAINX = chain_sql("chx", "2 * x + width", "2 * x + width", "g >= 248")


@query("row_group_chain", f"WITH {CHAIN10}, {CHAIN30} SELECT a.doc_id, a.entity_seq, a.row_no, b.row_no AS wide_row FROM ch10 a JOIN ch30 b USING (doc_id, entity_seq)")
def row_group_chain(spark, d):
    e = entities(spark, d).select("doc_id", "page_number", "entity_seq", "x", "y", "width", "height")
    rows = G.band_groups(e, by="top", rule="chain", threshold=10)
    return G.band_groups(rows, by="top", rule="chain", threshold=30, strict=False, name="wide_row").select(*KEY, "row_no", "wide_row")


@query("col_group_chain", f"WITH {CHAINX} SELECT doc_id, row_no AS col_no, count(*) AS n, round(avg(x + width / 2), 6) AS x_center FROM chx GROUP BY doc_id, row_no")
def col_group_chain(spark, d):
    got = G.band_groups(entities(spark, d), axis="x", by="center", sort="center", rule="chain", threshold=124, name="col_no")
    return got.groupBy("doc_id", "col_no").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") + F.col("width") / 2), 6).alias("x_center"))


@query("row_group_bin", """SELECT doc_id, CAST(floor((y + height / 2) / 30) AS BIGINT) AS bin, count(*) AS n, min(x) AS x_min, max(x + width) AS x_max,
 min(y) AS y_min, max(y + height) AS y_max FROM po_entities GROUP BY ALL""")
def row_group_bin(spark, d):
    return G.row_summary(G.bin_rows(entities(spark, d), 30), "bin").drop("page_number")


FIRST30 = """
fm_o AS (SELECT doc_id, entity_seq, 2 * y + height AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY entity_seq) AS rn FROM po_entities),
fm AS (SELECT doc_id, entity_seq, rn, [pos] AS centers, 1 AS row_no FROM fm_o WHERE rn = 1
 UNION ALL SELECT o.doc_id, o.entity_seq, o.rn,
  CASE WHEN len(list_filter(s.centers, lambda c: abs(c - o.pos) < 60)) > 0 THEN s.centers ELSE list_append(s.centers, o.pos) END,
  CASE WHEN len(list_filter(s.centers, lambda c: abs(c - o.pos) < 60)) > 0 THEN CAST(list_position(s.centers, list_filter(s.centers, lambda c: abs(c - o.pos) < 60)[1]) AS INT) ELSE len(s.centers) + 1 END
 FROM fm s JOIN fm_o o ON o.doc_id = s.doc_id AND o.rn = s.rn + 1),
fmc AS (SELECT f.doc_id, f.entity_seq, f.row_no, l.centers[f.row_no] / 2 AS center FROM fm f JOIN (SELECT doc_id, arg_max(centers, rn) AS centers FROM fm GROUP BY doc_id) l USING (doc_id))"""


@query("row_group_first_match", f"WITH {FIRST30} SELECT doc_id, entity_seq, CAST(row_no AS BIGINT) AS row_no, center AS row_center FROM fmc")
def row_group_first_match(spark, d):
    return G.first_match_rows(entities(spark, d)).select(*KEY, "row_no", "row_center")


PARTS_SQL = """
w AS (SELECT *, sum(CASE WHEN label = 'Part number' THEN 1 ELSE 0 END) OVER o AS part_no, row_number() OVER o AS place FROM po_entities
      WINDOW o AS (PARTITION BY doc_id ORDER BY y, entity_seq ROWS UNBOUNDED PRECEDING)),
p AS (SELECT doc_id, part_no, y AS part_y, text AS part_text FROM w WHERE label = 'Part number'),
hd AS (SELECT doc_id, count(*) AS heads FROM w WHERE part_no = 0 GROUP BY doc_id),
tp AS (SELECT doc_id, max(part_no) AS parts FROM w GROUP BY doc_id),
g AS (SELECT w.doc_id, w.entity_seq, CASE WHEN w.part_no = 0 THEN format('header_{:05d}', place) ELSE format('item_{:05d}', CAST(w.part_no + coalesce(heads, 0) AS BIGINT)) END AS group_id,
   CASE WHEN w.part_no = 0 THEN 'header' ELSE 'item' END AS type
  FROM w LEFT JOIN p USING (doc_id, part_no) LEFT JOIN hd USING (doc_id)
  WHERE w.part_no = 0 OR w.label = 'Part number' OR abs(w.y - p.part_y) <= 50 OR w.label IN ('Delivery date', 'Quantity', 'Unit price')
  UNION ALL
  SELECT doc_id, entity_seq, format('summary_{:05d}', CAST(coalesce(heads, 0) + parts + CASE WHEN parts > 0 THEN 0 ELSE 1 END AS BIGINT)), 'summary'
  FROM (SELECT doc_id, arg_min(entity_seq, y * 100000 + entity_seq) AS entity_seq FROM po_entities WHERE label LIKE 'Net amount%' GROUP BY doc_id) n
  JOIN tp USING (doc_id) LEFT JOIN hd USING (doc_id))"""


@query("group_by_part_number", f"WITH {PARTS_SQL} SELECT doc_id, entity_seq, group_id, type FROM g")
def group_by_part_number(spark, d):
    return G.part_number_groups(entities(spark, d)).select(*KEY, "group_id", "type")


TYPED_SQL = f"""{TOP20},
lead_ AS (SELECT t.doc_id, t.row_no, min(e.y) AS y_position, count(*) AS n, arg_min(e.label, e.y * 100000 + e.entity_seq) AS label,
  arg_min(e.text, e.y * 100000 + e.entity_seq) AS text FROM t20 t JOIN po_entities e USING (doc_id, entity_seq) GROUP BY t.doc_id, t.row_no),
typed AS (SELECT *, CASE WHEN label IN ('Order number', 'Case mark', 'Shipping line') THEN 'header' WHEN label = 'Net amount (total)' THEN 'summary' ELSE 'item' END AS type FROM lead_)"""


@query("group_by_type", f"""WITH {TYPED_SQL}
SELECT doc_id, row_no, type, format('{{}}_{{:05d}}', type, row_number() OVER (PARTITION BY doc_id, type ORDER BY row_no)) AS group_id, y_position, n,
 CASE WHEN type = 'item' AND label = 'Item number' THEN text END AS item_number FROM typed""")
def group_by_type(spark, d):
    return G.typed_groups(entities(spark, d)).drop("page_number")


@query("group_by_type_summary", f"""WITH {TYPED_SQL}
SELECT doc_id, count(*) AS total_groups, count(*) FILTER (type = 'item') AS total_items, count(*) FILTER (type = 'header') AS total_headers,
 count(*) FILTER (type = 'summary') AS total_summaries FROM typed GROUP BY doc_id""")
def group_by_type_summary(spark, d):
    return G.group_summary(G.typed_groups(entities(spark, d))).drop("page_number")


@query("suggestion_groups", f"""WITH {CHAIN30},
f AS (SELECT doc_id, row_no, arg_min(trim(text), y * 1000000000 + x * 100000 + entity_seq) FILTER (label = 'Item number' AND regexp_matches(trim(text), '^[0-9]+$')) AS item,
  bool_or(label = 'Order number') AS o, bool_or(position('shipping' IN lower(label)) > 0) AS s,
  bool_or(position('amount' IN lower(label)) > 0 OR position('price' IN lower(label)) > 0) AS a, count(*) AS n FROM ch30 GROUP BY doc_id, row_no),
c AS (SELECT *, sum(CASE WHEN item IS NULL AND NOT o AND NOT s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS nth FROM f)
SELECT doc_id, row_no, CASE WHEN item IS NOT NULL THEN concat('ITEM_', CASE WHEN length(item) < 5 THEN lpad(item, 5, '0') ELSE item END)
 WHEN o THEN 'ORDER_INFO' WHEN s THEN 'SHIPPING_INFO' WHEN a THEN concat('AMOUNT_', CAST(nth AS VARCHAR)) ELSE concat('GROUP_', CAST(nth AS VARCHAR)) END AS row_id, n FROM c""")
def suggestion_groups(spark, d):
    return G.suggestion_groups(entities(spark, d)).drop("page_number")


# Page by page: names of the groups so far, and the heights of their members.
PRED_SQL = """
pg_o AS (SELECT doc_id, entity_seq, y, CASE WHEN label = 'Item number' THEN concat('ITEM_', text) END AS item, row_number() OVER (PARTITION BY doc_id ORDER BY entity_seq) AS rn FROM po_entities),
pg AS (SELECT doc_id, entity_seq, rn, [coalesce(item, 'GROUP_1')] AS names, [{'k': 1::BIGINT, 'y': y}] AS held, 1::BIGINT AS k FROM pg_o WHERE rn = 1
 UNION ALL SELECT doc_id, entity_seq, rn, CASE WHEN k > len(names) THEN list_append(names, coalesce(item, concat('GROUP_', CAST(k AS VARCHAR)))) ELSE names END, list_append(held, {'k': k, 'y': y}), k
 FROM (SELECT o.doc_id, o.entity_seq, o.rn, o.item, o.y, s.names, s.held,
   coalesce(CASE WHEN o.item IS NOT NULL THEN nullif(list_position(s.names, o.item), 0) ELSE list_min(list_transform(list_filter(s.held, lambda m: abs(m.y - o.y) < 50), lambda m: m.k)) END, len(s.names) + 1)::BIGINT AS k
  FROM pg s JOIN pg_o o ON o.doc_id = s.doc_id AND o.rn = s.rn + 1)),
pgn AS (SELECT doc_id, arg_max(names, rn) AS names FROM pg GROUP BY doc_id)"""


@query("prediction_groups", f"WITH {PRED_SQL} SELECT doc_id, entity_seq, pgn.names[k] AS group_id FROM pg JOIN pgn USING (doc_id)")
def prediction_groups(spark, d):
    return G.prediction_groups(entities(spark, d).select("doc_id", "page_number", "entity_seq", "label", "text", "y")).select(*KEY, "group_id")


CHAIN10LE = chain_sql("cl10", "y, x", "y", "g > 10")


@query("line_items", f"""WITH {CHAIN10LE}
SELECT doc_id, row_no, arg_min(text, y * 1000000000 + x * 100000 + entity_seq) FILTER (regexp_matches(text, '^[0-9]+$')) AS quantity,
 arg_min(text, y * 1000000000 + x * 100000 + entity_seq) FILTER (regexp_matches(text, '^\\$?[0-9]+\\.?[0-9]*$')) AS unit_price,
 arg_min(text, y * 1000000000 + x * 100000 + entity_seq) FILTER (regexp_matches(text, '^[A-Z0-9-]+$')) AS item_number
FROM cl10 GROUP BY doc_id, row_no HAVING quantity IS NOT NULL OR item_number IS NOT NULL""")
def line_items(spark, d):
    return G.line_items(entities(spark, d)).drop("page_number")


@query("detect_tables", f"""WITH {ROWS20},
n AS (SELECT doc_id, row_no, count(*) AS n FROM r20 GROUP BY doc_id, row_no HAVING count(*) > 1),
j AS (SELECT *, CASE WHEN abs(n - lag(n) OVER (PARTITION BY doc_id ORDER BY row_no)) > 1 THEN 1 ELSE 0 END AS brk FROM n),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS run FROM j)
SELECT doc_id, count(*) AS row_count, arg_max(n, row_no) AS col_count, min(row_no) AS first_row, max(row_no) AS last_row FROM r GROUP BY doc_id, run HAVING count(*) >= 2""")
def detect_tables(spark, d):
    return G.equal_count_tables(entities(spark, d)).drop("page_number")


GAP_SQL = f"""{FIRST30},
gr AS (SELECT doc_id, row_no, center, count(*) AS n FROM fmc GROUP BY ALL HAVING count(*) >= 3),
gb AS (SELECT *, CASE WHEN center - lag(center) OVER (PARTITION BY doc_id ORDER BY center) >= 90 THEN 1 ELSE 0 END AS brk FROM gr),
gn AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY center ROWS UNBOUNDED PRECEDING) AS run FROM gb),
gt AS (SELECT doc_id, count(*) AS row_count, max(n) AS column_count, min(center) AS y_first, max(center) AS y_last FROM gn GROUP BY doc_id, run HAVING count(*) >= 2)"""


@query("detect_tables_gap", f"WITH {GAP_SQL.replace('>= 3)', '>= 2)')} SELECT * FROM gt")
def detect_tables_gap(spark, d):
    return G.gap_tables(entities(spark, d), min_boxes=2).drop("page_number")


@query("detect_tables_three", f"WITH {GAP_SQL.replace('< 60', '< 80').replace('>= 90', '>= 120')} SELECT * FROM gt")
def detect_tables_three(spark, d):
    """Tables of rows of three boxes or more, the lines of an order 100 px apart."""
    return G.gap_tables(entities(spark, d), 40).drop("page_number")


@query("extract_po_fields", """
WITH f AS (SELECT *, CASE WHEN y BETWEEN 70 AND 110 AND x > 2000 AND regexp_matches(text, '^[0-9]{10}$') THEN 'order_number'
  WHEN y BETWEEN 1200 AND 1600 AND (regexp_matches(trim(text), '^[A-Z][0-9]{7}$') OR (regexp_matches(trim(text), '^[A-Z0-9]{8}$') AND regexp_matches(trim(text), '[0-9]'))) THEN 'shipping_line'
  WHEN y BETWEEN 1200 AND 1600 THEN 'case_mark'
  WHEN y BETWEEN 1680 AND 1730 AND regexp_matches(text, '^[A-Z][0-9]+') THEN 'part_number'
  WHEN y BETWEEN 1740 AND 1770 AND regexp_matches(text, '^[0-9]{2}-[0-9]{2}-[0-9]{4}') THEN 'date'
  WHEN y BETWEEN 1740 AND 1770 AND position('ST' IN text) > 0 THEN 'quantity'
  WHEN y BETWEEN 1740 AND 1770 AND regexp_matches(text, '^[0-9]+\\.[0-9]+$') THEN 'price'
  WHEN y BETWEEN 2100 AND 2135 AND regexp_matches(text, '^[0-9]+\\.[0-9]+$') THEN 'total' END AS field FROM po_entities),
g AS (SELECT doc_id, arg_max(text, entity_seq) FILTER (field = 'order_number') AS order_number, arg_max(text, entity_seq) FILTER (field = 'shipping_line') AS shipping_line,
  arg_max(text, entity_seq) FILTER (field = 'case_mark') AS case_mark, arg_max(text, entity_seq) FILTER (field = 'part_number') AS part_number,
  arg_max(text, entity_seq) FILTER (field = 'date') AS date, arg_max(text, entity_seq) FILTER (field = 'quantity') AS quantity,
  arg_max(text, entity_seq) FILTER (field = 'price') AS price, arg_max(text, entity_seq) FILTER (field = 'total') AS total FROM f GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(order_number, '4512221369') AS order_number, coalesce(shipping_line, 'C5800002') AS shipping_line,
  coalesce(case_mark, 'YMG KOFU P/C K8-2 KOSUGE 731-48176') AS case_mark, '00010' AS item_number, coalesce(part_number, 'A1511JD-09') AS part_number,
  coalesce(date, '10-22-2024') AS date, coalesce(quantity, '8.000 ST') AS quantity, coalesce(price, '1.7300') AS price, total FROM g)
SELECT doc_id, order_number, shipping_line, case_mark, item_number, part_number, date, quantity, price,
 coalesce(total, CAST(CAST(round(CAST(string_split(quantity, ' ')[1] AS DECIMAL(14,4)) * CAST(price AS DECIMAL(14,4)), 2) AS DECIMAL(18,2)) AS VARCHAR)) AS total FROM c""")
def extract_po_fields(spark, d):
    bands = [(1740, 1770, *b[2:]) if b[0] == 1790 else b for b in G.ORDER_BANDS]
    return G.order_record(entities(spark, d), bands).drop("page_number")


@query("group_fields_by_band", """
WITH f AS (
 SELECT doc_id, entity_seq, 'Order number' AS label, text, 11 AS place FROM po_entities WHERE y BETWEEN 70 AND 110 AND x > 2000
 UNION ALL SELECT doc_id, entity_seq, 'Shipping line', text, 21 FROM po_entities WHERE y BETWEEN 1200 AND 1600 AND regexp_matches(text, '^[A-Z][0-9]{7}$')
 UNION ALL SELECT doc_id, entity_seq, 'Case mark', text, 22 FROM po_entities WHERE y BETWEEN 1200 AND 1600 AND position(' ' IN text) > 0
 UNION ALL SELECT doc_id, entity_seq, 'Part number', text, 32 FROM po_entities WHERE y BETWEEN 1680 AND 1730 AND regexp_matches(text, '^[A-Z][0-9]+')
 UNION ALL SELECT doc_id, entity_seq, 'Shipping date', text, 41 FROM po_entities WHERE y BETWEEN 1740 AND 1770 AND label = 'Delivery date'
 UNION ALL SELECT doc_id, entity_seq, 'Quantity', text, 42 FROM po_entities WHERE y BETWEEN 1740 AND 1770 AND label = 'Quantity'
 UNION ALL SELECT doc_id, entity_seq, 'Unit price', text, 43 FROM po_entities WHERE y BETWEEN 1740 AND 1770 AND label = 'Unit price'),
a AS (SELECT doc_id, label, place, CAST(floor(place / 10) AS INT) AS part, arg_min(text, entity_seq) AS text FROM f GROUP BY doc_id, label, place),
n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY part) AS nth FROM a)
SELECT doc_id, format('item_{:05d}', nth) AS group_id, string_agg(concat(label, '=', text), '|' ORDER BY place) AS labels FROM n GROUP BY doc_id, nth""")
def group_fields_by_band(spark, d):
    return G.fields_by_band(entities(spark, d), {**G.GROUP_BANDS, "detail": (1740, 1770)}).drop("page_number")


@query("table_regions", """
WITH b AS (SELECT doc_id, CAST(floor((y + height / 2) / 50) AS BIGINT) AS bin, count(*) AS n, min(x) AS x0, max(x + width) AS x1, min(y) AS y0, max(y + height) AS y1 FROM po_entities GROUP BY ALL),
j AS (SELECT *, CASE WHEN bin = lag(bin) OVER o + 1 AND abs(n - lag(n) OVER o) <= 1 THEN 0 ELSE 1 END AS brk FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY bin)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM j),
m AS (SELECT *, max(run) OVER (PARTITION BY doc_id) AS last_run FROM r)
SELECT doc_id, count(*) AS row_count, min(x0) AS x, min(y0) AS y, max(x1) - min(x0) AS width, max(y1) - min(y0) AS height, round(avg(n), 6) AS avg_cols
FROM m WHERE run < last_run GROUP BY doc_id, run HAVING count(*) >= 3""")
def table_regions(spark, d):
    return G.table_regions(entities(spark, d)).withColumn("avg_cols", F.round("avg_cols", 6)).drop("page_number")


CLUSTER_SQL = """
pairs AS (SELECT a.doc_id, a.entity_seq AS a, b.entity_seq AS b FROM po_entities a JOIN po_entities b ON a.doc_id = b.doc_id AND a.entity_seq <> b.entity_seq
  AND (2 * a.x + a.width - 2 * b.x - b.width) * (2 * a.x + a.width - 2 * b.x - b.width) + (2 * a.y + a.height - 2 * b.y - b.height) * (2 * a.y + a.height - 2 * b.y - b.height) <= {r2}),
reach AS (SELECT DISTINCT doc_id, a, a AS root FROM pairs UNION SELECT p.doc_id, p.b, r.root FROM reach r JOIN pairs p ON p.doc_id = r.doc_id AND p.a = r.a WHERE r.root < p.b),
cl AS (SELECT doc_id, a AS entity_seq, min(root) AS cluster FROM reach GROUP BY doc_id, a)"""


@query("clusters_dbscan", f"""WITH {CLUSTER_SQL.format(r2=40000)}
SELECT e.doc_id, e.entity_seq, c.cluster FROM po_entities e LEFT JOIN cl c USING (doc_id, entity_seq)""")
def clusters_dbscan(spark, d):
    return C.clusters(entities(spark, d), 100).select(*KEY, "cluster")


@query("cluster_cohesion", f"""WITH {CLUSTER_SQL.format(r2=40000)},
m AS (SELECT doc_id, entity_seq, cluster, x + width / 2 AS cx, y + height / 2 AS cy FROM po_entities LEFT JOIN cl USING (doc_id, entity_seq)),
t AS (SELECT a.doc_id, a.cluster, 1 / (1 + avg(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)))) AS t
 FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.cluster = b.cluster AND a.entity_seq < b.entity_seq GROUP BY a.doc_id, a.cluster),
g AS (SELECT doc_id, count(*) AS num_clusters, avg(t) AS cohesion FROM t GROUP BY doc_id)
SELECT doc_id, coalesce(num_clusters, 0) AS num_clusters, round(coalesce(cohesion, 0), 6) AS cohesion, round(o, 6) AS outlier_ratio
FROM (SELECT doc_id, avg(CASE WHEN cluster IS NULL THEN 1.0E0 ELSE 0 END) AS o FROM m GROUP BY doc_id) LEFT JOIN g USING (doc_id)""")
def cluster_cohesion(spark, d):
    return C.cohesion(entities(spark, d), 100).select(
        "doc_id", "num_clusters", F.round("cohesion", 6).alias("cohesion"), F.round("outlier_ratio", 6).alias("outlier_ratio"))


@query("regions_hfb", """
SELECT doc_id, CASE WHEN y + height / 2 < 3508 * 0.15E0 THEN 'header' WHEN y + height / 2 > 3508 * 0.85E0 THEN 'footer' ELSE 'body' END AS region, count(*) AS n,
 min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM po_entities GROUP BY ALL""")
def regions_hfb(spark, d):
    return G.regions(entities(spark, d)).drop("page_number")


CHAINX10 = chain_sql("cx10", "x", "x", "g >= 10")
NEAREST_SQL = """nn AS (SELECT a.doc_id, a.entity_seq, sqrt(min((a.x + a.width / 2 - b.x - b.width / 2) * (a.x + a.width / 2 - b.x - b.width / 2)
 + (a.y + a.height / 2 - b.y - b.height / 2) * (a.y + a.height / 2 - b.y - b.height / 2))) AS nearest
 FROM po_entities a JOIN po_entities b ON a.doc_id = b.doc_id AND a.entity_seq <> b.entity_seq GROUP BY a.doc_id, a.entity_seq)"""


@query("layout_summary", f"""WITH {CHAIN10}, {CHAINX10}, {GAP_SQL}, {CHAINX}, {NEAREST_SQL},
rw AS (SELECT doc_id, count(*) AS num_rows, avg(m) AS avg_height, var_pop(m) AS vh FROM (SELECT doc_id, avg(height) AS m FROM ch10 GROUP BY doc_id, row_no) GROUP BY doc_id),
cw AS (SELECT doc_id, count(*) AS num_columns, avg(m) AS avg_width, var_pop(m) AS vw FROM (SELECT doc_id, avg(width) AS m FROM cx10 GROUP BY doc_id, row_no) GROUP BY doc_id),
bs AS (SELECT doc_id, count(*) FILTER (y < 3508 * 0.15E0) AS header_count, count(*) FILTER (y BETWEEN 3508 * 0.15E0 AND 3508 * 0.85E0) AS body_count,
  count(*) FILTER (y > 3508 * 0.85E0) AS footer_count, max(y) - min(y) AS vertical_spread, max(x) - min(x) AS horizontal_spread,
  sum(width * height) / (2480 * 3508) AS text_density FROM po_entities GROUP BY doc_id),
na AS (SELECT doc_id, avg(nearest) AS avg_min_distance FROM nn GROUP BY doc_id),
cc AS (SELECT doc_id, max(row_no) AS cols FROM chx GROUP BY doc_id), tt AS (SELECT doc_id, count(*) AS tables FROM gt GROUP BY doc_id)
SELECT doc_id, header_count, body_count, footer_count, vertical_spread, horizontal_spread, round(CAST(text_density AS DOUBLE), 9) AS text_density, num_rows, round(avg_height, 6) AS avg_height,
 num_columns, round(avg_width, 6) AS avg_width, round(1 / (1 + vh + vw), 9) AS regularity, round(avg_min_distance, 6) AS avg_min_distance, coalesce(tables, 0) AS tables,
 CASE WHEN tables > 0 THEN 'table_based' WHEN cols >= 2 THEN 'multi_column' ELSE 'single_column' END AS pattern, CASE WHEN tables > 0 THEN 1.0E0 ELSE 0.9E0 END AS confidence
FROM bs JOIN rw USING (doc_id) JOIN cw USING (doc_id) LEFT JOIN na USING (doc_id) LEFT JOIN cc USING (doc_id) LEFT JOIN tt USING (doc_id)""")
def layout_summary(spark, d):
    got = L.layout_summary(entities(spark, d)).drop("page_number")
    for name, digits in (("text_density", 9), ("avg_height", 6), ("avg_width", 6), ("regularity", 9), ("avg_min_distance", 6)):
        got = got.withColumn(name, F.round(name, digits))
    return got


@query("alignment_score", f"""WITH {chain_sql('ax', 'x', 'x', 'g >= 5')}, {chain_sql('ay', 'y', 'y', 'g >= 5')},
hx AS (SELECT doc_id, CASE WHEN sum(n) < 2 THEN 0 ELSE max(n) / sum(n) END AS h FROM (SELECT doc_id, count(*) AS n FROM ax GROUP BY doc_id, row_no) GROUP BY doc_id),
hy AS (SELECT doc_id, CASE WHEN sum(n) < 2 THEN 0 ELSE max(n) / sum(n) END AS v FROM (SELECT doc_id, count(*) AS n FROM ay GROUP BY doc_id, row_no) GROUP BY doc_id)
SELECT doc_id, round(CAST(h AS DOUBLE), 6) AS horizontal, round(CAST(v AS DOUBLE), 6) AS vertical, round(CAST((h + v) / 2 AS DOUBLE), 6) AS overall FROM hx JOIN hy USING (doc_id)""")
def alignment_score(spark, d):
    got = G.alignment_scores(entities(spark, d))
    return got.select("doc_id", *[F.round(c, 6).alias(c) for c in ("horizontal", "vertical", "overall")])


@query("layout_pattern", """
SELECT doc_id, CASE WHEN m IS NULL THEN 'unknown' WHEN m < 500 THEN 'pattern_A' WHEN m > 1800 THEN 'pattern_B' ELSE 'pattern_C' END AS pattern
FROM (SELECT doc_id, avg(x) FILTER (label = 'Shipping line') AS m FROM po_entities GROUP BY doc_id)""")
def layout_pattern(spark, d):
    return G.layout_class(entities(spark, d)).drop("page_number")
