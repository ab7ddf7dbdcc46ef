"""Scalar column functions over boxes, file names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bbox as B, normalize as N, scores as S, signature as G, text as T
from ..scale import rule_table
from ..sources.profile import json_profile
from .fixture import entities, table
from .registry import query

KEY = ["doc_id", "entity_seq"]


@query("bbox_geometry", """
SELECT doc_id, entity_seq, x + CAST(floor(width / 2) AS BIGINT) AS center_x, y + CAST(floor(height / 2) AS BIGINT) AS center_y,
  width * height AS area, 2 * (width + height) AS perimeter, width / height AS aspect,
  [{'px': x, 'py': y}, {'px': x + width, 'py': y}, {'px': x + width, 'py': y + height}, {'px': x, 'py': y + height}] AS corners
FROM po_entities""")
def bbox_geometry(spark, d):
    b = B.Box.of()
    cx, cy = B.int_center(b)
    return entities(spark, d).select(
        *KEY, cx.alias("center_x"), cy.alias("center_y"), b.area.alias("area"), B.perimeter(b).alias("perimeter"),
        B.aspect(b).alias("aspect"), B.corners(b).alias("corners"))


@query("page_flags", """
SELECT page_id, length(trim(html)) AS text_length, length(trim(html)) > 0 AS has_text,
  CAST((length(html) - length(replace(html, '<img', ''))) / 4 AS BIGINT) AS image_count,
  NOT (length(trim(html)) > 0) AND position('<img' IN html) = 0 AND position('<table' IN html) = 0 AS is_blank,
  2480 / 3508 AS aspect
FROM pages""")
def page_flags(spark, d):
    h = F.col("html")
    images = F.regexp_count(h, F.lit("<img")).cast("long")
    size = F.length(F.trim(h)).cast("long")
    return table(spark, d, "pages").select(
        "page_id", size.alias("text_length"), (size > 0).alias("has_text"), images.alias("image_count"),
        (~(size > 0) & (images == 0) & ~h.contains("<table")).alias("is_blank"), (F.lit(2480) / F.lit(3508)).alias("aspect"))


PAIR_SQL = """
WITH pr AS (
  SELECT a.doc_id, a.line_no, a.x AS ax, a.y AS ay, a.width + 400 AS aw, a.height AS ah,
         b.x AS bx, b.y AS byy, b.width AS bw, b.height AS bh
  FROM po_entities a JOIN po_entities b ON a.doc_id = b.doc_id AND a.line_no = b.line_no
  WHERE a.label = 'Item number' AND b.label = 'Part number'
), ov AS (
  SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, byy + bh) - greatest(ay, byy)) AS inter
  FROM pr)
"""


def item_part(spark, d):
    """Item number boxes, widened by 400 px, beside the part number box of the line."""
    e = entities(spark, d)
    cols = [F.col(c) for c in ("x", "y", "width", "height")]
    a = e.filter("label = 'Item number'").select("doc_id", "line_no", *[c.alias("a_" + n) for c, n in zip(
        [cols[0], cols[1], cols[2] + 400, cols[3]], ("x", "y", "width", "height"))])
    b = e.filter("label = 'Part number'").select("doc_id", "line_no", *[F.col(n).alias("b_" + n) for n in ("x", "y", "width", "height")])
    return a.join(b, ["doc_id", "line_no"]), B.Box.of("a_"), B.Box.of("b_")


@query("bbox_contains", PAIR_SQL + "SELECT doc_id, line_no, bx BETWEEN ax AND ax + aw AND byy BETWEEN ay AND ay + ah AS has_corner FROM pr")
def bbox_contains(spark, d):
    df, a, b = item_part(spark, d)
    return df.select("doc_id", "line_no", B.contains(a, b.x, b.y).alias("has_corner"))


@query("bbox_intersects", PAIR_SQL + """SELECT doc_id, line_no,
 NOT (ax + aw < bx OR bx + bw < ax OR ay + ah < byy OR byy + bh < ay) AS touches,
 ax < bx + bw AND ax + aw > bx AND ay < byy + bh AND ay + ah > byy AS overlaps FROM pr""")
def bbox_intersects(spark, d):
    df, a, b = item_part(spark, d)
    return df.select("doc_id", "line_no", B.touches(a, b).alias("touches"), B.overlaps(a, b).alias("overlaps"))


@query("bbox_intersection", PAIR_SQL + "SELECT doc_id, line_no, inter FROM ov")
def bbox_intersection(spark, d):
    df, a, b = item_part(spark, d)
    return df.select("doc_id", "line_no", B.intersection(a, b).alias("inter"))


@query("bbox_union", PAIR_SQL + "SELECT doc_id, line_no, aw * ah + bw * bh - inter AS area FROM ov")
def bbox_union(spark, d):
    df, a, b = item_part(spark, d)
    return df.select("doc_id", "line_no", B.union(a, b).alias("area"))


@query("bbox_iou", PAIR_SQL + "SELECT doc_id, line_no, round(inter / (aw * ah + bw * bh - inter), 6) AS iou FROM ov")
def bbox_iou(spark, d):
    df, a, b = item_part(spark, d)
    return df.select("doc_id", "line_no", F.round(B.iou(a, b), 6).alias("iou"))


@query("bbox_scale", """SELECT doc_id, entity_seq, CAST(trunc(x * 0.5E0) AS BIGINT) AS x, CAST(trunc(y * 0.25E0) AS BIGINT) AS y,
 CAST(trunc(width * 0.5E0) AS BIGINT) AS width, CAST(trunc(height * 0.25E0) AS BIGINT) AS height FROM po_entities""")
def bbox_scale(spark, d):
    b = B.scaled(B.Box.of(), 0.5, 0.25)
    return entities(spark, d).select(*KEY, b.x.alias("x"), b.y.alias("y"), b.width.alias("width"), b.height.alias("height"))


@query("bbox_to_1000", """SELECT doc_id, entity_seq, CAST(trunc(x / 2480 * 1000) AS BIGINT) AS x, CAST(trunc(y / 3508 * 1000) AS BIGINT) AS y,
 CAST(trunc(width / 2480 * 1000) AS BIGINT) AS width, CAST(trunc(height / 3508 * 1000) AS BIGINT) AS height FROM po_entities""")
def bbox_to_1000(spark, d):
    b = B.to_1000(B.Box.of())
    return entities(spark, d).select(*KEY, b.x.alias("x"), b.y.alias("y"), b.width.alias("width"), b.height.alias("height"))


@query("bbox_valid", """
WITH g AS (SELECT doc_id, entity_seq, x - 140 AS x, y, CAST(floor(width / 20) AS BIGINT) AS width, height FROM po_entities)
SELECT doc_id, entity_seq, concat_ws(',', CASE WHEN width < 10 THEN 'width_too_small' END, CASE WHEN height < 10 THEN 'height_too_small' END,
 CASE WHEN x < 0 OR y < 0 THEN 'negative_position' END,
 CASE WHEN width / height > 20 OR width / height < 0.05 THEN 'aspect_out_of_range' END) AS errors
FROM g""")
def bbox_valid(spark, d):
    moved = entities(spark, d).withColumn("x", F.col("x") - 140).withColumn("width", F.floor(F.col("width") / 20))
    return moved.select(*KEY, F.concat_ws(",", B.errors(B.Box.of())).alias("errors"))


@query("position_features", """
SELECT doc_id, entity_seq, round(x / 2480, 6) AS x_norm, round(y / 3508, 6) AS y_norm, round((x + width / 2) / 2480, 6) AS cx_norm,
 round((y + height / 2) / 3508, 6) AS cy_norm, round(width / 2480, 6) AS w_norm, round(height / 3508, 6) AS h_norm,
 round(width * height / (2480 * 3508), 6) AS area_norm, round(width / greatest(height, 1), 6) AS aspect,
 CASE WHEN x + width / 2 < 1240 THEN CASE WHEN y + height / 2 < 1754 THEN 1 ELSE 3 END ELSE CASE WHEN y + height / 2 < 1754 THEN 2 ELSE 4 END END AS quadrant,
 CASE WHEN y + height / 2 < 526.2E0 THEN 'header' WHEN y + height / 2 > 2981.8E0 THEN 'footer' ELSE 'body' END AS region
FROM po_entities""")
def position_features(spark, d):
    b = B.Box.of()
    r = lambda c: F.round(c, 6)
    return entities(spark, d).select(
        *KEY, r(b.x / 2480).alias("x_norm"), r(b.y / 3508).alias("y_norm"), r(b.cx / 2480).alias("cx_norm"),
        r(b.cy / 3508).alias("cy_norm"), r(b.width / 2480).alias("w_norm"), r(b.height / 3508).alias("h_norm"),
        r(b.area / (2480 * 3508)).alias("area_norm"), r(B.aspect(b)).alias("aspect"), B.quadrant(b).alias("quadrant"),
        B.region(b.cy).alias("region"))


@query("zones", """
SELECT doc_id, entity_seq,
 CASE WHEN x + width / 2 < 1240 AND y + height / 2 < 1754 THEN 1 WHEN y + height / 2 < 1754 THEN 2 WHEN x + width / 2 < 1240 THEN 3 ELSE 4 END AS quadrant,
 CASE WHEN y / 3508 < 0.2E0 THEN 'header' WHEN y / 3508 > 0.8E0 THEN 'footer' ELSE 'body' END AS vertical_zone,
 CASE WHEN x / 2480 < 0.33E0 THEN 'left' WHEN x / 2480 > 0.67E0 THEN 'right' ELSE 'center' END AS horizontal_zone
FROM po_entities""")
def zones(spark, d):
    b = B.Box.of()
    return entities(spark, d).select(*KEY, B.quadrant(b).alias("quadrant"), B.vertical_zone(b).alias("vertical_zone"),
                                     B.horizontal_zone(b).alias("horizontal_zone"))


@query("text_features", """
SELECT doc_id, entity_seq, length(text) AS text_length, regexp_matches(text, '^[0-9]+$') AS is_numeric,
 regexp_matches(text, '^[A-Za-z]+$') AS is_alpha, regexp_matches(text, '^[A-Za-z0-9]+$') AS is_alnum,
 regexp_matches(text, '[0-9]') AS has_digits, regexp_matches(text, '[A-Za-z]') AS has_letters,
 regexp_matches(text, '[^A-Za-z0-9 \\t\\r\\n]') AS has_special,
 round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 6) AS digit_ratio,
 round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1), 6) AS upper_ratio,
 length(text) - length(replace(text, ' ', '')) AS space_count, length(text) - length(replace(text, '-', '')) AS dash_count,
 length(text) - length(replace(text, '.', '')) AS dot_count, length(text) - length(replace(text, ',', '')) AS comma_count
FROM po_entities""")
def text_features(spark, d):
    f = T.features(F.col("text"))
    for name in ("digit_ratio", "upper_ratio"):
        f[name] = F.round(f[name], 6)
    for name in ("text_length", "space_count", "dash_count", "dot_count", "comma_count"):
        f[name] = f[name].cast("long")
    return entities(spark, d).select(*KEY, *[c.alias(n) for n, c in f.items()])


@query("pattern_flags", """
SELECT doc_id, entity_seq, regexp_matches(text, '^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}') AS is_date,
 regexp_matches(text, '^[0-9]{10}$') AS is_order_number, regexp_matches(text, '^[$¥€£]\\s*[0-9,]+\\.?[0-9]*') AS is_currency,
 regexp_matches(text, '^[0-9]+\\.?[0-9]*%') AS is_percentage,
 regexp_matches(text, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') AS is_email,
 regexp_matches(text, '^[+0-9]?[0-9\\s()-]+') AS is_phone, regexp_matches(text, '^[0-9]{5}$') AS is_item_number,
 regexp_matches(text, '^[A-Z0-9-]+$') AS is_part_chars, regexp_matches(text, '^[0-9]+\\.[0-9]{2,4}$') AS is_price,
 regexp_matches(text, '^[A-Z][0-9]{7}$') AS is_shipping_line, position('total' IN lower(text)) > 0 AS contains_total,
 position('item' IN lower(text)) > 0 AS contains_item, position(':' IN text) > 0 AS has_colon
FROM po_entities""")
def pattern_flags(spark, d):
    return entities(spark, d).select(*KEY, *[c.alias(n) for n, c in T.pattern_flags(F.col("text")).items()])


@query("semantic_flags", """
SELECT doc_id, entity_seq, label IN ('Order number', 'Item number', 'Part number', 'Shipping line') AS is_identifier,
 label IN ('Quantity', 'Unit price', 'Net amount', 'Total') AS is_quantity, label IN ('Date', 'Delivery date') AS is_date,
 label IN ('Case mark', 'Description', 'Branch') AS is_descriptive FROM po_entities""")
def semantic_flags(spark, d):
    return entities(spark, d).select(*KEY, *[c.alias(n) for n, c in T.semantic_flags(F.col("label")).items()])


@query("is_shipping_line", """
SELECT doc_id, entity_seq, regexp_matches(trim(ocr_original), '^[A-Z][0-9]{7}$')
 OR (regexp_matches(trim(ocr_original), '^[A-Z0-9]{8}$') AND regexp_matches(trim(ocr_original), '[0-9]')) AS hit FROM po_entities""")
def is_shipping_line(spark, d):
    return entities(spark, d).select(*KEY, T.is_shipping_line(F.col("ocr_original")).alias("hit"))


CASE_RE = "(YMG|KOFU|ISHIKAWA|KOSUGE|TOKYO|EXT:|LOC:|K5|K8|P/C|731-)"


@query("is_case_mark", f"""
SELECT doc_id, entity_seq, regexp_matches(upper(text), '{CASE_RE}') AS by_word,
 regexp_matches(upper(text), '{CASE_RE}') OR regexp_matches(text, '[^ \\t\\r\\n]+[ \\t\\r\\n]+[^ \\t\\r\\n]') OR regexp_matches(text, '[-/]') AS by_shape
FROM po_entities""")
def is_case_mark(spark, d):
    t = F.col("text")
    return entities(spark, d).select(*KEY, T.is_case_mark(t).alias("by_word"), T.is_case_mark(t, separators="-/").alias("by_shape"))


SHIP_SQL = "(regexp_matches({t}, '^[A-Z][0-9]{{7}}$') OR (regexp_matches({t}, '^[A-Z0-9]{{8}}$') AND regexp_matches({t}, '[0-9]')))"


@query("classify_by_rule", f"""
SELECT doc_id, entity_seq,
 CASE WHEN regexp_matches(t, '^[0-9]{{10}}$') AND y BETWEEN 70 AND 110 THEN 'Order number'
  WHEN regexp_matches(t, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}') THEN 'Delivery date'
  WHEN regexp_matches(t, '^[0-9,]+\\.[0-9]{{3}}\\s*ST') THEN 'Quantity'
  WHEN regexp_matches(t, '^[0-9]+\\.[0-9]{{2,4}}$') THEN CASE WHEN y < 750 THEN 'Unit price' ELSE 'Net amount (total)' END
  WHEN regexp_matches(t, '^[0-9]{{5}}$') AND y BETWEEN 640 AND 700 THEN 'Item number'
  WHEN {SHIP_SQL.format(t='t')} THEN 'Shipping line'
  WHEN regexp_matches(upper(t), '{CASE_RE}') THEN 'Case mark'
  WHEN regexp_matches(t, '^[A-Z][0-9]{{4}}[A-Z]{{2}}(-[0-9]{{2}})?$') THEN 'Part number' END AS strict_label,
 CASE WHEN regexp_matches(t, '^[0-9]{{10}}$') AND y BETWEEN 70 AND 105 THEN 'Order number'
  WHEN regexp_matches(t, '^[0-9]{{5}}$') AND y BETWEEN 1600 AND 1800 THEN 'Item number'
  WHEN regexp_matches(t, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}') THEN 'Delivery date'
  WHEN regexp_matches(t, '^[0-9,]+\\.[0-9]{{3}}\\s*ST?') THEN 'Quantity'
  WHEN regexp_matches(t, '^[0-9]+\\.[0-9]{{2,4}}$') AND y BETWEEN 1700 AND 1900 THEN 'Unit price'
  WHEN (position('Total' IN t) > 0 OR regexp_matches(t, '^[0-9]+\\.[0-9]{{2}}$')) AND y >= 2000 THEN 'Net amount (total)'
  WHEN {SHIP_SQL.format(t='upper(t)')} AND y BETWEEN 1200 AND 1600 THEN 'Shipping line'
  WHEN (regexp_matches(upper(t), '(YMG|KOFU|ISHIKAWA|KOSUGE|TOKYO|EXT:|LOC:|K5|K8|P/C|731-|K70|SHI|YAMANASHI)')
        OR regexp_matches(t, '[^ \\t\\r\\n]+[ \\t\\r\\n]+[^ \\t\\r\\n]') OR regexp_matches(t, '[-/:]')) AND y BETWEEN 1200 AND 1600 THEN 'Case mark'
  WHEN regexp_matches(t, '^[A-Z][0-9]{{4}}[A-Z]{{2}}(-[0-9]{{2}})?$') AND y BETWEEN 1650 AND 1800 THEN 'Part number' END AS banded_label
FROM (SELECT *, trim(text) AS t FROM po_entities)""")
def classify_by_rule(spark, d):
    t, y = F.col("text"), F.col("y")
    return entities(spark, d).select(*KEY, T.classify_strict(t, y).alias("strict_label"), T.classify_banded(t, y).alias("banded_label"))


@query("apply_rules", """
SELECT doc_id, entity_seq, CASE
 WHEN regexp_matches(text, '^[0-9]{10}$') AND y < 3508 * 0.1E0 AND x > 2480 * 0.7E0 THEN 'Order number'
 WHEN position('total' IN lower(text)) > 0 AND y > 3508 * 0.8E0 AND x > 2480 * 0.7E0 THEN 'Net amount (total)'
 WHEN regexp_matches(text, '^[A-Z][0-9]{7}') AND x > 2480 * 0.7E0 THEN 'Shipping line'
 WHEN regexp_matches(upper(text), '(YMG|KOFU|AOKI|K5-)') THEN 'Case mark'
 WHEN regexp_matches(text, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}') AND y / 3508 > 0.4E0 THEN 'Delivery date'
 WHEN regexp_matches(text, '^[0-9]{5}$') AND x < 2480 * 0.3E0 THEN 'Item number'
 WHEN regexp_matches(text, '^[A-Z][0-9]{4}[A-Z]{2}-[A-Z]$') THEN 'Part number'
 ELSE 'unknown' END AS label FROM po_entities""")
def apply_rules(spark, d):
    out = T.apply_rules(F.lit("unknown"), F.col("text"), B.Box.of(), 2480, 3508)
    return entities(spark, d).select(*KEY, out.alias("label"))


@query("clean_part_number", """
SELECT doc_id, entity_seq, regexp_replace(concat('SHISAKU-', CAST(line_no AS VARCHAR), '_', text), '^SHISAKU-[0-9]+_', '') AS part
FROM po_entities WHERE label = 'Part number'""")
def clean_part_number(spark, d):
    raw = F.concat(F.lit("SHISAKU-"), F.col("line_no").cast("string"), F.lit("_"), F.col("text"))
    return entities(spark, d).filter("label = 'Part number'").select(*KEY, T.clean_part_number(raw).alias("part"))


@query("normalize_value", """
SELECT doc_id, entity_seq, TRY_CAST(replace(text, ',', '') AS DOUBLE) AS number,
 coalesce(try_strptime(trim(text), '%Y-%m-%d'), try_strptime(trim(text), '%Y/%m/%d'), try_strptime(trim(text), '%d-%m-%Y'),
          try_strptime(trim(text), '%d/%m/%Y')) AS day,
 lower(text) IN ('true', '1', 'yes', 'on', 'checked') AS checked, trim(text) AS plain
FROM po_entities WHERE label IN ('Unit price', 'Delivery date', 'Item number')""")
def normalize_value(spark, d):
    t = F.col("text")
    return entities(spark, d).filter("label IN ('Unit price', 'Delivery date', 'Item number')").select(
        *KEY, N.number(t).alias("number"), N.date(t).cast("timestamp_ntz").alias("day"), N.checkbox(t).alias("checked"), F.trim(t).alias("plain"))


@query("standardize_date", """
SELECT doc_id, entity_seq, coalesce(strftime(try_strptime(text, '%m-%d-%Y'), '%Y-%m-%d'), text) AS iso,
 coalesce(strftime(try_strptime(text, '%m-%d-%Y'), '%m/%d/%Y'), text) AS us
FROM po_entities WHERE label IN ('Delivery date', 'Quantity')""")
def standardize_date(spark, d):
    t = F.col("text")
    return entities(spark, d).filter("label IN ('Delivery date', 'Quantity')").select(
        *KEY, N.standardize_date(t, "YYYY-MM-DD").alias("iso"), N.standardize_date(t, "MM/DD/YYYY").alias("us"))


@query("format_quantity", """
SELECT doc_id, entity_seq, concat(regexp_extract(text, '^([0-9]+)', 1), '.00', ' ST') AS text FROM po_entities WHERE label = 'Quantity'""")
def format_quantity(spark, d):
    return entities(spark, d).filter("label = 'Quantity'").select(*KEY, N.format_quantity(F.col("text"), 2).alias("text"))


def _common_sql() -> str:
    """One replacement behind a digit, then one before a digit, for every confusable character."""
    out = "ocr_original"
    for right, wrong in N.CONFUSIONS.items():
        for ch in wrong:
            out = f"regexp_replace(regexp_replace({out}, '([0-9])[{ch}]', '\\1{right}', 'g'), '[{ch}]([0-9])', '{right}\\1', 'g')"
    return out


@query("fix_common_ocr", f"SELECT doc_id, entity_seq, CASE WHEN regexp_matches(ocr_original, '[0-9]') THEN {_common_sql()} ELSE ocr_original END AS text FROM po_entities")
def fix_common_ocr(spark, d):
    return entities(spark, d).select(*KEY, N.fix_common_ocr(F.col("ocr_original")).alias("text"))


@query("fix_order_regex", """
SELECT doc_id, entity_seq, CASE WHEN length(ocr_original) = 10 THEN translate(ocr_original, 'OoIlSs', '000055') ELSE ocr_original END AS text
FROM po_entities WHERE label = 'Order number'""")
def fix_order_regex(spark, d):
    return entities(spark, d).filter("label = 'Order number'").select(*KEY, N.fix_order_number(F.col("ocr_original")).alias("text"))


ERROR_SQL = """CASE WHEN length(ocr_original) > length(text) THEN 'extra_chars' WHEN length(ocr_original) < length(text) THEN 'missing_chars'
 WHEN ocr_original = text THEN 'other' ELSE (
  SELECT CASE WHEN o || c IN ('I1', 'l1') THEN 'I_to_1' WHEN o || c IN ('O0', 'o0') THEN 'O_to_0' WHEN o || c IN ('S5', 's5') THEN 'S_to_5'
   WHEN o || c = 'B8' THEN 'B_to_8' ELSE 'char_substitution_' || o || '_to_' || c END
  FROM (SELECT substring(ocr_original, CAST(list_min(list_filter(range(1, length(text) + 1), lambda i: substring(ocr_original, CAST(i AS INT), 1) <> substring(text, CAST(i AS INT), 1))) AS INT), 1) AS o,
               substring(text, CAST(list_min(list_filter(range(1, length(text) + 1), lambda i: substring(ocr_original, CAST(i AS INT), 1) <> substring(text, CAST(i AS INT), 1))) AS INT), 1) AS c)) END"""


@query("error_type", f"SELECT doc_id, entity_seq, {ERROR_SQL} AS error_type FROM po_entities WHERE ocr_original <> '' AND text <> ''")
def error_type(spark, d):
    return entities(spark, d).filter("ocr_original <> '' AND text <> ''").select(
        *KEY, N.error_type(F.col("ocr_original"), F.col("text")).alias("error_type"))


@query("extract_after_keyword", """
SELECT doc_id, entity_seq, nullif(regexp_extract(trim(substring(text, position('total' IN lower(text)) + 5)), '^\\$?([0-9]+\\.?[0-9]*)', 1), '') AS amount,
 CASE WHEN position('kofu' IN lower(text)) > 0 THEN nullif(regexp_extract(trim(substring(text, position('kofu' IN lower(text)) + 4)), '^(\\S+)', 1), '') END AS mark
FROM po_entities WHERE label IN ('Net amount (total)', 'Case mark')""".replace("nullif(regexp_extract(trim(substring(text, position('total'", "CASE WHEN position('total' IN lower(text)) > 0 THEN nullif(regexp_extract(trim(substring(text, position('total'").replace(", '') AS amount", ", '') END AS amount"))
def extract_after_keyword(spark, d):
    t = F.col("text")
    return entities(spark, d).filter("label IN ('Net amount (total)', 'Case mark')").select(
        *KEY, N.after_keyword(t, "Total", "currency").alias("amount"), N.after_keyword(t, "Kofu", "alphanumeric").alias("mark"))


@query("validate_data_type", """
SELECT doc_id, entity_seq, regexp_matches(text, '^[A-Za-z0-9_-]+$') AS alphanumeric, TRY_CAST(text AS DOUBLE) IS NOT NULL AS number,
 regexp_matches(text, '^\\$?[0-9]+\\.?[0-9]*$') AS currency, regexp_matches(text, '^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$') AS date,
 length(text) > 0 AS text FROM po_entities""")
def validate_data_type(spark, d):
    t = F.col("text")
    kinds = ["alphanumeric", "number", "currency", "date", "text"]
    return entities(spark, d).select(*KEY, *[N.has_type(t, k).alias(k) for k in kinds])


FILE_SQL = """(SELECT doc_id, page_number, entity_seq, concat('20240101_120000_', text, '-', CAST(doc_id AS VARCHAR), '.pdf_page', CAST(line_no + 1 AS VARCHAR), '_label.json') AS name FROM po_entities WHERE label = 'Order number' OR label = 'Part number')"""


def file_names(spark, d):
    name = F.concat(F.lit("20240101_120000_"), F.col("text"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf_page"),
                    (F.col("line_no") + 1).cast("string"), F.lit("_label.json"))
    return entities(spark, d).filter("label IN ('Order number', 'Part number')").select("doc_id", "page_number", "entity_seq", name.alias("name"))


@query("core_name", f"SELECT doc_id, entity_seq, regexp_extract(name, '^[0-9]{{8}}_[0-9]{{6}}_(.+?)(?:\\.pdf)?(?:_page[0-9]+)?(?:_label)?(?:\\.json)?$', 1) AS core FROM {FILE_SQL} f".replace("po_entities", "po_entities"))
def core_name(spark, d):
    return file_names(spark, d).select(*KEY, T.core_name(F.col("name")).alias("core"))


@query("page_from_name", """
SELECT doc_id, entity_seq, text AS base, CAST(line_no + 1 AS INT) AS page FROM po_entities WHERE label = 'Part number'
UNION ALL SELECT doc_id, entity_seq, text, 1 FROM po_entities WHERE label = 'Order number'""")
def page_from_name(spark, d):
    e = entities(spark, d).filter("label IN ('Order number', 'Part number')")
    name = F.when(F.col("label") == "Order number", F.col("text")).otherwise(
        F.concat(F.col("text"), F.lit("_page_"), F.lpad((F.col("line_no") + 1).cast("string"), 3, "0"), F.lit(".png")))
    base, page = T.page_name(name)
    return e.select(*KEY, base.alias("base"), page.alias("page"))


@query("doc_type_from_name", """
SELECT page_id, CASE WHEN position('po' IN lower(url)) > 0 OR position('purchase' IN lower(url)) > 0 THEN 'purchase_order'
 WHEN position('invoice' IN lower(url)) > 0 THEN 'invoice' WHEN position('receipt' IN lower(url)) > 0 THEN 'receipt' ELSE 'other' END AS doc_type,
 CASE WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.(png|jpg|jpeg|tiff|tif|bmp)$') THEN 'image' ELSE 'unknown' END AS kind
FROM pages""")
def doc_type_from_name(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.doc_type_of(u).alias("doc_type"), T.file_kind(u).alias("kind"))


@query("record_score", """
SELECT doc_id, entity_seq, round(least(1.0E0, 0.5E0 + CASE WHEN NOT was_corrected THEN 0.3E0 ELSE 0 END + CASE WHEN line_no > 0 THEN 0.1E0 ELSE 0 END + ocr_confidence * 0.1E0), 6) AS score
FROM po_entities""")
def record_score(spark, d):
    s = S.record_score(~F.col("was_corrected"), F.col("line_no") > 0, F.col("ocr_confidence"))
    return entities(spark, d).select(*KEY, F.round(s, 6).alias("score"))


@query("resolution_lookup", """
SELECT doc_id, entity_seq, r.dpi FROM po_entities e LEFT JOIN (VALUES ('Order number', 150), ('Shipping line', 100), ('Case mark', 100),
 ('Item number', 200), ('Part number', 200), ('Delivery date', 150), ('Quantity', 200), ('Unit price', 200), ('Net amount (total)', 150)) r(label, dpi)
 ON e.label = r.label""")
def resolution_lookup(spark, d):
    return entities(spark, d).join(rule_table(spark, S.RESOLUTION, "label string, dpi int"), "label", "left").select(*KEY, "dpi")


@query("filename_score", """SELECT page_id, CASE WHEN regexp_matches(lower(url), '(po|purchase|order)') THEN 0.8E0 ELSE 0.0E0 END AS score FROM pages""")
def filename_score(spark, d):
    return table(spark, d, "pages").select("page_id", S.filename_score(F.col("url")).alias("score"))


@query("layout_score", """
SELECT doc_id, round(least(1.0E0, CASE WHEN bool_or(y < 526) THEN 0.3E0 ELSE 0 END + CASE WHEN bool_or(label = 'Item number') THEN 0.4E0 ELSE 0 END
 + CASE WHEN count(*) > 10 THEN 0.3E0 ELSE 0 END), 6) AS score FROM po_entities GROUP BY doc_id""")
def layout_score(spark, d):
    return entities(spark, d).groupBy("doc_id").agg(
        F.bool_or(F.col("y") < 526).alias("h"), F.bool_or(F.col("label") == "Item number").alias("t"), F.count("*").alias("n")
    ).select("doc_id", F.round(S.layout_score(F.col("h"), F.col("t"), F.col("n")), 6).alias("score"))


@query("angle_direction", """
WITH c AS (SELECT doc_id, entity_seq, x + width / 2 - 1240 AS dx, y + height / 2 - 1754 AS dy FROM po_entities)
SELECT doc_id, entity_seq, ['right', 'bottom-right', 'bottom', 'bottom-left', 'left', 'top-left', 'top', 'top-right'][
 CAST(((CAST(trunc((atan2(dy, dx) * 180 / 3.141592653589793E0 + 22.5E0) / 45) AS INT) % 8) + 8) % 8 AS INT) + 1] AS direction FROM c""")
def angle_direction(spark, d):
    b = B.Box.of()
    return entities(spark, d).select(*KEY, B.direction(b.cy - 1754, b.cx - 1240).alias("direction"))


@query("content_hash", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in G.content_hash(F.col("text")).items()])


LABEL_SIG = """
sig AS (SELECT doc_id, substring(md5(string_agg(cell, '|' ORDER BY rn)), 1, 8) AS signature FROM (
  SELECT doc_id, cell, row_number() OVER (PARTITION BY doc_id ORDER BY cell, entity_seq) AS rn FROM (
   SELECT doc_id, entity_seq, concat(label, ':', CAST(CAST(floor(x * 10 / 2480) AS BIGINT) AS VARCHAR), ',', CAST(CAST(floor(y * 10 / 3508) AS BIGINT) AS VARCHAR)) AS cell FROM po_entities)
 ) WHERE rn <= 20 GROUP BY doc_id)"""


@query("layout_signature_md5", f"WITH {LABEL_SIG} SELECT doc_id, signature FROM sig")
def layout_signature_md5(spark, d):
    return G.label_grid_signature(entities(spark, d)).select("doc_id", "signature")


GRID_SIG = """
grid AS (SELECT doc_id, string_agg(concat(CAST(rn - 1 AS VARCHAR), ':', CAST(CAST(floor(x / 10) AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor(y / 10) AS BIGINT) AS VARCHAR), ':',
   CAST(CAST(floor(length(text) / 5) AS BIGINT) AS VARCHAR)), '|' ORDER BY rn) AS signature FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, entity_seq) AS rn FROM po_entities) WHERE rn <= 10 GROUP BY doc_id)"""


@query("layout_signature_grid", f"WITH {GRID_SIG} SELECT doc_id, signature FROM grid")
def layout_signature_grid(spark, d):
    return G.reading_grid_signature(entities(spark, d)).select("doc_id", "signature")


@query("signature_similarity", f"""
WITH {GRID_SIG}
SELECT a.doc_id, CASE WHEN len(string_split(a.signature, '|')) <> len(string_split(b.signature, '|')) THEN 0.0E0 ELSE
 round(len(list_filter(list_zip(string_split(a.signature, '|'), string_split(b.signature, '|')), lambda p: p[1] = p[2])) / len(string_split(a.signature, '|')), 6) END AS similarity
FROM grid a JOIN grid b ON b.doc_id = a.doc_id + 3""")
def signature_similarity(spark, d):
    sig = G.reading_grid_signature(entities(spark, d)).select("doc_id", "signature")
    other = sig.select((F.col("doc_id") - 3).alias("doc_id"), F.col("signature").alias("other"))
    return sig.join(other, "doc_id").select("doc_id", F.round(G.similarity(F.col("signature"), F.col("other")), 6).alias("similarity"))


@query("quality_grade", """
WITH q AS (SELECT doc_id, entity_seq, ocr_confidence AS s, least(width * 5 / 1000, 1.0E0) * 0.3E0 + least(height / 100, 1.0E0) * 0.3E0
  + (1 - abs((x % 256) - 128) / 128) * 0.2E0 + greatest(0.0E0, 1 - (y % 60) / 50) * 0.2E0 AS iq FROM po_entities)
SELECT doc_id, entity_seq, CASE WHEN s >= 0.9E0 THEN 'excellent' WHEN s >= 0.7E0 THEN 'good' WHEN s >= 0.5E0 THEN 'fair' ELSE 'poor' END AS band,
 round(iq, 8) AS image_score, CASE WHEN iq >= 0.8E0 THEN 'ultra' WHEN iq >= 0.6E0 THEN 'high' WHEN iq >= 0.4E0 THEN 'medium' ELSE 'low' END AS image_grade FROM q""")
def quality_grade(spark, d):
    iq = S.image_quality(F.col("width") * 5, F.col("height"), F.col("x") % 256, F.col("y") % 60)
    return entities(spark, d).select(*KEY, S.quality_band(F.col("ocr_confidence")).alias("band"), F.round(iq, 8).alias("image_score"),
                                     S.image_grade(iq).alias("image_grade"))


@query("json_profile", """
WITH j AS (SELECT props::JSON AS p FROM events), k AS (SELECT unnest(json_keys(p)) AS name, p FROM j)
SELECT name, count(*) AS n, count(*) FILTER (json_type(p, '$.' || name) = 'OBJECT') AS objects,
 count(*) FILTER (json_type(p, '$.' || name) = 'ARRAY') AS arrays,
 count(DISTINCT CASE json_type(p, '$.' || name) WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string'
   WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'null' END) = 1 AS uniform
FROM k GROUP BY name""")
def json_profile_query(spark, d):
    return json_profile(table(spark, d, "events"), "props")
