"""Business rules over the boxes of an order page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import PAGE

# Rules by label: shape, range, required partner label.
FORMATS = {"Order number": "^[0-9]{10}$", "Quantity": r"^[0-9]+\.[0-9]{3}\s+[A-Za-z0-9_]{2}$", "Delivery date": "^[0-9]{2}-[0-9]{2}-[0-9]{4}$"}
RANGES = {"Quantity": (0.001, 999999.999), "Unit price": (0.0001, 999999.9999)}
REQUIRES = {"Order number": "Shipping line", "Delivery date": "Order number", "Unit price": "Quantity"}


def amount(text: Column, scale: int = 4) -> Column:
    """First number in a text, thousands commas dropped."""
    return F.replace(F.regexp_extract(text, r"([0-9,]+\.?[0-9]*)", 1), F.lit(","), F.lit("")).try_cast(f"decimal(18,{scale})")


def sum_check(boxes: DataFrame, group: str = "line_no", tolerance: float = 0.01) -> DataFrame:
    """Sum of quantity x unit price over the item groups of a page against its stated total.

    Boxes are reduced per group and then per page (both combined map-side); pages without a total or items are left out.
    """
    value = lambda label: F.max(F.when(F.col("label") == label, amount(F.col("text"))))
    lines = boxes.filter(F.col("label").isin("Quantity", "Unit price")).groupBy(*PAGE, group).agg(value("Quantity").alias("q"), value("Unit price").alias("u"))
    totals = boxes.filter("label = 'Net amount (total)'").groupBy(*PAGE).agg(F.min_by(amount(F.col("text")), "entity_seq").alias("stated"))
    item = (F.col("q") * F.col("u")).cast("decimal(28,4)")
    sums = lines.filter("q IS NOT NULL AND u IS NOT NULL AND q <> 0 AND u <> 0").groupBy(*PAGE).agg(F.sum(item).alias("calculated"), F.count("*").alias("lines"))
    gap = F.abs(F.col("stated") - F.col("calculated"))
    return sums.join(totals, PAGE).select(
        *PAGE, "lines", F.round(F.col("calculated") * 100).cast("long").alias("calculated_cents"), F.round(F.col("stated") * 100).cast("long").alias("stated_cents"),
        (gap <= tolerance).alias("is_valid"))


def business_rules(boxes: DataFrame) -> DataFrame:
    """Broken rules: format and range per box, required partner label per page."""
    label, text = F.col("label"), F.col("text")
    shape, bad_range = F.lit(False), F.lit(False)
    for name, pattern in FORMATS.items():
        shape = shape | ((label == name) & ~text.rlike(pattern))
    for name, (low, high) in RANGES.items():
        value = amount(text).cast("double")
        bad_range = bad_range | ((label == name) & F.coalesce((value < low) | (value > high), F.lit(True)))
    broken = F.array_compact(F.array(F.when(shape, "format"), F.when(bad_range, "range")))
    single = boxes.select(*PAGE, "entity_seq", "label", F.explode(broken).alias("rule"))
    need = F.create_map(*[F.lit(v) for kv in REQUIRES.items() for v in kv])
    asked = boxes.filter(label.isin(list(REQUIRES))).select(*PAGE, "entity_seq", "label", need[label].alias("_need"))
    have = boxes.select(*PAGE, F.col("label").alias("_need")).distinct()
    lacking = asked.join(have, [*PAGE, "_need"], "left_anti").select(*PAGE, "entity_seq", "label", F.lit("dependency").alias("rule"))
    return single.unionByName(lacking)


def missing_fields(boxes: DataFrame, expected: list[str], priority: list[str]) -> DataFrame:
    """Expected labels a page lacks, the priority labels first."""
    order = sorted(expected, key=lambda v: (priority.index(v) if v in priority else len(priority)))
    found = boxes.groupBy(*PAGE).agg(F.collect_set(F.when(F.col("label").isin(expected), F.col("label"))).alias("found"))
    return found.select(*PAGE, F.array_except(F.array(*[F.lit(v) for v in order]), F.col("found")).alias("missing"))


def required_fields(mapped: DataFrame, pages: DataFrame, required: list[str]) -> DataFrame:
    """One row per page and required field that was not mapped."""
    want = pages.select(*PAGE, F.explode(F.array(*[F.lit(v) for v in required])).alias("field"))
    return want.join(mapped.select(*PAGE, "field").distinct(), [*PAGE, "field"], "left_anti")


def line_item_check(items: DataFrame) -> DataFrame:
    """Quantity of 0 or less, negative price, or not a number."""
    q, p = F.col("quantity").try_cast("double"), F.replace(F.col("unit_price"), F.lit("$"), F.lit("")).try_cast("double")
    text = q.isNull() | p.isNull()
    problem = F.when(text, "non-numeric quantity or price").when((q <= 0) | (p < 0), "invalid quantity or price")
    return items.filter("quantity IS NOT NULL AND unit_price IS NOT NULL").withColumn("problem", problem)


def template_completeness(boxes: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Share of required labels present and the lists of missing ones."""
    known = required + optional
    found = boxes.groupBy(*PAGE).agg(F.collect_set(F.when(F.col("label").isin(known), F.col("label"))).alias("found"))
    req, opt = F.array(*[F.lit(v) for v in required]), F.array(*[F.lit(v) for v in optional])
    return found.select(
        *PAGE, (F.size(F.array_intersect(req, F.col("found"))) / len(required)).alias("rate"),
        F.concat_ws(",", F.array_except(req, F.col("found"))).alias("missing_required"), F.concat_ws(",", F.array_except(opt, F.col("found"))).alias("missing_optional"))


def field_overlap(boxes: DataFrame, template: list[str]) -> DataFrame:
    """Labels of a page inside and outside a template (labels of a page come from a vocabulary)."""
    found = boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_set("label")).alias("found"))
    t = F.array(*[F.lit(v) for v in template])
    return found.select(*PAGE, F.concat_ws(",", F.array_intersect("found", t)).alias("shared"), F.concat_ws(",", F.array_except("found", t)).alias("extra"))
