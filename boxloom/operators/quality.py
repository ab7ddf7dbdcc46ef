"""Dataset validation: completeness, accuracy, consistency, statistics, splits, reports.

Items: doc_id, document_id, status, document_type. Fields: doc_id, page_number, entity_seq, field_name, text_value, x, y,
width, height, confidence_score.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import normalize as N
from ..functions.bbox import Box, errors as box_errors
from ..functions.scores import quality_band
from ..scale import PAGE, beside, cut
from .relations import overlap_pairs, overlap_penalty

# Accepted states and the share of each part in the overall score.
STATUSES = ["pending", "in_progress", "completed", "validated"]
WEIGHTS = {"completeness": 0.4, "accuracy": 0.3, "consistency": 0.3}
SPLIT = {"train": 0.7, "validation": 0.2, "test": 0.1}
MIN_SPLIT = {"train": 100, "validation": 20, "test": 10}
CRITERIA = {"min_dataset_size": 10, "min_quality_score": 0.8, "min_completeness_score": 0.9, "min_consistency_score": 0.85}
UUID = "^[^-]*-[^-]*-[^-]*-[^-]*-[^-]*$"


def check_criteria(criteria: Mapping[str, float]) -> dict[str, float]:
    """Scores lie in 0..1, sizes are 1 or more."""
    for name, value in criteria.items():
        if name.endswith("_score") and not 0 <= value <= 1:
            raise ValueError(f"{name} must be between 0 and 1: {value}")
        if name.endswith("_size") and value < 1:
            raise ValueError(f"{name} must be positive: {value}")
    return dict(criteria)


def is_uuid(c: Column) -> Column:
    return (F.length(c) == 36) & c.rlike(UUID)


def field_flags(fields: DataFrame) -> DataFrame:
    """Per document whether all its fields are complete and accurate (map-side combined)."""
    box = [F.col(c) for c in ("x", "y", "width", "height")]
    present = F.col("field_name").isNotNull() & (F.trim("text_value") != "") & ~F.coalesce(*[F.when(c.isNull(), True) for c in box], F.lit(False))
    accurate = (F.col("confidence_score") >= 0.7) & (F.least(*box) >= 0)
    return fields.groupBy("doc_id").agg(
        F.bool_and(F.coalesce(present, F.lit(False))).alias("complete"), F.bool_and(F.coalesce(accurate, F.lit(False))).alias("accurate"),
        F.avg("confidence_score").alias("confidence"), F.count("*").alias("n_fields"))


def keys_of(items: DataFrame) -> Column:
    """Which optional columns an item has, as text."""
    return F.concat_ws(",", *[F.when(F.col(c).isNotNull(), c) for c in ("document_id", "status", "document_type")])


def item_checks(items: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per item with every check as a flag."""
    flags = field_flags(fields)
    n = lambda c: F.coalesce(c, F.lit(False))
    joined = items.join(flags, "doc_id", "left")
    return joined.select(
        "doc_id", keys_of(items).alias("keys"),
        (n("complete") & F.col("document_id").isNotNull() & F.col("status").isNotNull()).alias("is_complete"),
        n("complete").alias("fields_complete"), n("accurate").alias("fields_accurate"),
        (n("accurate") & F.col("document_id").isNotNull() & n(F.col("status").isin(STATUSES))).alias("is_accurate"),
        n(is_uuid(F.col("document_id"))).alias("named"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


def _share(flag: str | Column) -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.count_if(c) / F.count("*")


def quality_scores(items: DataFrame, fields: DataFrame) -> DataFrame:
    """Completeness, accuracy, the three consistency parts and the weighted score.

    The first item (smallest doc_id) sets the expected keys. Agreement of field names with the union of all names is 1 by
    definition; the share of items that use every name stands beside it.
    """
    checks = item_checks(items, fields)
    first = checks.agg(F.min_by("keys", "doc_id").alias("expected"))
    names = fields.agg(F.count_distinct("field_name").alias("all_names"))
    used = fields.groupBy("doc_id").agg(F.count_distinct("field_name").alias("used_names"))
    rows = checks.join(used, "doc_id", "left").transform(beside, first).transform(beside, names)
    got = rows.agg(
        _share("is_complete").alias("completeness"), _share("is_accurate").alias("accuracy"), _share(F.col("keys") == F.col("expected")).alias("schema_consistency"),
        F.lit(1.0).alias("annotation_consistency"), _share("named").alias("naming_consistency"),
        _share(F.coalesce("used_names", F.lit(0)) == F.col("all_names")).alias("name_coverage"), F.count("*").alias("total_items"),
        F.count_if("fields_complete").alias("completed_items"), F.count_if("fields_accurate").alias("accurate_items"))
    consistency = (F.col("schema_consistency") + F.col("annotation_consistency") + F.col("naming_consistency")) / 3
    return got.withColumn("consistency", consistency).withColumn(
        "overall", F.col("completeness") * WEIGHTS["completeness"] + F.col("accuracy") * WEIGHTS["accuracy"] + F.col("consistency") * WEIGHTS["consistency"])


MIDDLE_BITS = (48, 32, 16, 0)  # each step cuts a bucket of values into at most 65,536


def medians(counts: DataFrame) -> DataFrame:
    """measure, median of a table measure, v (whole number), f (how often).

    Selection by successive histograms: the bucket that holds the middle rank is found, then the finer bucket inside it. No
    task ever sees more than the buckets of one step, however many distinct values there are.
    """
    total = counts.groupBy("measure").agg(F.sum("f").alias("n"))
    # Lower and upper middle; they are one for an odd number of values.
    rank = F.explode(F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1"))).alias("rank")
    want = total.select("measure", rank, F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("bucket")).distinct()
    upper = None
    for bits in MIDDLE_BITS:
        fine = F.shiftright("v", bits)
        group = ["measure", *([] if upper is None else ["bucket"])]
        rows = counts.select("measure", fine.alias("_b"), "f", *([] if upper is None else [F.shiftright("v", upper).alias("bucket")]))
        met = rows.groupBy(*group, "_b").agg(F.sum("f").alias("f")).join(want if upper is not None else want.drop("bucket"), group)
        w = W.partitionBy("measure", "rank").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        placed = met.withColumn("below", F.col("below") + F.coalesce(F.sum("f").over(w), F.lit(0)))
        want = placed.filter((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("f"))).select("measure", "rank", "below", F.col("_b").alias("bucket"))
        upper = bits
    return want.groupBy("measure").agg(F.avg("bucket").alias("median"))


def value_statistics(values: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, smallest and largest per ``measure`` of whole numbers ``v``; nulls are left out, a measure
    without values has no row.

    Equal values are counted first. The moments are sums of whole numbers around the rounded mean, so no order of rows changes
    them and squares of large sums do not occur; the deviation of one value is 0.
    """
    counts = cut(values.filter("v IS NOT NULL").groupBy("measure", "v").agg(F.count("*").alias("f")))
    v, f = F.col("v").cast("decimal(20,0)"), F.col("f")
    first = counts.groupBy("measure").agg(F.sum("f").alias("n"), (F.sum(v * f) / F.sum("f")).alias("m"), F.min("v").cast("double").alias("min"), F.max("v").cast("double").alias("max"))
    off = v - F.round("m").cast("decimal(20,0)")
    n = F.first("n")
    s1, s2 = F.sum(off * f).cast("double"), F.sum((off * off).cast("decimal(38,0)") * f).cast("double")
    second = counts.join(first.select("measure", "n", "m"), "measure").groupBy("measure").agg(
        F.when(n > 1, F.sqrt((s2 - s1 * s1 / n) / (n - 1))).otherwise(0.0).alias("std"))
    return first.join(second, "measure").join(medians(counts), "measure").select("measure", F.col("m").cast("double").alias("mean"), "median", "std", "min", "max")


def dataset_statistics(items: DataFrame, fields: DataFrame) -> DataFrame:
    """Confidence (in hundredths), box area, fields per document, text length: mean, median, deviation, range."""
    per_doc = items.select("doc_id").join(fields.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    measured = {"confidence_cents": F.round(F.col("confidence_score") * 100), "area": Box.of().area, "text_length": F.length("text_value")}
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), c.cast("long").alias("v")) for name, c in measured.items()])).alias("m")
    values = fields.select(pairs).select("m.*").unionByName(
        per_doc.select(F.lit("fields_per_document").alias("measure"), F.coalesce("n", F.lit(0)).cast("long").alias("v")))
    return value_statistics(values)


def quality_bands(fields: DataFrame) -> DataFrame:
    """Documents per quality band: half mean confidence, half 1 (or 0.5 when a text is empty)."""
    per = fields.groupBy("doc_id").agg(F.avg("confidence_score").alias("m"), F.bool_and(F.trim("text_value") != "").alias("full"))
    score = (F.col("m") + F.when(F.col("full"), 1.0).otherwise(0.5)) / 2
    return per.withColumn("band", quality_band(F.round(score, 9))).groupBy("band").agg(F.count("*").alias("n"))


def approx_statistics(fields: DataFrame) -> DataFrame:
    """Distinct documents and quantiles with bounded memory, for value ranges without a bound."""
    return fields.agg(F.approx_count_distinct("doc_id").alias("documents"), F.percentile_approx("confidence_score", [0.25, 0.5, 0.75]).alias("confidence_quartiles"),
                      F.percentile_approx(Box.of().area, 0.5).alias("area_median"))


# --- checks of one page -------------------------------------------------------------------------------------------


def check_duplicates(fields: DataFrame) -> DataFrame:
    """Repeated field names of a page, with the first and the last box."""
    return fields.groupBy(*PAGE, "field_name").agg(F.count("*").alias("n"), F.min("entity_seq").alias("first"), F.max("entity_seq").alias("last")).filter("n > 1")


def check_types(raw: DataFrame) -> DataFrame:
    """Text columns that must be numbers, and missing names or texts: one row per problem."""
    tests = [F.when(F.col("field_name").isNull(), "field_name must be string"), F.when(F.col("text_value").isNull(), "text_value must be string")]
    tests += [F.when(F.col(c).try_cast("double").isNull(), f"bounding_box.{c} must be number") for c in ("x", "y", "width", "height")]
    return raw.select(*PAGE, "entity_seq", F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def check_coordinates(fields: DataFrame) -> DataFrame:
    b = Box.of()
    ratio = b.width / F.nullif(b.height, F.lit(0))
    tests = [
        F.when((b.x < 0) | (b.y < 0), "negative coordinates not allowed"),
        F.when((b.width <= 0) | (b.height <= 0), "width and height must be positive"),
        F.when((b.width > 0) & (b.height > 0) & ((ratio > 20) | (ratio < 0.05)), "unusual aspect ratio"),
    ]
    return fields.select(*PAGE, "entity_seq", F.explode(F.array_compact(F.array(*tests))).alias("problem"))


#: Rules by name: each gives a row per problem with the page's key. Types are fixed by the schema of checked fields; for raw
#: ones ``check_types`` can be added under a name of its own.
CONSISTENCY_RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "annotation_overlap": overlap_pairs, "field_name_consistency": check_duplicates, "coordinate_consistency": check_coordinates}


def consistency_errors(fields: DataFrame, rules: Mapping[str, Callable[[DataFrame], DataFrame]] = CONSISTENCY_RULES) -> DataFrame:
    """All problems of all pages by the name of the rule."""
    found = [rule(fields).select(*PAGE, F.lit(name).alias("rule")) for name, rule in rules.items()]
    out = found[0] if found else fields.limit(0).select(*PAGE, F.lit("").alias("rule"))
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def consistency_score(items: DataFrame, fields: DataFrame, minimum: float = CRITERIA["min_consistency_score"],
                      rules: Mapping[str, Callable[[DataFrame], DataFrame]] = CONSISTENCY_RULES) -> DataFrame:
    """max(0, 1 - problems / items) and whether it passes."""
    problems = consistency_errors(fields, rules).agg(F.count("*").alias("total_errors"))
    score = F.greatest(F.lit(0.0), 1 - F.col("total_errors") / F.col("items"))
    return items.agg(F.count("*").alias("items")).transform(beside, problems).select("items", "total_errors", score.alias("score"), (score >= minimum).alias("passed"))


def annotation_quality(fields: DataFrame) -> DataFrame:
    """0.4 confidence + 0.4 completeness + 0.2 consistency per page. ``fields`` adds field_type, is_valid."""
    normal = F.when(F.col("field_type") == "number", N.number(F.col("text_value")).isNotNull()).when(
        F.col("field_type") == "date", N.date(F.col("text_value")).isNotNull()).otherwise(F.col("text_value") != "")
    per = fields.groupBy(*PAGE).agg(
        F.avg("confidence_score").alias("confidence"), _share(F.col("is_valid") & (F.trim("text_value") != "")).alias("completeness"), _share(normal).alias("format"))
    both = per.join(overlap_penalty(fields), PAGE)
    # Every field type comes from the fixed list, so type consistency is 1.
    agree = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + F.col("format")) / 2 - F.col("penalty")))
    return both.withColumn("consistency", agree).withColumn("quality", F.col("confidence") * 0.4 + F.col("completeness") * 0.4 + F.col("consistency") * 0.2).drop("format", "penalty")


def metric_report(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Count, mean, smallest, largest per metric."""
    long = scores.select(F.explode(F.create_map(*[v for m in metrics for v in (F.lit(m), F.col(m))])).alias("metric", "value"))
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("average"), F.min("value").alias("low"), F.max("value").alias("high"))


# --- fields, pages, documents ----------------------------------------------------------------------------------------


def validate_field(fields: DataFrame, confidence: float = 0.7, quality: float = 0.8, min_len: int = 1) -> DataFrame:
    """Error and warning texts per field. ``fields`` adds field_type, quality."""
    t, kind = F.col("text_value"), F.col("field_type")
    empty = (t == "") & (kind != "checkbox")
    error = F.when(empty, "Field value is required").when(
        (kind == "number") & N.number(t).isNull(), F.concat(F.lit("Invalid number format: "), t)).when(
        (kind == "date") & N.date(t).isNull(), F.concat(F.lit("Invalid date format: "), t)).when((kind == "text") & (F.length(t) < min_len), "Text too short")
    low = F.array_compact(F.array(F.when(F.col("confidence_score") < confidence, "low_confidence"), F.when(F.col("quality") < quality, "low_quality")))
    return fields.withColumn("error", error).withColumn("warnings", F.when(error.isNull(), F.concat_ws(",", low)).otherwise("")).withColumn("is_valid", error.isNull())


def validate_page(checked: DataFrame) -> DataFrame:
    """Fields, errors and completion per page."""
    return checked.groupBy(*PAGE).agg(
        F.count("*").alias("fields"), F.count_if(~F.col("is_valid")).alias("errors"), F.count_if("is_valid").alias("valid"),
        F.avg("confidence_score").alias("confidence"), F.avg("quality").alias("quality")
    ).withColumn("completion", F.col("valid") / F.col("fields") * 100).withColumn("is_valid", F.col("errors") == 0)


def validate_document(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Document problems: type, pages, page numbers, annotation count. ``docs``: doc_id, document_type, page_count, annotation_count."""
    n = F.count("*")
    seen = pages.groupBy("doc_id").agg(
        n.alias("pages"), F.sum("fields").alias("found"),
        ((F.min("page_number") == 1) & (F.max("page_number") == n) & (F.count_distinct("page_number") == n)).alias("consecutive"))
    tests = F.array_compact(F.array(
        F.when(F.col("document_type").isNull(), "Document type is unknown"),
        F.when((F.col("page_count") > 0) & F.col("pages").isNull(), "Page information is missing"),
        F.when(~F.coalesce("consecutive", F.lit(True)), "Page numbers are not consecutive"),
        F.when(F.col("annotation_count") != F.coalesce("found", F.lit(0)), "Annotation count mismatch")))
    return docs.join(seen, "doc_id", "left").select("doc_id", F.concat_ws("; ", tests).alias("errors"), (F.size(tests) == 0).alias("is_valid"))


def batch_summary(validated: DataFrame) -> DataFrame:
    """Valid and invalid rows, problems in total, rate."""
    return validated.agg(
        F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"),
        F.sum(F.when(F.col("errors") == "", 0).otherwise(F.size(F.split("errors", "; ")))).alias("problems"), _share("is_valid").alias("rate"))


def annotation_batch_report(pages: DataFrame) -> DataFrame:
    return pages.agg(
        F.count_if("is_valid").alias("valid_pages"), F.count_if(~F.col("is_valid")).alias("invalid_pages"), F.sum("errors").alias("errors"),
        F.sum("fields").alias("total_fields"), F.sum("valid").alias("validated_fields"), F.avg("confidence").alias("average_confidence"), F.avg("quality").alias("average_quality"))


def validate_item(items: DataFrame, fields: DataFrame) -> DataFrame:
    """Problems of one item: keys, state, id shape, boxes."""
    bad = fields.groupBy("doc_id").agg(F.bool_or(F.size(box_errors(Box.of())) > 0).alias("bad_box"), F.bool_or(F.trim("text_value") == "").alias("bad_text"))
    tests = F.array_compact(F.array(
        F.when(F.col("document_id").isNull(), "missing document_id"), F.when(F.col("status").isNull(), "missing status"),
        F.when(~F.col("status").isin(STATUSES), "invalid status"), F.when(~is_uuid(F.col("document_id")), "invalid document_id"),
        F.when(F.col("bad_box").isNull(), "no annotations"), F.when(F.col("bad_box"), "invalid bounding_box"), F.when(F.col("bad_text"), "empty text_value")))
    return items.join(bad, "doc_id", "left").select("doc_id", F.concat_ws("; ", tests).alias("errors"), (F.size(tests) == 0).alias("is_valid"))


def completeness_gate(items: DataFrame, criteria: Mapping[str, float] = CRITERIA) -> DataFrame:
    """Size and share of items with all required keys against the criteria."""
    c = check_criteria(criteria)
    full = F.col("document_id").isNotNull() & F.col("status").isNotNull()
    return items.agg(F.count("*").alias("n"), _share(full).alias("rate")).withColumn(
        "passed", (F.col("n") >= c["min_dataset_size"]) & (F.col("rate") >= c["min_completeness_score"]))


def basic_requirements(items: DataFrame, criteria: Mapping[str, float] = CRITERIA) -> DataFrame:
    """Missing required keys and size."""
    missing = F.sum(F.col("document_id").isNull().cast("int") + F.col("status").isNull().cast("int"))
    return items.agg(F.count("*").alias("total_items"), missing.alias("missing_fields")).withColumn(
        "passed", (F.col("missing_fields") == 0) & (F.col("total_items") >= criteria["min_dataset_size"]))


def split_sizes(items: DataFrame, ratios: Mapping[str, float] = SPLIT, minimum: Mapping[str, int] = MIN_SPLIT) -> DataFrame:
    """Sizes of the parts (whole numbers, rounded down) and whether each reaches its minimum."""
    if abs(sum(ratios.values()) - 1) > 0.001:
        raise ValueError("split ratios must add up to 1")
    sizes = items.agg(F.count("*").alias("total_size")).select("total_size", *[F.floor(F.col("total_size") * r).alias(f"{p}_size") for p, r in ratios.items()])
    ok = F.lit(True)
    for part, low in minimum.items():
        ok = ok & (F.col(f"{part}_size") >= low)
    return sizes.withColumn("split_valid", ok)


def validation_report(items: DataFrame, fields: DataFrame, criteria: Mapping[str, float] = CRITERIA) -> DataFrame:
    """All parts, the pass flag and the advice, in one row."""
    c = check_criteria(criteria)
    basic = basic_requirements(items, c).select("total_items", "missing_fields", F.col("passed").alias("basic_passed"))
    scores = quality_scores(items, fields).select("completeness", "accuracy", "consistency", "overall")
    agree = consistency_score(items, fields, c["min_consistency_score"]).select("total_errors", F.col("score").alias("consistency_score"), F.col("passed").alias("consistency_passed"))
    split = split_sizes(items).select("train_size", "validation_size", "test_size", "split_valid")
    row = basic.transform(beside, scores).transform(beside, agree).transform(beside, split)
    quality = F.col("overall") >= c["min_quality_score"]
    passed = F.col("basic_passed") & quality & F.col("consistency_passed") & F.col("split_valid")
    advice = F.concat_ws("; ", F.when(~passed, "improve data quality"), F.when(F.col("overall") < 0.8, "check annotation accuracy"),
                         F.when(F.col("total_errors") > 0, "review preprocessing"), F.when(passed & (F.col("overall") >= 0.8) & (F.col("total_errors") == 0), "keep validating"))
    return row.withColumn("quality_passed", quality).withColumn("validation_passed", passed).withColumn("advice", advice)


def rule_registry(df: DataFrame, rules: Mapping[str, Callable[[], Column]], keys: list[str]) -> DataFrame:
    """Pass or fail of each named rule per row, and the share of passed rules."""
    tests = {name: F.coalesce(make(), F.lit(False)) for name, make in rules.items()}
    total = sum((t.cast("int") for t in tests.values()), F.lit(0))
    return df.select(*keys, *[t.alias(n) for n, t in tests.items()], (total / max(len(tests), 1)).alias("success_rate"))
