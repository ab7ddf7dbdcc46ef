"""Counts and statistics over boxes, pages and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bbox import Box, region
from ..scale import PAGE, beside
from ..schema import PAGE_HEIGHT, PAGE_WIDTH


def label_distribution(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*(keys or ("label",))).agg(F.count("*").alias("n"))


def label_cube(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key alone and in total, in one pass."""
    return boxes.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.count("*").alias("n"), F.grouping_id(*keys).alias("level"))


def decimals_mode(boxes: DataFrame, min_confidence: float = 0.9) -> DataFrame:
    """Most common number of decimals of confident quantities (the smaller on ties) per document type."""
    d = F.length(F.regexp_extract("text", r"\.([0-9]+)", 1))
    per = boxes.filter((F.col("label") == "Quantity") & (F.col("ocr_confidence") > min_confidence)).withColumn("decimals", d).filter("decimals > 0")
    counts = per.groupBy("doc_type", "decimals").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_type").agg(F.max_by("decimals", F.struct("n", -F.col("decimals"))).alias("decimals"), F.sum("n").alias("n"))


# Date formats by shape, in order of trial.
DATE_SHAPES = [("MM-DD-YYYY", "^[0-9]{2}-[0-9]{2}-[0-9]{4}"), ("YYYY-MM-DD", "^[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("MM/DD/YYYY", "^[0-9]{2}/[0-9]{2}/[0-9]{4}")]


def date_format_vote(boxes: DataFrame, min_confidence: float = 0.9) -> DataFrame:
    """Format that all confident delivery dates of a document type share; null when they share none."""
    dates = boxes.filter((F.col("label") == "Delivery date") & (F.col("ocr_confidence") > min_confidence))
    seen = dates.groupBy("doc_type").agg(*[F.bool_and(F.col("text").rlike(s)).alias(f"_{i}") for i, (_, s) in enumerate(DATE_SHAPES)], F.count("*").alias("n"))
    pick = F.coalesce(*[F.when(F.col(f"_{i}"), F.lit(name)) for i, (name, _) in enumerate(DATE_SHAPES)])
    return seen.select("doc_type", pick.alias("format"), "n")


def document_statistics(pages: DataFrame) -> DataFrame:
    """One row over pages(text, lang, source, quality, noise, errors): sizes, types, quality, languages."""
    q = F.when(F.col("quality") > 0, F.col("quality"))
    size = F.length(F.trim("text"))
    langs = pages.groupBy("lang").agg(F.count("*").alias("n")).filter("lang IS NOT NULL")
    main = langs.agg(F.max_by("lang", F.struct("n", "lang")).alias("primary_language"), F.count("*").alias("languages"))
    whole = pages.agg(
        F.count("*").alias("total_pages"), F.sum(size).alias("total_text_length"), F.count_if(size == 0).alias("blank_pages"),
        F.avg(q).alias("avg_quality"), F.min(q).alias("min_quality"), F.max(q).alias("max_quality"),
        F.count_if("noise").alias("pages_with_noise"), F.count_if(F.col("errors") > 0).alias("pages_with_errors"), F.sum("errors").alias("total_errors"))
    return whole.transform(beside, main)


def _spread(c: str | Column, name: str) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]


def box_statistics(boxes: DataFrame) -> DataFrame:
    """Mean, population deviation, smallest and largest width, height, area, confidence per page."""
    return boxes.groupBy(*PAGE).agg(
        *_spread("width", "width"), *_spread("height", "height"), *_spread(Box.of().area, "area"), *_spread("ocr_confidence", "confidence"))


def document_text(pages: DataFrame, doc: str, page: str, text: str, part: int = 1000) -> DataFrame:
    """Page texts joined by a blank line in page order; ``part`` pages at a time, and then the parts."""
    joined = lambda key, t: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(t).alias("t")))), lambda s: s["t"]), "\n\n")
    parts = pages.groupBy(doc, F.expr(f"{page} div {part}").alias("part")).agg(joined(page, text).alias("full_text"), F.count("*").alias("pages"))
    return parts.groupBy(doc).agg(joined("part", "full_text").alias("full_text"), F.sum("pages").alias("pages"))


def processing_summary(log: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: operations by kind, errors, last time. ``log``: doc_id, operation, ts."""
    return log.groupBy(doc).agg(
        F.count("*").alias("operations"), F.count_if(F.col("operation") == "page").alias("pages"),
        F.count_if(F.col("operation") == "annotation").alias("annotations"), F.count_if(F.col("operation") == "error").alias("errors"),
        F.max("ts").alias("last_time"))


def training_readiness(samples: DataFrame, rules: int = 10, models: int = 50) -> DataFrame:
    """Samples per source and whether they are enough for rules and for models."""
    return samples.groupBy("source").agg(F.count("*").alias("samples")).select(
        "source", "samples", (F.col("samples") >= rules).alias("enough_for_rules"), (F.col("samples") >= models).alias("enough_for_models"),
        F.when(F.col("samples") < rules, "insufficient_data").otherwise("success").alias("status"))


def difficulty(boxes: DataFrame, groups: DataFrame) -> DataFrame:
    """0.1 per correction + half of (1 - mean confidence) + 0.1 per group up to 0.3; at most 1."""
    g = F.coalesce("groups", F.lit(1))
    base = boxes.groupBy(*PAGE).agg(F.count_if("was_corrected").alias("c"), F.avg("ocr_confidence").alias("m"))
    return base.join(groups, PAGE, "left").select(
        *PAGE, F.least(F.col("c") * 0.1 + (1 - F.col("m")) * 0.5 + F.least(g * 0.1, F.lit(0.3)), F.lit(1.0)).alias("difficulty"))


def page_scores(fields: DataFrame) -> DataFrame:
    """Mean confidence and quality and the validated share per page. ``fields`` adds quality, is_valid."""
    return fields.groupBy(*PAGE).agg(
        F.count("*").alias("fields"), F.count_if("is_valid").alias("valid"), F.avg("ocr_confidence").alias("confidence"), F.avg("quality").alias("quality")
    ).withColumn("completion", F.col("valid") / F.col("fields") * 100)


def doc_completion(pages: DataFrame) -> DataFrame:
    """Validated share per document and its status."""
    rate = F.sum("valid") / F.sum("fields")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("fields").alias("fields"), F.sum("valid").alias("valid"), rate.alias("rate")).withColumn(
        "status", F.when(F.col("rate") >= 1.0, "completed").when(F.col("rate") >= 0.5, "in_progress").otherwise("pending"))


def collection_rate(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.sum("fields").alias("annotations"),
                    (F.count_if(F.col("status") == "completed") / F.count("*")).alias("completion_rate"))


def coverage(boxes: DataFrame, page_area: int = 595 * 842) -> DataFrame:
    return boxes.groupBy(*PAGE).agg(F.least(F.sum(Box.of().area) / page_area, F.lit(1.0)).alias("coverage"))


def daily(log: DataFrame, ts: str, kind: str) -> DataFrame:
    """Entries and kinds per day."""
    return log.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.count_distinct(kind).alias("kinds"))


def progress(total: int | Column, done: Column) -> Column:
    return F.when(F.lit(0) == total, 0.0).otherwise(done / total * 100)


def run_metrics(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Processed, failed, success rate and duration per run. ``log``: run_id, ok, ts."""
    ok, bad = F.count_if("ok"), F.count_if(~F.col("ok"))
    return log.groupBy(run).agg(
        ok.alias("processed"), bad.alias("failed"), (ok / F.count("*") * 100).alias("success_rate"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("duration_us"))


def error_report(errors: DataFrame) -> DataFrame:
    """Errors by category with the most common one."""
    per = errors.groupBy("category").agg(F.count("*").alias("n"))
    top = per.agg(F.max_by("category", F.struct("n", "category")).alias("most_common"), F.sum("n").alias("total"))
    return per.transform(beside, top)


def duplicate_ids(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def mapping_confidence(mapped: DataFrame, required: list[str]) -> DataFrame:
    """0.7 x mean confidence (0.5 where unknown) + 0.3 x share of required fields, at most 1."""
    share = F.count_distinct(F.when(F.col("field").isin(required), F.col("field"))) / len(required)
    return mapped.groupBy(*PAGE).agg(F.avg(F.coalesce("confidence", F.lit(0.5))).alias("m"), share.alias("s")).select(
        *PAGE, F.least(F.col("m") * 0.7 + F.col("s") * 0.3, F.lit(1.0)).alias("confidence"))


def structure_flags(boxes: DataFrame, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT) -> DataFrame:
    zone = region(F.col("y"), height, 0.2, 0.8)
    return boxes.groupBy(*PAGE).agg(
        F.bool_or(zone == "header").alias("has_header"), F.bool_or(zone == "footer").alias("has_footer"),
        F.bool_or(F.col("label") == "Item number").alias("has_table"))
