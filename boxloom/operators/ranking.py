"""Ranked suggestions, running figures, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..scale import PAGE, first_per, ranked, running, topk, usual_pages

# Labels offered for quick selection.
IMPORTANT = ["Order number", "Shipping line", "Case mark", "Item number", "Part number", "Delivery date", "Quantity", "Unit price", "Net amount (total)"]


def suggest_topk(pred: DataFrame, per_label: int = 2, total: int = 10) -> DataFrame:
    """Important labels above 0.3 or anything above 0.7; one per label and 20 px cell, two per label, ten per page."""
    c = F.col("confidence")
    kept = pred.filter((F.col("label").isin(IMPORTANT) & (c > 0.3)) | (c > 0.7))
    cells = kept.withColumn("_gx", F.floor(F.col("x") / 20)).withColumn("_gy", F.floor(F.col("y") / 20))
    once = first_per(cells, [*PAGE, "label", "_gx", "_gy"], ["entity_seq"]).drop("_gx", "_gy")
    best = [c.desc(), "entity_seq"]
    few = topk(once, [*PAGE, "label"], best, per_label, "label_rank")
    return topk(few, PAGE, best, total, "rank")


def suggest_top(pred: DataFrame, total: int = 30) -> DataFrame:
    """Predictions of 0.5 and more that are important or above 0.8, the best ``total`` of a page."""
    c = F.col("confidence")
    kept = pred.filter((c >= 0.5) & ~F.col("label").isin("unknown", "None", "") & (F.col("label").isin(IMPORTANT) | (c > 0.8)))
    return topk(kept, PAGE, [c.desc(), "y", "x", "entity_seq"], total)


def label_rules(text: Column, y: Column, top: int = 3) -> Column:
    """Labels suggested by text patterns (else by height) as an array of (label, confidence), best first."""
    low = F.lower(F.trim(text))
    # Pattern or words, label, confidence; listed order breaks ties.
    rules = [
        (text.rlike("^[0-9]{10}$"), "Order number", 0.9), (text.rlike("^[A-Z][0-9]+[A-Z]*(-[0-9]+)?$"), "Part number", 0.85),
        (text.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), "Delivery date", 0.95), (text.rlike(r"^[0-9]+\.[0-9]{3}\s*(ST|PC|EA)?$"), "Quantity", 0.9),
        (text.rlike(r"^[0-9]+\.[0-9]{4}$"), "Unit price", 0.85), (low.contains("total"), "Net amount (total)", 0.95),
        (~low.contains("total") & text.rlike(r"^[0-9]+\.[0-9]{2}$"), "Net amount", 0.8), (text.rlike("^C[0-9]{7}$"), "Shipping line", 0.95),
        (T.contains_any(low, ["ymg", "kofu", "ishikawa"]), "Case mark", 0.9), (text.rlike("^000[0-9]{2}$"), "Item number", 0.9),
    ]
    hits = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(-conf).alias("c"), F.lit(i).alias("i"), F.lit(label).alias("label"))) for i, (test, label, conf) in enumerate(rules)]))
    spare = F.when(y < 200, F.struct(F.lit(-0.5).alias("c"), F.lit(0).alias("i"), F.lit("Order number").alias("label"))).when(
        y > 1500, F.struct(F.lit(-0.4).alias("c"), F.lit(0).alias("i"), F.lit("Net amount (total)").alias("label"))).otherwise(
        F.struct(F.lit(-0.3).alias("c"), F.lit(0).alias("i"), F.lit("Part number").alias("label")))
    ranked_hits = F.slice(F.array_sort(F.when(F.size(hits) > 0, hits).otherwise(F.array(spare))), 1, top)
    return F.transform(ranked_hits, lambda s: F.struct(s["label"].alias("label"), (-s["c"]).alias("confidence")))


def alternatives(probs: Column, count: int = 3, above: float = 0.1) -> Column:
    """Labels after the best one: at most ``count`` of them with a probability over ``above``.

    ``probs`` is an array of (label, p).
    """
    ordered = F.array_sort(F.transform(probs, lambda s: F.struct((-s["p"]).alias("n"), s["label"].alias("label"))))
    rest = F.filter(F.slice(ordered, 2, count), lambda s: -s["n"] > above)
    return F.transform(rest, lambda s: F.struct(s["label"].alias("label"), (-s["n"]).alias("p")))


def entropy(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda acc, s: acc - s["p"] * F.log(s["p"] + 1e-10))


def active_learning(pred: DataFrame, n: int = 10) -> DataFrame:
    """Most uncertain boxes: half of (1 - confidence) plus half of the entropy (a column of its own if there is one)."""
    spread = F.col("entropy") if "entropy" in pred.columns else entropy(F.col("probs"))
    score = (1 - F.col("confidence")) * 0.5 + spread * 0.5
    return pred.withColumn("uncertainty", F.round(score, 9)).orderBy(F.col("uncertainty").desc(), *PAGE, "entity_seq").limit(n)


def reading_order(boxes: DataFrame) -> DataFrame:
    """Place of each box by (y, x); a page of very many boxes is split by height."""
    return ranked(boxes, PAGE, ["y", "x", "entity_seq"], [F.col("y"), F.col("x")], "place", usual_pages(boxes))


def time_levels(ts: str) -> list[Column]:
    return [F.date_trunc("day", ts), F.date_trunc("minute", ts)]


def version_log(log: DataFrame, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Version number of each change of an annotation, in time order."""
    return ranked(log, [key], [ts, tie], time_levels(ts), "version")


def running_quality(history: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Running mean of scores and pass / fail counts over a validation history (score_cents, passed)."""
    out = running(history, [], [ts, tie], time_levels(ts), {
        "validations": F.lit(1).cast("long"), "passed_total": F.col("passed").cast("long"), "cents": F.col("score_cents").cast("long")})
    return out.withColumn("failed_total", F.col("validations") - F.col("passed_total")).withColumn("mean_score", F.col("cents") / F.col("validations") / 100).drop("cents")


def quality_trend(history: DataFrame, ts: str = "ts", tie: str = "event_id", last: int = 10) -> DataFrame:
    """Last scores: direction from the first to the last of them, mean and range."""
    recent = history.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(last)
    order = F.struct(ts, tie)
    one = recent.agg(F.min_by("score_cents", order).alias("f"), F.max_by("score_cents", order).alias("l"), F.avg("score_cents").alias("m"),
                     F.min("score_cents").alias("low"), F.max("score_cents").alias("high"), F.count("*").alias("points"))
    return one.select(
        F.when(F.col("points") < 2, "insufficient_data").when(F.col("l") > F.col("f"), "improving").otherwise("declining").alias("trend"),
        (F.col("m") / 100).alias("recent_average"), F.col("low").alias("low_cents"), F.col("high").alias("high_cents"), "points")


def page_sequence(pages: DataFrame, doc: str, page: str, first: int = 1) -> DataFrame:
    """Whether the page numbers of a document run without gap or repeat from ``first``."""
    return pages.groupBy(doc).agg(
        ((F.min(page) == first) & (F.max(page) == F.count("*") + first - 1) & (F.count_distinct(page) == F.count("*"))).alias("consecutive"), F.count("*").alias("pages"))


def temporal_sequence(boxes: DataFrame, labels: tuple[str, ...] = ("Delivery date", "Order number")) -> DataFrame:
    """0-based place of the dated boxes of a page in item order."""
    kept = boxes.filter(F.col("label").isin(list(labels)))
    order = ["line_no", "entity_seq"]
    out = ranked(kept, PAGE, order, [F.expr("line_no div 64"), F.struct("line_no", F.expr("entity_seq div 65536").alias("s"))], "place")
    return out.withColumn("place", F.col("place") - 1)
