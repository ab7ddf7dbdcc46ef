"""Learned positions of labels and their use for prediction."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bbox import Box, quadrant
from ..scale import PAGE, checked_broadcast, cut, near_pairs, topk
from ..schema import LABELS, PAGE_HEIGHT, PAGE_WIDTH

PLACE = ["x", "y", "width", "height"]
PLACES = 20_000  # distinct places that are scored once for all boxes there


def position_ranges(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest and largest x, y, width and height and the box count per ``keys``."""
    parts = [f(c).alias(f"{c}_{n}") for c in ("x", "y", "width", "height") for n, f in (("min", F.min), ("max", F.max))]
    return boxes.groupBy(*keys).agg(*parts, F.count("*").alias("n"))


def _at_places(boxes: DataFrame, ranges: DataFrame, key: str, made: Callable[[DataFrame], DataFrame], how: str, most: int = PLACES) -> DataFrame:
    """Columns that ``made`` derives from the ranges of the document type (``_ranges``) and the place of a box alone.

    Boxes of printed forms share few places, so these are scored once and met by the boxes; if there are more than
    ``most``, every box is scored where it lies. The ranges of a type travel as one array (one entry per label).
    """
    fit = F.struct("label", *[c for c in ranges.columns if c not in (key, "label", "n")])
    table = checked_broadcast(ranges.groupBy(key).agg(F.array_sort(F.collect_list(fit)).alias("_ranges")))
    places = cut(boxes.select(key, *PLACE).distinct().limit(most + 1))
    if places.count() > most:
        return made(boxes.join(table, key, how)).drop("_ranges")
    scored = made(places.join(table, key, how)).drop("_ranges")
    new = scored.columns[len(PLACE) + 1:]
    rest = [c for c in boxes.columns if c != key and c not in new]
    return boxes.drop(*new).join(checked_broadcast(scored), [key, *PLACE], how).select(key, *rest, *new)


def position_predict(boxes: DataFrame, ranges: DataFrame, key: str = "doc_type", threshold: float = 0.7) -> DataFrame:
    """Label whose ranges fit best (a quarter each for x, y, width, height; above ``threshold``), else unknown."""

    def score(r, i):
        hits = F.lit(0)
        for c in ("x", "y", "width", "height"):
            hits = hits + F.col(c).between(r[f"{c}_min"], r[f"{c}_max"]).cast("int")
        return F.struct((hits * 0.25).alias("score"), (-i).alias("first"), r["label"].alias("label"))

    def made(places: DataFrame) -> DataFrame:
        best = places.withColumn("_best", F.array_max(F.transform("_ranges", score)))
        named = F.when(F.col("_best.score") > threshold, F.col("_best.label")).otherwise("unknown")
        return best.withColumn("predicted", named).withColumn("position_score", F.col("_best.score")).drop("_best")

    found = _at_places(boxes, ranges, key, made, "left")
    return found.withColumn("predicted", F.when(F.col("position_score").isNull(), "unknown").otherwise(F.col("predicted"))).withColumn(
        "position_score", F.coalesce("position_score", F.lit(0.0)))


def should_ocr(predicted: DataFrame) -> DataFrame:
    """Read again when the predicted label is an important one or unknown."""
    return predicted.withColumn("should_ocr", F.col("predicted").isin([*LABELS, "unknown"]))


def typical_positions(boxes: DataFrame, min_count: int = 3, top: int = 20, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT) -> DataFrame:
    """Mean relative position per document type and label seen at least ``min_count`` times, the ``top`` most frequent."""
    seen = boxes.groupBy("doc_type", "label").agg(
        (F.avg("x") / width).alias("left"), (F.avg("y") / height).alias("top"), F.count("*").alias("frequency")
    ).filter(F.col("frequency") >= min_count)
    return topk(seen, ["doc_type"], [F.col("frequency").desc(), "label"], top)


def predict_from_pattern(pages: DataFrame, positions: DataFrame, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT) -> DataFrame:
    """The typical labels of the document type, placed on each page."""
    return pages.join(checked_broadcast(positions), "doc_type").select(
        *PAGE, "label", (F.col("left") * width).cast("long").alias("x"), (F.col("top") * height).cast("long").alias("y"),
        F.lit(150).cast("long").alias("width"), F.lit(30).cast("long").alias("height"), F.lit(0.7).alias("confidence"))


def position_means(boxes: DataFrame, min_confidence: float = 0.9) -> DataFrame:
    """Mean corner and most frequent quadrant (the smaller one on ties) per label, over confident boxes."""
    sure = boxes.filter(F.col("ocr_confidence") > min_confidence).withColumn("quadrant", quadrant(Box.of()))
    per = sure.groupBy("label", "quadrant").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    return per.groupBy("label").agg(
        (F.sum("sx") / F.sum("n")).alias("avg_x"), (F.sum("sy") / F.sum("n")).alias("avg_y"),
        F.max_by("quadrant", F.struct("n", -F.col("quadrant"))).alias("quadrant"), F.sum("n").alias("n"))


def position_anomaly(boxes: DataFrame, means: DataFrame, reach: float = 100) -> DataFrame:
    """More than ``reach`` px from the mean corner of the label on either axis."""
    m = checked_broadcast(means.select("label", "avg_x", "avg_y"))
    far = (F.abs(F.col("x") - F.col("avg_x")) > reach) | (F.abs(F.col("y") - F.col("avg_y")) > reach)
    return boxes.join(m, "label", "left").withColumn("anomaly", F.coalesce(far, F.lit(False))).drop("avg_x", "avg_y")


def confidence_adjust(flagged: DataFrame) -> DataFrame:
    """x 0.8 for anomalies, else x 1.1; x 1.2 more for well-formed order numbers; at most 1."""
    base = F.when(F.col("anomaly"), F.col("ocr_confidence") * 0.8).otherwise(F.least(F.col("ocr_confidence") * 1.1, F.lit(1.0)))
    good = (F.col("label") == "Order number") & F.col("text").rlike("^[0-9]{10}$")
    return flagged.withColumn("adjusted", F.when(good, F.least(base * 1.2, F.lit(1.0))).otherwise(base))


def field_by_position(boxes: DataFrame, fields: DataFrame, patterns: Mapping[str, str], tolerance: float = 50) -> DataFrame:
    """Per page and template field the nearest box within ``tolerance`` whose text fits the field pattern.

    ``fields``: doc_type, field, x, y. The few template fields visit the cells in reach; the boxes are not replicated.
    """
    shape = F.create_map(*[F.lit(v) for kv in patterns.items() for v in kv])
    left = checked_broadcast(fields.withColumn("pattern", shape[F.col("field")]))
    right = boxes.select("doc_type", *PAGE, "entity_seq", "text", "x", "y", "ocr_confidence")
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    dist = F.sqrt(dx * dx + dy * dy)
    near = near_pairs(left, right, ["doc_type"], {"x": tolerance, "y": tolerance}, (dist <= tolerance) & F.expr("rlike(b_text, a_pattern)"))
    best = near.groupBy(*[F.col("b_" + c).alias(c) for c in PAGE], F.col("a_field").alias("field")).agg(
        F.min(F.struct(dist.alias("distance"), F.col("b_entity_seq").alias("entity_seq"), F.col("b_text").alias("value"))).alias("m"))
    return best.select(*PAGE, "field", "m.entity_seq", "m.value", "m.distance")


def label_probabilities(boxes: DataFrame, ranges: DataFrame, key: str = "doc_type", also: Mapping[str, Callable[[Column], Column]] | None = None,
                        every: bool = False) -> DataFrame:
    """Position scores of all labels as an array of (label, p) that sums to 1; labels without any hit are left out.

    Boxes without any hit are left out as well, or have no array (``every``). ``also``: further columns that follow from this
    array, made with it.
    """

    def score(r):
        hits = F.lit(0)
        for c in PLACE:
            hits = hits + F.col(c).between(r[f"{c}_min"], r[f"{c}_max"]).cast("int")
        return F.struct(r["label"].alias("label"), hits.alias("hits"))

    def made(places: DataFrame) -> DataFrame:
        hit = F.filter(F.transform("_ranges", score), lambda s: s["hits"] > 0)
        total = F.aggregate("_hits", F.lit(0), lambda acc, s: acc + s["hits"])
        probs = F.transform("_hits", lambda s: F.struct(s["label"].alias("label"), (s["hits"] / F.col("_total")).alias("p")))
        found = places.withColumn("_hits", hit)
        found = found.withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits"))) if every else found.filter(F.size("_hits") > 0)
        found = found.withColumn("_total", total).withColumn("probs", probs).drop("_hits", "_total")
        return found.withColumns({name: make(F.col("probs")) for name, make in (also or {}).items()})

    return _at_places(boxes, ranges, key, made, "left" if every else "inner")
