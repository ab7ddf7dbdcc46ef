"""Combination and evaluation of predictions. Predictions are long rows: page key, entity_seq, model, label, p."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import PAGE, beside, first_per
from ..operators.grouping import band_groups
from ..operators.relations import key_value_pairs

BOX = [*PAGE, "entity_seq"]
# Weights of the four models.
WEIGHTS = {"forest": 0.2, "boosted_a": 0.3, "boosted_b": 0.3, "sequence": 0.2}


def normalized(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


def ensemble(predictions: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of the probabilities per label, best label per box (the first in the alphabet on ties)."""
    w = F.create_map(*[v for k, x in normalized(weights).items() for v in (F.lit(k), F.lit(x))])
    per = predictions.groupBy(*BOX, "label").agg(F.round(F.sum(w[F.col("model")] * F.col("p")), 9).alias("p"))
    return per.groupBy(*BOX).agg(F.min(F.struct((-F.col("p")).alias("n"), "label")).alias("b")).select(*BOX, F.col("b.label").alias("predicted"), (-F.col("b.n")).alias("confidence"))


def _times(share: float):
    return lambda v: v * share


def weighted_arrays(arrays: list[Column], weights: list[float]) -> Column:
    """Weighted mean of probability arrays of one label order (MLlib output)."""
    total = sum(weights)
    scaled = [F.transform(a, _times(w / total)) for a, w in zip(arrays, weights, strict=True)]
    out = scaled[0]
    for a in scaled[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def vote(predictions: DataFrame) -> DataFrame:
    """Majority label (the label of the earliest model on ties) and the mean confidence of all models."""
    per = predictions.groupBy(*BOX, "label").agg(F.count("*").alias("n"), F.min("model").alias("first"), F.sum("p").alias("s"))
    return per.groupBy(*BOX).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "label")).alias("b"), (F.sum("s") / F.sum("n")).alias("confidence")).select(
        *BOX, F.col("b.label").alias("predicted"), (-F.col("b.n")).alias("votes"), "confidence")


def cascade(hybrid: DataFrame, advanced: DataFrame, basic: DataFrame, above: float = 0.5) -> DataFrame:
    """Hybrid prediction where there is one, else advanced above ``above``, else basic."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*BOX, F.struct("predicted", "confidence", F.lit(name).alias("model")).alias(name))

    joined = side(basic, "basic").join(side(advanced.filter(F.col("confidence") > above), "advanced"), BOX, "full_outer").join(side(hybrid, "hybrid"), BOX, "full_outer")
    return joined.select(*BOX, F.coalesce("hybrid", "advanced", "basic").alias("r")).select(*BOX, "r.*")


def postprocess(predictions: DataFrame, minimum: float = 0.3) -> DataFrame:
    """First prediction per text and label of a page, those of at least ``minimum``. ``predictions``: box, text, label, confidence."""
    return first_per(predictions, [*PAGE, "text", "label"], ["entity_seq"]).filter(F.col("confidence") >= minimum)


def confusion(matched: DataFrame) -> DataFrame:
    return matched.groupBy("true_label", "predicted").agg(F.count("*").alias("n"))


def evaluate(matched: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per label, with the overall accuracy, from the confusion counts."""
    c = confusion(matched)
    truth = c.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    guess = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    total = c.agg((F.sum(F.when(F.col("true_label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    hit = F.coalesce("hit", F.lit(0))
    p = F.when(F.coalesce("guessed", F.lit(0)) > 0, hit / F.col("guessed")).otherwise(0.0)
    r = F.when(F.coalesce("support", F.lit(0)) > 0, hit / F.col("support")).otherwise(0.0)
    rows = truth.join(guess, "label", "full_outer").select("label", F.coalesce("support", F.lit(0)).alias("support"), p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.withColumn("f1", f1).transform(beside, total)


def relation_boost(predictions: DataFrame, boxes: DataFrame) -> DataFrame:
    """x 1.2 for part numbers and quantities in a row with an item number, x 1.1 for the value of a key; at most 1.

    The second boost starts from the base confidence again. ``predictions``: box, predicted, confidence.
    """
    rows = band_groups(boxes.select(*BOX, "x", "y", "width", "height")).select(*BOX, "row_no")
    placed = predictions.join(rows, BOX)
    leads = placed.filter(F.col("predicted").contains("Item number")).select(*PAGE, "row_no").distinct().withColumn("_lead", F.lit(True))
    values = key_value_pairs(boxes).groupBy(*PAGE, F.col("target").alias("entity_seq")).agg(F.min("source").alias("value_of"))
    joined = placed.join(leads, [*PAGE, "row_no"], "left").join(values, BOX, "left")
    named = F.col("predicted").contains("Part number") | F.col("predicted").contains("Quantity")
    base = F.col("confidence")
    boosted = F.when(F.col("value_of").isNotNull(), F.least(base * 1.1, F.lit(1.0))).when(F.col("_lead") & named, F.least(base * 1.2, F.lit(1.0))).otherwise(base)
    return joined.select(*BOX, "predicted", boosted.alias("confidence"), "value_of", (F.coalesce("_lead", F.lit(False)) & named).alias("relation_boost"))


def sample_weight(confidence: Column, corrected: Column) -> Column:
    return (2 - confidence) * F.when(corrected, 2.0).otherwise(1.0)
