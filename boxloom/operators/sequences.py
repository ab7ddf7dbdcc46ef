"""Label sequences of rows, labels that share a row, text patterns of labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import PAGE, beside, checked_broadcast, parked
from .grouping import band_groups, bin_rows


def row_table(rows: DataFrame, key: str = "row_no") -> DataFrame:
    """Each row with its number of boxes, of labelled ones (``n``) and their labels, left to right.

    Boxes of a row with the same x and label are counted first and written ``label*n``: the array is bounded by the page
    width, not by the number of boxes.
    """
    spots = rows.groupBy(*PAGE, key, "x", "label").agg(F.count("*").alias("n"), F.min("y").alias("y"), F.min("entity_seq").alias("s"))
    labelled = F.col("label") != ""
    name = F.when(F.col("n") > 1, F.concat(F.col("label"), F.lit("*"), F.col("n").cast("string"))).otherwise(F.col("label"))
    seq = F.transform(F.array_sort(F.collect_list(F.when(labelled, F.struct("x", "y", "s", name.alias("name"))))), lambda v: v["name"])
    return spots.groupBy(*PAGE, key).agg(F.concat_ws(" > ", seq).alias("sequence"), F.coalesce(F.sum(F.when(labelled, F.col("n"))), F.lit(0)).alias("n"), F.sum("n").alias("boxes"))


def row_sequences(rows: DataFrame, key: str = "row_no") -> DataFrame:
    """Labels of each row with more than one box, left to right."""
    return row_table(rows.filter("label <> ''"), key).filter("n > 1").drop("boxes")


def _counted(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("sequence", F.col("n").alias("boxes")).agg(F.count("*").alias("n"))


def label_sequences(boxes: DataFrame, threshold: float = 20, share: float = 0.3) -> DataFrame:
    """Count of each row sequence and whether it reaches ``share`` of the pages."""
    rows = band_groups(boxes.select(*PAGE, "entity_seq", "label", "x", "y", "height"), threshold=threshold)
    counted = _counted(row_sequences(rows))
    pages = boxes.select(*PAGE).distinct().agg(F.count("*").alias("pages"))
    return counted.transform(beside, pages).withColumn("frequent", F.col("n") >= F.col("pages") * share)


def bin_sequences(boxes: DataFrame, *extra: str, size: int = 30) -> DataFrame:
    """Row sequences over height bins."""
    return row_sequences(bin_rows(boxes, size), "bin")


def cooccurrence(boxes: DataFrame, size: int = 30) -> DataFrame:
    """Label pairs that share a row bin (both ways) and the number of rows they share.

    Rows are reduced to their distinct label sets before pairs are made, so pairs grow with the vocabulary only.
    """
    per = bin_rows(boxes.filter("label <> ''"), size).groupBy(*PAGE, "bin", "label").agg(F.count("*").alias("n"))
    item = F.struct("label", (F.col("n") > 1).alias("twice"))
    sets = per.groupBy(*PAGE, "bin").agg(F.array_sort(F.collect_list(item)).alias("labels")).groupBy("labels").agg(F.count("*").alias("rows"))
    pairs = F.flatten(F.transform("labels", lambda a: F.transform(
        F.filter("labels", lambda b: (a["label"] != b["label"]) | a["twice"]), lambda b: F.struct(a["label"].alias("label"), b["label"].alias("other")))))
    return sets.select("rows", F.inline(pairs)).groupBy("label", "other").agg(F.sum("rows").alias("rows"))


def predict_sequences(boxes: DataFrame, learned: DataFrame, threshold: float = 20) -> DataFrame:
    """Most frequent learned sequence of the row size, with confidence min(count / 10, 1)."""
    rows = band_groups(boxes.select(*PAGE, "entity_seq", "x", "y", "height"), threshold=threshold).groupBy(*PAGE, "row_no").agg(F.count("*").alias("boxes")).filter("boxes > 1")
    return _predicted(rows, learned)


def predict_own_sequences(boxes: DataFrame, threshold: float = 20) -> DataFrame:
    """``predict_sequences`` of the boxes that are learned from: rows are made once and written for both."""
    rows = band_groups(boxes.select(*PAGE, "entity_seq", "label", "x", "y", "height"), threshold=threshold)
    table = parked(row_table(rows).filter("boxes > 1"))
    return _predicted(table, _counted(table.filter("n > 1").select("sequence", "n")))


def _predicted(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """Rows beside the best sequence of their size: one for each size, so the rows stay where they are."""
    best = learned.groupBy("boxes").agg(F.max(F.struct("n", "sequence")).alias("b"))
    return rows.join(checked_broadcast(best), "boxes").select(*PAGE, "row_no", F.col("b.sequence").alias("predicted"), F.least(F.col("b.n") / 10, F.lit(1.0)).alias("confidence"))


# Pattern names and shapes, anchored at the start.
TEXT_PATTERNS: Mapping[str, str] = {
    "numeric": "^[0-9]+$", "alphanumeric": "^[A-Z0-9]+$", "date": "^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}", "currency": r"^[$¥€£]\s*[0-9,]+\.?[0-9]*",
    "percentage": r"^[0-9]+\.?[0-9]*%", "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
}


def _shared_start(a: Column, b: Column) -> Column:
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: F.substring(a, 1, i) == F.substring(b, 1, i))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.substring(a, 1, F.coalesce(F.array_max(same), F.lit(0)))).otherwise("")


def text_patterns(boxes: DataFrame, keys: Sequence[str] = ("label",), also: Sequence[Column] = ()) -> DataFrame:
    """Patterns most texts of a label have, length mean and deviation, common start and end (more than 3 texts, 3 chars).

    The common start of all texts is the common start of the smallest and the largest one; no text is collected. ``also``:
    further named figures of the same groups, taken in the same pass.
    """
    t = F.col("text")
    n = F.count("*")
    share = [F.when(F.count_if(t.rlike(p)) > n * 0.5, F.lit(name)) for name, p in TEXT_PATTERNS.items()]
    size = F.when(t != "", F.length(t))
    got = boxes.groupBy(*keys).agg(
        F.concat_ws(",", *share).alias("patterns"), F.avg(size).alias("length_mean"), F.stddev_pop(size).alias("length_std"), n.alias("n"),
        F.min("text").alias("_a"), F.max("text").alias("_b"), F.min(F.reverse("text")).alias("_c"), F.max(F.reverse("text")).alias("_d"), *also)
    more = got.columns[len(got.columns) - len(also):] if also else []
    start, end = _shared_start(F.col("_a"), F.col("_b")), F.reverse(_shared_start(F.col("_c"), F.col("_d")))
    long = lambda c: F.when((F.col("n") > 3) & (F.length(c) > 2), c)
    return got.select(*keys, "patterns", "length_mean", "length_std", "n", long(start).alias("prefix"), long(end).alias("suffix"), *more)


