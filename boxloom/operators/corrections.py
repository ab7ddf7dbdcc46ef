"""Mining of OCR corrections: which readings people changed, how, and what can be learned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normalize import error_type, fix_common_ocr, fix_order_number
from ..scale import beside, checked_broadcast, cut, entity_levels, ranked, sliding, topk

ORDER = ["doc_id", "page_number", "entity_seq"]


def corrections_v1(boxes: DataFrame) -> DataFrame:
    """Flat layout: original and text present and different."""
    return boxes.filter("ocr_original <> '' AND text <> '' AND ocr_original <> text").select(
        *ORDER, "label", "ocr_original", F.col("text").alias("corrected"), "ocr_confidence", "x", "y", "width", "height", F.lit("v1").alias("source"))


def corrections_v2(boxes: DataFrame, corrected: str = "corrected_value") -> DataFrame:
    """Entity layout: the corrected value or the current text differs from a non-empty original."""
    c = F.coalesce(F.col(corrected), F.lit(""))
    changed = (F.col("ocr_original") != "") & ((c != F.col("ocr_original")) | (F.col("text") != F.col("ocr_original")))
    return boxes.filter(changed).select(
        *ORDER, "label", "ocr_original", F.when(F.col("text") != "", F.col("text")).otherwise(c).alias("corrected"), "ocr_confidence",
        "x", "y", "width", "height", F.lit("v2").alias("source"))


def union_corrections(v1: DataFrame, v2: DataFrame) -> DataFrame:
    return corrections_v1(v1).unionByName(corrections_v2(v2))


def by_label(corr: DataFrame) -> DataFrame:
    return corr.groupBy("label").agg(F.count("*").alias("n"))


def common_errors(corr: DataFrame) -> DataFrame:
    kind = error_type(F.col("ocr_original"), F.col("corrected"))
    return corr.withColumn("error_type", kind).filter("error_type IS NOT NULL").groupBy("error_type").agg(F.count("*").alias("n"))


def improvements(corr: DataFrame) -> DataFrame:
    """Distinct changes per label with their count and confidence range (a list per label would have no bound)."""
    return corr.groupBy("label", F.col("ocr_original").alias("from_text"), F.col("corrected").alias("to_text")).agg(
        F.count("*").alias("n"), F.min("ocr_confidence").alias("min_confidence"), F.max("ocr_confidence").alias("max_confidence"))


def learned_corrections(corr: DataFrame) -> DataFrame:
    """Replacement per label and original reading; the last correction wins."""
    changed = corr.filter("ocr_original <> corrected")
    return changed.groupBy("label", "ocr_original").agg(F.max_by("corrected", F.struct(*ORDER)).alias("corrected"))


def text_shapes(corr: DataFrame) -> DataFrame:
    """Numeric, upper alphanumeric and date shapes per label; a text counts for the first shape it has."""
    t = F.col("corrected")
    numeric = t.rlike("^[0-9]+$")
    upper = ~numeric & t.rlike("^[A-Z0-9]+$")
    date = ~numeric & ~upper & t.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$")
    return corr.groupBy("label").agg(F.count_if(numeric).alias("numeric"), F.count_if(upper).alias("alphanumeric_upper"), F.count_if(date).alias("date_mdy"))


def accuracy(n: Column) -> Column:
    """Learning progress after ``n`` corrections."""
    return F.least(0.5 + n * 0.01, F.lit(0.99))


def running_accuracy(corr: DataFrame) -> DataFrame:
    """Progress of each label after each of its corrections."""
    return ranked(corr, ["label"], ORDER, entity_levels(), "n").withColumn("accuracy", accuracy(F.col("n")))


def plateau(progress: DataFrame, width: int = 50) -> DataFrame:
    """Stop flag: progress of 0.95, or ``width`` values that vary by less than 0.02."""
    seen = sliding(progress, ["label"], "n", width, {"_hi": lambda: F.max("accuracy"), "_lo": lambda: F.min("accuracy")})
    flat = (F.col("n") >= width) & (F.col("_hi") - F.col("_lo") < 0.02)
    return seen.withColumn("stop", (F.col("accuracy") >= 0.95) | flat).drop("_hi", "_lo")


def learning_status(corr: DataFrame) -> DataFrame:
    """Progress per label with the overall mean and whether all labels are done."""
    per = by_label(corr).withColumn("accuracy", accuracy(F.col("n")))
    whole = per.agg(F.avg("accuracy").alias("overall"), F.bool_and(F.col("accuracy") >= 0.95).alias("complete"), F.sum("n").alias("total"))
    return per.transform(beside, whole)


def learning_report(boxes: DataFrame, corr: DataFrame) -> DataFrame:
    """Summary and counts as (section, name, value) rows."""
    pages = boxes.select("doc_id", "page_number").distinct().agg(F.count("*").alias("value")).select(F.lit("summary").alias("section"), F.lit("files").alias("name"), "value")
    found = corr.agg(F.count("*").alias("value")).select(F.lit("summary").alias("section"), F.lit("corrections").alias("name"), "value")
    labels = by_label(corr).select(F.lit("by_label").alias("section"), F.col("label").alias("name"), F.col("n").alias("value"))
    errors = common_errors(corr).select(F.lit("by_error").alias("section"), F.col("error_type").alias("name"), F.col("n").alias("value"))
    return pages.unionByName(found).unionByName(labels).unionByName(errors)


def history_cap(corr: DataFrame, keep: int = 100, per: str = "label") -> DataFrame:
    """Newest ``keep`` corrections per key."""
    return topk(corr, [per], [F.col(c).desc() for c in ORDER], keep, "age")


def replace_learned(texts: DataFrame, learned: DataFrame, column: str, out: str) -> DataFrame:
    """Replace every learned reading of the label that the text contains, longest first, each on the result so far.

    The learned table may be as large as the corrections, so it is not collected: a text offers its substrings of the
    learned lengths and meets the table in an equi join. Equal texts are handled once. A round applies the next reading
    in order to every text that still holds one, also one that an earlier reading put there; texts without a hit drop out.
    """
    sizes = checked_broadcast(learned.groupBy("label").agg(F.sort_array(F.collect_set(F.length("ocr_original"))).alias("_sizes")))
    pairs = cut(learned.select("label", "ocr_original", "corrected"))
    start = F.struct(F.lit(-(1 << 30)).alias("o"), F.lit("").alias("ocr_original"))
    state = cut(texts.select("label", F.col(column).alias("_t")).distinct()).withColumn("_now", F.col("_t")).withColumn("_last", start)
    rounds = None
    while True:
        parts = F.array_distinct(F.flatten(F.transform(
            F.filter("_sizes", lambda n: (n > 0) & (n <= F.length("_now")) & (n <= -F.col("_last.o"))),
            lambda n: F.transform(F.sequence(F.lit(1), F.length("_now") - n + 1), lambda i: F.substring("_now", i, n)))))
        offered = state.join(sizes, "label").select("label", "_t", "_now", "_last", F.explode(parts).alias("ocr_original"))
        place = F.struct((-F.length("ocr_original")).alias("o"), "ocr_original")
        hits = offered.filter(place > F.col("_last")).join(pairs, ["label", "ocr_original"])
        first = hits.groupBy("label", "_t", "_now").agg(F.min(F.struct((-F.length("ocr_original")).alias("o"), "ocr_original", "corrected")).alias("_hit"))
        state = cut(first.select(
            "label", "_t", F.replace("_now", F.col("_hit.ocr_original"), F.col("_hit.corrected")).alias("_now"), F.struct("_hit.o", "_hit.ocr_original").alias("_last")))
        if state.isEmpty():
            break
        reached = state.select("label", "_t", F.struct("_last", "_now").alias("_at"))
        rounds = reached if rounds is None else rounds.unionByName(reached)
    if rounds is None:
        return texts.withColumn(out, F.col(column))
    done = rounds.groupBy("label", "_t").agg(F.max("_at").alias("_at")).select("label", "_t", F.col("_at._now").alias(out))
    return texts.withColumn("_t", F.col(column)).join(done, ["label", "_t"], "left").withColumn(out, F.coalesce(out, "_t")).drop("_t")


def correct_text(boxes: DataFrame, learned: DataFrame) -> DataFrame:
    """Fix confusions of known labels, then order numbers, then apply the learned readings of the label."""
    known = learned.select("label").distinct().withColumn("_known", F.lit(True))
    once = F.array(fix_common_ocr(F.col("ocr_original")))  # made once for all that looks at it
    fixed = F.element_at(F.transform(once, lambda t: F.when(F.col("label") == "Order number", fix_order_number(t)).otherwise(t)), 1)
    marked = boxes.join(checked_broadcast(known), "label", "left")
    prepared = marked.withColumn("fixed", F.when(F.col("_known"), fixed).otherwise(F.col("ocr_original"))).drop("_known")
    return replace_learned(prepared, learned, "fixed", "corrected")


def _confidence(marked: DataFrame, progress: DataFrame) -> DataFrame:
    """Confidence of rows that carry ``_known`` (the result was learned) and ``_same`` (exactly this change was)."""
    joined = marked.join(checked_broadcast(progress.select("label", "accuracy")), "label", "left")
    pattern = F.when(F.col("_known"), 0.9).when(F.col("corrected").rlike("^[0-9]+$") & F.col("numeric_label"), 0.8).otherwise(0.5)
    history = F.when(F.col("_same"), 0.9).otherwise(0.5)
    late = F.coalesce(F.col("accuracy") > 0.9, F.lit(False))
    score = (
        F.col("ocr_confidence") * F.when(late, 0.2).otherwise(0.3) + F.col("position_score") * 0.3 + pattern * 0.2
        + history * F.when(late, 0.4).otherwise(0.2)
    )
    out = joined.withColumn("confidence", F.least(score, F.lit(1.0)))
    return out.withColumn("needs_review", F.col("confidence") < 0.8).drop("_known", "_same", "accuracy")


def correction_confidence(boxes: DataFrame, learned: DataFrame, progress: DataFrame) -> DataFrame:
    """0.3 OCR + 0.3 position + 0.2 pattern + 0.2 history (0.2 / 0.3 / 0.2 / 0.4 once the label is above 0.9).

    ``boxes`` carries ocr_confidence, position_score, ocr_original, corrected. Pattern: 0.9 for a learned result, 0.8 for
    digits of a numeric label, else 0.5. History: 0.9 when exactly this change was learned, else 0.5.
    """
    results = learned.select("label", "corrected").distinct().withColumn("_known", F.lit(True))
    changes = learned.select("label", "ocr_original", "corrected").withColumn("_same", F.lit(True))
    return _confidence(boxes.join(results, ["label", "corrected"], "left").join(changes, ["label", "ocr_original", "corrected"], "left"), progress)


def learned_confidence(boxes: DataFrame, learned: DataFrame, progress: DataFrame, replaced: bool = False) -> DataFrame:
    """Put the learned text of each reading (else the reading) in ``corrected`` and add its ``correction_confidence``.

    A replaced reading is a learned change with a learned result; one that stays is no change, and its result is known if
    some reading of the label leads to it. So one table of readings answers all three, and the boxes are dealt once.
    ``replaced``: only replaced readings get a confidence (the others null), and the learned table is that table.
    """
    if replaced:
        met = boxes.join(learned.select("label", "ocr_original", "corrected"), ["label", "ocr_original"], "left")
        marked = met.withColumns({c: F.col("corrected").isNotNull() for c in ("_same", "_known", "_put")})
        out = _confidence(marked.withColumn("corrected", F.coalesce("corrected", "ocr_original")), progress)
        return out.withColumns({c: F.when(F.col("_put"), F.col(c)) for c in ("confidence", "needs_review")}).drop("_put")
    changes = learned.select("label", "ocr_original", "corrected", F.lit(False).alias("_result"))
    results = learned.select("label", F.col("corrected").alias("ocr_original"), F.lit(None).cast("string").alias("corrected"), F.lit(True).alias("_result"))
    readings = changes.unionByName(results).groupBy("label", "ocr_original").agg(F.max("corrected").alias("corrected"), F.bool_or("_result").alias("_result"))
    met = boxes.join(readings, ["label", "ocr_original"], "left").withColumn("_same", F.col("corrected").isNotNull())
    marked = met.withColumn("_known", F.col("_same") | F.coalesce("_result", F.lit(False))).drop("_result")
    return _confidence(marked.withColumn("corrected", F.coalesce("corrected", "ocr_original")), progress)


def resolve_text(boxes: DataFrame) -> DataFrame:
    """Keep a user correction, else a learned text above 0.8, else the OCR text.

    ``boxes`` carries was_corrected, text, ocr_original, corrected, confidence.
    """
    user = F.col("was_corrected")
    learned = (F.col("confidence") > 0.8) & (F.col("corrected") != F.col("ocr_original"))
    return boxes.withColumn("resolved", F.when(user, F.col("text")).when(learned, F.col("corrected")).otherwise(F.col("ocr_original"))).withColumn(
        "origin", F.when(user, "user").when(learned, "learned").otherwise("ocr"))
