"""Conversion between the label layouts.

A page document holds its boxes in one row. A page of very many boxes is written in numbered parts of at most ``PART``
boxes, so no row grows without bound; ordinary pages are part 0 only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import bbox as B, text as T
from ..functions.bbox import Box
from ..scale import PAGE, entity_levels, ranked, usual_pages
from ..schema import PAGE_HEIGHT, PAGE_WIDTH
from .grouping import band_groups
from .relations import directed_relations, item_detail, label_value

PART = 10_000


def numbered(boxes: DataFrame) -> DataFrame:
    """0-based place of each box on its page in item order, and its id ``ent_NNN``."""
    order = [*PAGE, "line_no", "entity_seq"]
    levels = [F.expr("line_no div 64"), F.struct("line_no", F.expr("entity_seq div 65536").alias("s"))]
    placed = ranked(boxes, PAGE, order[2:], levels, "place", usual_pages(boxes)).withColumn("place", F.col("place") - 1)
    return placed.withColumn("entity_id", F.format_string("ent_%03d", "place"))


def entity_rows(boxes: DataFrame) -> DataFrame:
    """Entity layout as one row per box: normalized position, group, OCR results."""
    group = F.when(F.col("line_no") > 0, F.format_string("ITEM_%05d", "line_no")).otherwise("-")
    return numbered(boxes).select(
        *PAGE, "place", "entity_id", group.alias("group_id"), "label", "text", "x", "y", "width", "height", (F.col("x") / PAGE_WIDTH).alias("x_normalized"), (F.col("y") / PAGE_HEIGHT).alias("y_normalized"),
        F.lit(0.9).alias("label_confidence"), "ocr_original", "ocr_confidence", "was_corrected")


def page_documents(rows: DataFrame) -> DataFrame:
    """Nested entity pages in parts: entities, groups, and the mean confidence of the whole page."""
    b = F.struct("x", "y", "width", "height")
    entity = F.struct(
        "place", "entity_id", b.alias("bbox"), F.struct(F.col("text").alias("value"), F.col("ocr_confidence").alias("confidence")).alias("text"),
        F.struct(F.col("label").alias("primary"), F.col("label_confidence").alias("confidence")).alias("label"),
        F.struct("x_normalized", "y_normalized").alias("position"),
        F.struct(F.col("ocr_original").alias("tesseract_raw"), F.col("ocr_confidence").alias("tesseract_confidence"), F.col("text").alias("corrected_value"), "was_corrected").alias("ocr_results"),
        "group_id")
    sums = [F.sum("ocr_confidence").alias("_s"), F.count("ocr_confidence").alias("_n")]
    docs = rows.groupBy(*PAGE, F.expr(f"place div {PART}").alias("part")).agg(F.array_sort(F.collect_list(entity)).alias("entities"), *sums)
    page = W.partitionBy(*PAGE)  # a row per part: the sums of the parts give the mean of the page
    mean = F.try_divide(F.sum("_s").over(page), F.sum("_n").over(page)).alias("overall_confidence")
    return docs.select(*PAGE, "part", "entities", mean).withColumn("annotation_version", F.lit("2.0"))


def entity_groups(rows: DataFrame) -> DataFrame:
    """Groups of the entity layout: type, y of the first member, members."""
    kind = F.when(F.col("group_id").contains("ITEM"), "item_line").otherwise("general")
    return rows.filter("group_id <> '-'").groupBy(*PAGE, "group_id").agg(
        F.first(kind).alias("group_type"), F.min_by("y", "place").alias("y_position"), F.count("*").alias("members"), F.min("entity_id").alias("first_entity"))


def repaired(boxes: DataFrame) -> DataFrame:
    """Entity rows rebuilt from flat boxes: region, quadrant, text and meaning flags, relation counts, own OCR results."""
    b, text = Box.of(), F.col("text")
    names = {1: "top_left", 2: "top_right", 3: "bottom_left", 4: "bottom_right"}
    quad = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[B.quadrant(b)]
    relations = directed_relations(boxes).select(*PAGE, "source", "relation").unionByName(
        item_detail(boxes).select(*PAGE, "source", "relation")).unionByName(label_value(boxes).select(*PAGE, "source", "relation"))
    counts = relations.groupBy(*PAGE, F.col("source").alias("entity_seq")).agg(
        F.count("*").alias("relations"), F.count_if(F.col("relation").isin("left_of", "right_of")).alias("row_relations"), F.count_if(F.col("relation") == "item_detail").alias("detail_relations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return boxes.join(counts, [*PAGE, "entity_seq"], "left").select(
        *PAGE, "entity_seq", "label", B.region(b.cy).alias("region"), quad.alias("quadrant"), F.length(text).alias("text_length"), T.is_plain_number(text).alias("is_numeric"),
        T.matches(text, "date_full").alias("is_date"), T.is_upper(text).alias("is_uppercase"), T.matches(text, "special").alias("has_special_chars"), T.word_count(text).alias("word_count"),
        b.area.alias("area"), B.aspect(b).alias("aspect"), *[c.alias("means_" + n[3:]) for n, c in T.semantic_flags(F.col("label")).items()],
        zero("relations"), zero("row_relations"), zero("detail_relations"), "ocr_original", "was_corrected")


def item_groups(boxes: DataFrame, group: str = "group_id", threshold: float = 15) -> DataFrame:
    """Groups of a saved page: given groups as they are, boxes without one grouped by row; numbered by height."""
    given = boxes.filter(F.coalesce(F.col(group), F.lit("-")) != "-").withColumn("made", F.lit(False))
    loose = band_groups(boxes.filter(F.coalesce(F.col(group), F.lit("-")) == "-"), threshold=threshold, by="top", strict=False)
    loose = loose.withColumn(group, F.format_string("item_%05d", "row_no")).withColumn("made", F.lit(True)).drop("row_no")
    groups = given.unionByName(loose).groupBy(*PAGE, group, "made").agg(F.min("y").alias("y_position"), F.count("*").alias("n"))
    return ranked(groups, PAGE, ["y_position", group], [F.col("y_position")], "place")


def nested_groups(boxes: DataFrame, group: str = "line_no") -> DataFrame:
    """Boxes as groups with label lists (parts of at most ``PART`` labels)."""
    label = F.struct("entity_seq", "label", "text", F.array("x", "y", "width", "height").alias("bbox"))
    return boxes.groupBy(*PAGE, group, F.expr(f"entity_seq div {PART}").alias("part")).agg(F.array_sort(F.collect_list(label)).alias("labels"))


def flat_labels(groups: DataFrame, group: str = "line_no") -> DataFrame:
    """Groups back to boxes; the positional box becomes columns."""
    rows = groups.select(*PAGE, group, F.explode("labels").alias("l"))
    return rows.select(*PAGE, group, "l.entity_seq", "l.label", "l.text", *[F.get("l.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "width", "height"))])


def relabel(column: Column, names: Mapping[str, str]) -> Column:
    """New name of a label; other labels stay."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[column], column)


def relabel_groups(groups: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename labels inside the nested layout."""
    return groups.withColumn("labels", F.transform("labels", lambda s: s.withField("label", relabel(s["label"], names))))


def repaired_key(name: Column) -> Column:
    """Repaired page key: the later time stamp moved behind the document date, ``page_`` joined, label suffix added."""
    swap = r"^(2025[0-9]{4})_([0-9]{6})_([0-9]{8})([0-9]{6})-(.+)$"
    fixed = F.when(name.rlike(swap), F.regexp_replace(name, swap, "$3_$4_$1$2-$5")).otherwise(name)
    fixed = F.regexp_replace(fixed, r"_page_([0-9]+)", "_page$1")
    return F.when(fixed.rlike(r"_page[0-9]+\.json$"), F.regexp_replace(fixed, r"\.json$", "_label.json")).otherwise(fixed)


def rename_keys(pages: DataFrame, key: str, order: str) -> DataFrame:
    """Pages under their repaired key; of pages that collide the one already named so stays, else the first."""
    moved = pages.withColumn("_new", repaired_key(F.col(key)))
    kept = moved.groupBy("_new").agg(F.min(F.struct((F.col(key) != F.col("_new")).alias("changed"), F.col(order).alias("o"), F.col(key).alias("k"))).alias("m"), F.count("*").alias("copies"))
    return kept.select(F.col("_new").alias("new_key"), F.col("m.k").alias("old_key"), "copies")


def any_box(df: DataFrame, nested: str = "bbox") -> DataFrame:
    """Box from a nested struct, from x/y/width/height or from left/top/width/height."""
    return df.withColumn("bx", F.coalesce(F.col(f"{nested}.x"), F.col("x"), F.col("left"), F.lit(0))).withColumn("by", F.coalesce(F.col(f"{nested}.y"), F.col("y"), F.col("top"), F.lit(0))).withColumn(
        "bw", F.coalesce(F.col(f"{nested}.width"), F.col("width"), F.lit(100))).withColumn("bh", F.coalesce(F.col(f"{nested}.height"), F.col("height"), F.lit(30)))


def words_to_entities(pages: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Words with text and box as entities ``ent_NNN``, numbered from 0 per page, on through its parts (``part``, if any)."""
    usable = F.filter("words", lambda w: (F.coalesce(w["text"], F.lit("")) != "") & w["bbox"].isNotNull())
    kept = pages.withColumn("words", usable)
    if "part" in pages.columns:  # a row per PART boxes: few enough to be summed up page by page
        before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        first = F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int").alias("_first")
        sizes = kept.select(*keys, "part", F.size("words").alias("_n")).select(*keys, "part", first)
        kept = kept.join(sizes, [*keys, "part"])
    else:
        kept = kept.withColumn("_first", F.lit(0))
    rows = kept.select(*[c for c in pages.columns if c != "words"], "_first", F.posexplode("words").alias("pos", "w"))
    return rows.withColumn("pos", F.col("pos") + F.col("_first")).drop("_first").withColumn("entity_id", F.format_string("ent_%03d", "pos")).select("*", F.col("w.text").alias("text"), "w.bbox.*").drop("w")


def pack_ocr(words: DataFrame, block: str, threshold: float = 0.0) -> DataFrame:
    """Lines of text per block (words in order) for words above the confidence threshold."""
    kept = words.filter((F.col("ocr_confidence") > threshold) & (F.trim("text") != ""))
    joined = lambda key, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col(text).alias("t")))), lambda s: s["t"]), " ")
    parts = kept.withColumn("_t", F.trim("text")).groupBy(*PAGE, block, F.expr(f"entity_seq div {PART}").alias("part")).agg(joined("entity_seq", "_t").alias("line"), F.count("*").alias("words"))
    return parts.groupBy(*PAGE, block).agg(joined("part", "line").alias("line"), F.sum("words").alias("words"))


def ocr_statistics(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words, lines, characters and mean confidence per page."""
    w = words.groupBy(*PAGE).agg(F.count_if(F.trim("text") != "").alias("total_words"), F.avg("ocr_confidence").alias("average_confidence"))
    n = lines.groupBy(*PAGE).agg(F.count("*").alias("total_lines"), F.sum(F.length("line")).alias("line_characters"))
    return w.join(n, PAGE, "left").withColumn("total_characters", F.col("line_characters") + F.col("total_lines") - 1).drop("line_characters")


def label_lookup(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Label file of each page request: exact key, underscore key, core name and page, whole-file label.

    ``requests``: request_id, stem, page; ``files``: name. Each way is one equi join on its own key.
    """
    page = F.lpad(F.col("page").cast("string"), 3, "0")
    core = F.array_join(F.slice(F.split("stem", "_"), F.lit(3), F.greatest(F.size(F.split("stem", "_")), F.lit(0))), "_")
    has_core = F.size(F.split("stem", "_")) >= 3
    asked = requests.select(
        "request_id", F.concat("stem", F.lit("_page"), page, F.lit("_label.json")).alias("k1"), F.concat("stem", F.lit("_page_"), page, F.lit("_label.json")).alias("k2"),
        F.when(has_core, F.concat_ws("#", core, page)).alias("k3"), F.concat("stem", F.lit("_label.json")).alias("k4"))
    shape = r"^[0-9]{8}_[0-9]{6}_(.+)_page_?([0-9]{3})_label\.json$"
    by_name = files.select(F.col("name")).distinct()
    cores = files.filter(F.col("name").rlike(shape)).groupBy(F.concat_ws("#", F.regexp_extract("name", shape, 1), F.regexp_extract("name", shape, 2)).alias("k3")).agg(F.min("name").alias("n3"))
    out = asked
    for i in (1, 2, 4):
        out = out.join(by_name.select(F.col("name").alias(f"k{i}"), F.col("name").alias(f"n{i}")), f"k{i}", "left")
    out = out.join(cores, "k3", "left")
    way = F.when(F.col("n1").isNotNull(), "page").when(F.col("n2").isNotNull(), "underscore").when(F.col("n3").isNotNull(), "core").when(F.col("n4").isNotNull(), "file")
    return out.select("request_id", F.coalesce("n1", "n2", "n3", "n4").alias("name"), way.alias("found_by"))
