"""Page templates: learned per document type and layout signature, matched to pages, used for prediction.

A template is one row of ``templates`` and one row per field in ``fields``. Their number grows with the layouts in the data,
so pages are not compared with all of them: ``match`` finds the best one by upper bounds of the score.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions.bbox import Box
from ..functions.signature import label_grid_signature
from ..scale import PAGE, beside, checked_broadcast, cut, entity_levels, parked, ranked, rule_table, topk
from ..schema import PAGE_HEIGHT, PAGE_WIDTH
from . import sequences as SQ
from .grouping import bin_rows, table_regions

TKEY = ["doc_type", "signature"]
PLACES = 1 << 32  # over any field number; with at most 10**9 points above it, both fit in 63 bits


@dataclass(frozen=True)
class Templates:
    """Learned tables: templates, their fields, their frequent rows, the tables on their first pages."""

    templates: DataFrame
    fields: DataFrame
    rows: DataFrame
    tables: DataFrame


def page_signatures(boxes: DataFrame) -> DataFrame:
    """Document type and layout signature of each page."""
    kinds = boxes.groupBy(*PAGE).agg(F.min("doc_type").alias("doc_type"))
    return label_grid_signature(boxes).join(kinds, PAGE)


def _groups(signed: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    total = signed.agg(F.count("*").alias("_total"))
    counted = signed.groupBy(*TKEY).agg(F.count("*").alias("samples"))
    return counted.transform(beside, total).filter((F.col("samples") >= min_pages) & (F.col("samples") >= F.col("_total") * min_share)).drop("_total")


def _normal(boxes: DataFrame) -> DataFrame:
    for name, size in (("x", PAGE_WIDTH), ("y", PAGE_HEIGHT), ("width", PAGE_WIDTH), ("height", PAGE_HEIGHT)):
        boxes = boxes.withColumn(f"{name}n", F.col(name) / size)
    return boxes


def learn(boxes: DataFrame, min_pages: int = 2, min_share: float = 0.0, keep: float = 0.5, required: float = 0.8, row_share: float = 0.3,
          table_pages: int = 3) -> Templates:
    """Templates of all groups of at least ``min_pages`` pages (and ``min_share`` of all pages).

    A field is kept when its box count is at least ``keep`` of the pages, it is required from ``required`` on. Fields are
    computed once; signatures that boxes meet are made again, so that they lie with the boxes of their page and no box is
    moved. ``tables``: table regions on the first ``table_pages`` pages of the group.
    """
    signed = page_signatures(boxes)
    once = cut(signed)
    groups = checked_broadcast(_groups(once, min_pages, min_share))
    member = signed.join(groups, TKEY)
    own = _normal(boxes.drop("doc_type")).join(member, PAGE)
    key = [*TKEY, "label"]
    stats = [a for c in ("xn", "yn", "widthn", "heightn") for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    found = SQ.text_patterns(own.filter("label <> ''"), [*key, "samples"], stats)
    share = F.col("n") / F.col("samples")
    fields = cut(found.filter(share >= keep).withColumn("share", share).withColumn("required", share >= required))
    names = fields.groupBy(*TKEY, "samples").agg(F.count("*").alias("n_fields"), F.array_join(F.array_sort(F.collect_set("label")), "").alias("_names"),
                                                 F.concat_ws(">", F.transform(F.array_sort(F.collect_list(F.struct(F.round("yn_mean", 9), F.round("xn_mean", 9), "label"))), lambda s: s["label"])).alias("field_order"))
    ident = F.substring(F.md5(F.concat_ws("_", "doc_type", "signature", F.col("n_fields").cast("string"), "_names")), 1, 12)
    templates = names.withColumn("template_id", ident).withColumn("name", F.concat_ws("_", "doc_type", "signature")).drop("_names")
    sequences = SQ.bin_sequences(boxes.select(*PAGE, "entity_seq", "label", "x", "y", "height")).join(member, PAGE).groupBy(*TKEY, "samples", "sequence").agg(F.count("*").alias("n"))
    rows = sequences.filter(F.col("n") >= F.col("samples") * row_share)
    ids = templates.select(*TKEY, "template_id")
    rows = rows.join(ids, TKEY).drop("samples")
    first = topk(once.join(ids, TKEY).select("template_id", *PAGE), ["template_id"], PAGE, table_pages).drop("rank")
    tables = page_tables(boxes).join(first, PAGE).groupBy("template_id").agg(F.sum("tables").alias("tables"))
    return Templates(templates, fields.join(ids, TKEY), rows, tables)


def stored(known: Templates) -> Templates:
    """The learned tables computed once, for use in several jobs."""
    return Templates(cut(known.templates), cut(known.fields), cut(known.rows), cut(known.tables))


def page_tables(boxes: DataFrame) -> DataFrame:
    """Number of table regions of the pages that have any."""
    return table_regions(boxes).groupBy(*PAGE).agg(F.count("*").alias("tables"))


def template_areas(boxes: DataFrame, samples: int = 3) -> DataFrame:
    """Table, header and footer areas per document type and signature, from its first pages (``samples`` of them for the
    tables, the first one for header and footer)."""
    signed = page_signatures(boxes)
    first = topk(signed, TKEY, PAGE, samples, "nth")
    b = Box.of()
    tables = table_regions(boxes).join(first, PAGE).groupBy(*TKEY).agg(
        F.count("*").alias("tables"), F.min("x").alias("tx0"), F.min("y").alias("ty0"), F.max(b.right).alias("tx1"), F.max(b.bottom).alias("ty1"))
    zone = F.when(F.col("y") < PAGE_HEIGHT * 0.15, "header").when(F.col("y") > PAGE_HEIGHT * 0.85, "footer")
    edge = boxes.drop("doc_type").join(first.filter("nth = 1"), PAGE).withColumn("zone", zone).groupBy(*TKEY).agg(*[
        f(F.when(F.col("zone") == z, v)).alias(f"{z}_{n}") for z in ("header", "footer")
        for n, f, v in (("x0", F.min, b.x), ("y0", F.min, b.y), ("x1", F.max, b.right), ("y1", F.max, b.bottom))])
    return edge.join(tables, TKEY, "left").withColumn("tables", F.coalesce("tables", F.lit(0)))


def template_relations(boxes: DataFrame) -> DataFrame:
    """Labels that share a row, per document type and signature."""
    signed = page_signatures(boxes)
    per = bin_rows(boxes.drop("doc_type").filter("label <> ''"), 30).groupBy(*PAGE, "bin", "label").agg(F.count("*").alias("n"))
    sets = per.groupBy(*PAGE, "bin").agg(F.array_sort(F.collect_list(F.struct("label", (F.col("n") > 1).alias("twice")))).alias("labels"))
    kinds = sets.join(signed, PAGE).select(*TKEY, "labels").distinct()
    pairs = F.flatten(F.transform("labels", lambda a: F.transform(
        F.filter("labels", lambda b: (a["label"] != b["label"]) | a["twice"]), lambda b: F.struct(a["label"].alias("label"), b["label"].alias("other")))))
    return kinds.select(*TKEY, F.inline(pairs)).distinct()


# Shares of the field, position, structure and pattern scores.
WEIGHTS = (0.4, 0.3, 0.2, 0.1)
CELL = (248, 100)  # pixels of a cell; pages with the same labels in the same cells get one bound
EPS = 1e-6


def page_groups(boxes: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages of a like layout put together: (pages with their group and row sequences, groups, the cells of the groups).

    Pages of a group agree in document type, number of tables, and in how many boxes of each label each cell has. A group's
    cell keeps the range of positions in it, so every box of every page of the group lies in it. Cells of a page are bounded
    by its size, not by its boxes. All of it is made where the boxes lie, and made again for the cells instead of stored.
    """
    ranges = [f"{c}_{e}" for c in ("x", "y") for e in ("low", "high")]
    cells = boxes.filter("label <> ''").groupBy(*PAGE, "label", F.floor(F.col("x") / CELL[0]).alias("cx"), F.floor(F.col("y") / CELL[1]).alias("cy")).agg(
        F.min("doc_type").alias("doc_type"), F.count("*").alias("n"), *[f(c).alias(f"{c}_{e}") for c in ("x", "y") for f, e in ((F.min, "low"), (F.max, "high"))])
    held = cells.groupBy(*PAGE).agg(F.min("doc_type").alias("doc_type"), F.array_sort(F.collect_list(F.struct("label", "cx", "cy", "n", *ranges))).alias("cells"))
    held = held.join(page_tables(boxes), PAGE, "left").withColumn("tables", F.coalesce("tables", F.lit(0)))
    shape = F.transform("cells", lambda c: F.struct(*[c[k].alias(k) for k in ("label", "cx", "cy", "n")])).alias("shape")
    named = held.withColumn("grp", F.unhex(F.sha2(F.to_json(F.struct("doc_type", "tables", shape)), 256)))
    rows = sequences.groupBy(*PAGE).agg(F.sort_array(F.collect_set("sequence")).alias("sequences"))
    pages = parked(named.select(*PAGE, "grp", "tables").join(rows, PAGE, "left"))
    places = cut(named.select("grp", "doc_type", "tables", F.inline("cells")).groupBy("grp", "label", "cx", "cy").agg(
        *[F.first(c).alias(c) for c in ("doc_type", "tables", "n")], *[(F.min if c.endswith("low") else F.max)(c).alias(c) for c in ranges]))
    groups = cut(places.groupBy("grp").agg(F.first("doc_type").alias("doc_type"), F.array_sort(F.collect_set("label")).alias("labels"), F.first("tables").alias("tables")))
    return pages, groups, places.drop("doc_type", "tables")


def field_scores(groups: DataFrame, known: Templates, least: float) -> DataFrame:
    """``labels, scope, template_id, field_score`` of label sets and templates whose field score is at least ``least``.

    Templates are found by an inverted index of their labels, the rarest first: what is left behind the indexed ones could
    not reach ``least`` without them. A label set looks among the templates of its document type; among all of them if the
    type is unknown or has none.
    """
    often = known.fields.groupBy("label").agg(F.count("*").alias("_often"))
    kinds = known.templates.select("template_id", "doc_type")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_often", "label", "required"))), lambda v: F.struct(v.label.alias("label"), v.required.alias("required")))
    lists = cut(known.fields.join(often, "label").groupBy("template_id").agg(ordered.alias("fields")).join(kinds, "template_id"))
    size, need = F.size("fields"), F.greatest(F.size(F.filter("fields", lambda v: v.required)), F.lit(1))
    rest = lambda k: F.slice("fields", k + 1, F.greatest(size, F.lit(1)))
    bound = lambda k: F.size(F.filter(rest(k), lambda v: v.required)) / need * 0.6 + F.size(rest(k)) / size * 0.4
    enough = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), size), lambda k: bound(k) < least - EPS)), size)
    index = lists.select("template_id", "doc_type", F.explode(F.slice("fields", F.lit(1), enough)["label"]).alias("label"))
    index = index.select("template_id", "label", F.explode(F.array("doc_type", F.lit("*"))).alias("scope"))
    own = known.templates.filter("doc_type <> 'unknown'").select(F.col("doc_type").alias("_type")).distinct()
    scoped = groups.join(own, F.col("doc_type") == F.col("_type"), "left").select("labels", F.coalesce("_type", F.lit("*")).alias("scope")).distinct()
    met = scoped.select("labels", "scope", F.explode("labels").alias("label")).join(index, ["scope", "label"]).select("labels", "scope", "template_id").distinct()
    shared = F.filter("fields", lambda v: F.array_contains("labels", v.label))
    extra = F.greatest(F.lit(0.0), 1 - (F.size("labels") - F.size(shared)) * 0.05)
    score = (F.size(F.filter(shared, lambda v: v.required)) / need * 0.6 + F.size(shared) / size * 0.4) * extra
    return met.join(lists, "template_id").select("labels", "scope", "template_id", score.alias("field_score")).filter(F.col("field_score") >= least - EPS)


def structure_score(tables: Column, wanted_tables: Column, hits: Column, wanted: Column, has_rows: Column) -> Column:
    """Mean of the table part and the row part, as far as template and page have them; 0.5 if there is neither."""
    table = F.when((wanted_tables > 0) & (tables > 0), F.least(tables, wanted_tables) / wanted_tables)
    row = F.when((wanted > 0) & has_rows, hits / wanted)
    return F.coalesce((table + row) / 2, table, row, F.lit(0.5))


def bounds(groups: DataFrame, places: DataFrame, lines: DataFrame, known: Templates, least: float) -> DataFrame:
    """``grp, template_id, field_score, bound``: no page of the group scores higher than ``bound`` with the template.

    ``lines``: row sequences that occur on any page of the group, and whether every page has some (``grp, sequence, all_have``).
    """
    own = known.templates.filter("doc_type <> 'unknown'").select(F.col("doc_type").alias("_type")).distinct()
    scoped = groups.join(own, F.col("doc_type") == F.col("_type"), "left").withColumn("scope", F.coalesce("_type", F.lit("*"))).drop("_type")
    pairs = cut(scoped.join(field_scores(groups, known, least), ["labels", "scope"]).select("grp", "tables", "template_id", "field_score"))
    gap = lambda c, size: F.greatest(F.lit(0.0), F.col(f"{c}_low") / size - F.col(f"{c}n_mean"), F.col(f"{c}n_mean") - F.col(f"{c}_high") / size)
    near = lambda c, size: F.greatest(F.lit(0.0), 1 - gap(c, size) / F.greatest(F.col(f"{c}n_std") * 3, F.lit(0.1)))
    fields = checked_broadcast(known.fields.select("template_id", "label", "xn_mean", "yn_mean", "xn_std", "yn_std"))
    placed = pairs.select("grp", "template_id").join(places, "grp").join(fields, ["template_id", "label"])
    position = placed.groupBy("grp", "template_id").agg((F.sum(F.col("n") * (near("x", PAGE_WIDTH) + near("y", PAGE_HEIGHT)) / 2) / F.sum("n")).alias("position"))
    hits = lines.select("grp", "sequence").join(known.rows.select("template_id", "sequence"), "sequence").groupBy("grp", "template_id").agg(F.count("*").alias("hits"))
    have = lines.groupBy("grp").agg(F.min("all_have").alias("all_have"))
    full = pairs.join(position, ["grp", "template_id"], "left").join(hits, ["grp", "template_id"], "left").join(_wanted(known), "template_id", "left").join(have, "grp", "left")
    at = lambda rows: structure_score(F.col("tables"), F.col("wanted_tables"), F.coalesce("hits", F.lit(0)), F.col("wanted"), rows)
    structure = F.greatest(at(F.col("all_have").isNotNull()), F.when(~F.coalesce("all_have", F.lit(False)), at(F.lit(False))))
    f, p, s, t = WEIGHTS
    bound = F.col("field_score") * f + F.coalesce("position", F.lit(0.0)) * p + structure * s + t
    return full.select("grp", "template_id", "field_score", bound.alias("bound"))


def _wanted(known: Templates) -> DataFrame:
    rows = known.rows.groupBy("template_id").agg(F.count("*").alias("wanted"), F.collect_set("sequence").alias("wanted_rows"))
    return checked_broadcast(known.templates.select("template_id").join(rows, "template_id", "left").join(known.tables.withColumnRenamed("tables", "wanted_tables"), "template_id", "left"))


def _has(name: str) -> Column:
    return F.array_contains(F.split("patterns", ","), name)


def _shapes(text: Column) -> list[Column]:
    """What the fields ask of a text, looked at once for each box."""
    return [F.length(text).alias("_size"), text.rlike("^[0-9]+$").alias("_digits"), text.rlike("^[A-Za-z0-9]+$").alias("_plain")]


def exact_scores(boxes: DataFrame, pairs: DataFrame, sequences: DataFrame | None, known: Templates, also: Sequence[str] = ()) -> DataFrame:
    """The four scores and their weighted sum of given pairs (page key, tables, template_id, field_score and ``also``).

    ``sequences``: the different row sequences of the pages; None if the pairs bring those of their page as an array of this
    name. It is null for a page without any row, which is told apart from one without a hit.
    """
    if sequences is not None:
        pairs = pairs.join(sequences.groupBy(*PAGE).agg(F.collect_set("sequence").alias("sequences")), PAGE, "left")
    fields = checked_broadcast(known.fields.select(
        "template_id", "label", "xn_mean", "yn_mean", F.greatest(F.col("xn_std") * 3, F.lit(0.1)).alias("xn_reach"), F.greatest(F.col("yn_std") * 3, F.lit(0.1)).alias("yn_reach"),
        F.round("length_mean").alias("size"), _has("numeric").alias("is_num"), _has("alphanumeric").alias("is_aln")))
    near = lambda axis: F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"{axis}n") - F.col(f"{axis}n_mean")) / F.col(f"{axis}n_reach"))
    fits = (F.abs(F.col("_size") - F.col("size")) < 5) | (F.col("is_num") & F.col("_digits")) | (F.col("is_aln") & F.col("_plain"))
    seen = boxes.select(*PAGE, "label", (F.col("text") != "").alias("_some"), *_shapes(F.col("text")), (F.col("x") / PAGE_WIDTH).alias("xn"), (F.col("y") / PAGE_HEIGHT).alias("yn"))
    met = seen.join(pairs.select(*PAGE, "template_id"), PAGE).join(fields, ["template_id", "label"])
    sums = met.groupBy(*PAGE, "template_id").agg(F.avg((near("x") + near("y")) / 2).alias("position_score"), F.avg(F.when(F.col("_some"), F.when(fits, 1.0).otherwise(0.0))).alias("pattern_score"))
    full = pairs.join(sums, [*PAGE, "template_id"], "left").join(_wanted(known), "template_id", "left")
    listed = F.col("sequences").isNotNull()
    hits = F.when(listed, F.coalesce(F.size(F.array_intersect("sequences", "wanted_rows")), F.lit(0)))
    structure = structure_score(F.col("tables"), F.col("wanted_tables"), hits, F.col("wanted"), listed)
    f, p, s, t = WEIGHTS
    score = F.col("field_score") * f + F.coalesce("position_score", F.lit(0.0)) * p + F.col("structure_score") * s + F.coalesce("pattern_score", F.lit(0.5)) * t
    return full.withColumn("structure_score", structure).withColumn("score", F.round(score, 9)).select(
        *PAGE, *also, "template_id", "score", "field_score", "position_score", "structure_score", "pattern_score")


def match(boxes: DataFrame, known: Templates, threshold: float = 0.7) -> DataFrame:
    """Best template of each page with its four scores: 0.4 field + 0.3 position + 0.2 structure + 0.1 pattern.

    Templates without a label of the page cannot reach more than 0.3, so ``threshold`` must be above that. Groups of like
    pages get an upper bound per template; each page is scored with the template of the highest bound, and after that only
    with those whose bound is not below the score it has already.
    """
    if threshold <= WEIGHTS[2] + WEIGHTS[3]:
        raise ValueError("the threshold must be above what a template without a common label can reach")
    least = (threshold - sum(WEIGHTS[1:])) / WEIGHTS[0]
    sequences = SQ.bin_sequences(boxes.select(*PAGE, "entity_seq", "label", "x", "y", "height")).select(*PAGE, "sequence").distinct()
    pages, groups, places = page_groups(boxes, sequences)
    all_have = pages.groupBy("grp").agg(F.bool_and(F.col("sequences").isNotNull()).alias("all_have"))
    lines = pages.select("grp", F.explode("sequences").alias("sequence")).distinct().join(all_have, "grp")
    upper = cut(bounds(groups, places, lines, known, least).filter(F.col("bound") >= threshold - EPS))
    top = upper.groupBy("grp").agg(F.max_by(F.struct("template_id", "field_score"), F.struct("bound", "template_id")).alias("t")).select("grp", "t.*")
    kept = ["grp", "tables", "sequences"]
    seeds = parked(exact_scores(boxes, pages.join(top, "grp"), None, known, kept))
    # Pairs are cut by the lowest score of the group first, then by the score of each page.
    scored = seeds.select(*PAGE, *kept, F.col("template_id").alias("_own"), F.col("score").alias("_score"))
    floor = scored.groupBy("grp").agg(F.min("_score").alias("_floor"))
    open_ = upper.join(floor, "grp").filter(F.col("bound") >= F.col("_floor") - EPS).drop("_floor")
    more = scored.join(open_, "grp").filter((F.col("bound") >= F.col("_score") - EPS) & (F.col("template_id") != F.col("_own")))
    rest = exact_scores(boxes, parked(more.select(*PAGE, "tables", "sequences", "template_id", "field_score")), None, known)
    best = seeds.drop(*kept).unionByName(rest).groupBy(*PAGE).agg(F.max_by(
        F.struct("template_id", "score", "field_score", "position_score", "structure_score", "pattern_score"), F.struct("score", "template_id")).alias("b"))
    return best.select(*PAGE, "b.*").filter(F.col("score") >= threshold)


def predict(boxes: DataFrame, matched: DataFrame, known: Templates, above: float = 0.5) -> DataFrame:
    """Best field of the matched template per box: 0.6 position + 0.4 pattern, over ``above``.

    A box meets the fields of its own template; the winner is a maximum over one number (score, then field order), so the
    reduction is a hash aggregate on the partitioning of the page join.
    """
    place = F.row_number().over(W.partitionBy("template_id").orderBy("label"))  # fields of one template: the vocabulary
    table = checked_broadcast(known.fields.select(
        "template_id", "label", place.alias("idx"), "xn_mean", "yn_mean", F.greatest("xn_std", "yn_std", F.lit(0.01)).alias("spread"), F.round("length_mean").alias("size"),
        _has("numeric").alias("is_num"), _has("alphanumeric").alias("is_aln"), "prefix", "suffix"))
    text = F.col("text")

    # Pattern score: mean over the patterns the field has; numeric and alphanumeric count only when they fit.
    parts = [
        (F.col("is_num") & F.col("_digits"), F.lit(1.0)), (F.col("is_aln") & F.col("_plain"), F.lit(1.0)),
        (F.col("size").isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(F.col("_size") - F.col("size")) / 10)),
        (F.col("prefix").isNotNull(), text.startswith(F.col("prefix")).cast("double")), (F.col("suffix").isNotNull(), text.endswith(F.col("suffix")).cast("double")),
    ]
    count = sum((F.when(test, 1).otherwise(0) for test, _ in parts), F.lit(0))
    total = sum((F.when(test, value).otherwise(0.0) for test, value in parts), F.lit(0.0))
    pattern = F.when((text == "") | (count == 0), 0.5).otherwise(total / count)
    dx, dy = F.col("xn") - F.col("xn_mean"), F.col("yn") - F.col("yn_mean")
    position = F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy) / (F.col("spread") * 5))
    points = F.round((position * 0.6 + pattern * 0.4) * 1_000_000_000).cast("long")
    narrow = boxes.select(*PAGE, "entity_seq", "text", *_shapes(text), (F.col("x") / PAGE_WIDTH).alias("xn"), (F.col("y") / PAGE_HEIGHT).alias("yn"))
    met = narrow.join(matched.select(*PAGE, "template_id", F.col("score").alias("match_score")), PAGE).join(table, "template_id")
    best = met.groupBy(*PAGE, "entity_seq", "template_id", "match_score").agg(F.max(points * PLACES + (PLACES - 1) - F.col("idx")).alias("_best"))
    score = F.expr(f"_best div {PLACES}") / 1_000_000_000
    found = best.withColumn("score", score).filter(F.col("score") > above).withColumn("idx", (PLACES - 1 - F.pmod("_best", F.lit(PLACES))).cast("int"))
    return found.join(table.select("template_id", "idx", F.col("label").alias("predicted")), ["template_id", "idx"]).select(
        *PAGE, "entity_seq", "template_id", "predicted", (F.col("score") * F.col("match_score")).alias("confidence"))


def missing_required(matched: DataFrame, predicted: DataFrame, known: Templates) -> DataFrame:
    """Required fields of the matched template without a prediction on the page."""
    want = matched.select(*PAGE, "template_id").join(checked_broadcast(known.fields.filter("required").select("template_id", F.col("label").alias("field"))), "template_id")
    return want.join(predicted.select(*PAGE, F.col("predicted").alias("field")).distinct(), [*PAGE, "field"], "left_anti")


def update(known: Templates, boxes: DataFrame, matched: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Field positions after new pages, as an exponential mean in page order.

    After n boxes the mean is (1 - a)^n old + sum of a (1 - a)^(n - i) x_i: ranks and a weighted sum, no fold over a list.
    """
    old = known.fields.select("template_id", "label", "n", "xn_mean", "yn_mean", "widthn_mean", "heightn_mean")
    new = _normal(boxes.drop("doc_type")).join(matched.select(*PAGE, "template_id"), PAGE).join(checked_broadcast(old.select("template_id", "label")), ["template_id", "label"])
    key = ["template_id", "label"]
    order = ranked(new.select(*key, *PAGE, "entity_seq", "xn", "yn", "widthn", "heightn"), key, [*PAGE, "entity_seq"], entity_levels(), "i")
    size = new.groupBy(*key).agg(F.count("*").alias("m"))
    left = F.pow(F.lit(1 - alpha), F.col("m") - F.col("i"))
    sums = order.join(checked_broadcast(size), key).groupBy(*key, "m").agg(*[F.sum(left * F.col(c) * alpha).alias(f"{c}_add") for c in ("xn", "yn", "widthn", "heightn")])
    keep = F.pow(F.lit(1 - alpha), F.coalesce("m", F.lit(0)))
    return old.join(sums, key, "left").select(
        *key, (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), *[(keep * F.col(f"{c}_mean") + F.coalesce(f"{c}_add", F.lit(0.0))).alias(f"{c}_mean") for c in ("xn", "yn", "widthn", "heightn")])


def statistics(known: Templates) -> DataFrame:
    """Templates, samples and field frequency as (section, name, n) rows."""
    kinds = known.templates.groupBy(F.col("doc_type").alias("name")).agg(F.count("*").alias("n")).withColumn("section", F.lit("templates_per_type"))
    samples = known.templates.groupBy(F.col("doc_type").alias("name")).agg(F.sum("samples").alias("n")).withColumn("section", F.lit("samples_per_type"))
    fields = known.fields.groupBy(F.col("label").alias("name")).agg(F.count_distinct("template_id").alias("n")).withColumn("section", F.lit("field_coverage"))
    return kinds.unionByName(samples).unionByName(fields).select("section", "name", "n")


def layout_templates(boxes: DataFrame, layouts: DataFrame, templates: Mapping[str, Mapping], above: float = 0.5) -> DataFrame:
    """Best of a fixed list of templates: 0.3 for the layout, 0.1 per text pattern and 0.2 per position found on the page.

    Every pattern and position is one flag of a single aggregate over the page. ``layouts``: page key, pattern.
    """
    b = Box.of()
    flags, scores = [], []
    for ident, t in templates.items():
        parts = []
        for i, shape in enumerate(t["patterns"].values()):
            flags.append(F.bool_or(F.col("text").rlike(f"^(?:{shape})")).alias(f"{ident}_p{i}"))
            parts.append(F.when(F.col(f"{ident}_p{i}"), 0.1).otherwise(0.0))
        for i, (x, y, reach) in enumerate(t["positions"].values()):
            near = (F.abs(b.cx / PAGE_WIDTH - x) < reach) & (F.abs(b.cy / PAGE_HEIGHT - y) < reach)
            flags.append(F.bool_or(near).alias(f"{ident}_q{i}"))
            parts.append(F.when(F.col(f"{ident}_q{i}"), 0.2).otherwise(0.0))
        base = F.when(F.col("pattern") == t["layout"], 0.3).otherwise(0.0)
        scores.append(F.struct(F.round(sum(parts, base), 6).alias("score"), F.lit(-len(scores)).alias("first"), F.lit(ident).alias("template")))
    best = boxes.groupBy(*PAGE).agg(*flags).join(layouts.select(*PAGE, "pattern"), PAGE).withColumn("b", F.array_max(F.array(*scores)))
    return best.select(*PAGE, F.col("b.score").alias("score"), F.when(F.col("b.score") > above, F.col("b.template")).alias("template"))


def signature_templates(signatures: DataFrame, vendor: str, min_pages: int = 2) -> DataFrame:
    """Layout templates of vendors: signatures shared by at least ``min_pages`` pages, with their most frequent vendor."""
    per = signatures.groupBy("signature", vendor).agg(F.count("*").alias("n")).groupBy("signature").agg(
        F.max_by(vendor, F.struct("n", vendor)).alias("vendor"), F.sum("n").alias("samples"))
    return per.filter(F.col("samples") >= min_pages)


VARIANTS = 1000  # forms of a signature with parts left out; longer signatures are compared by their rarest parts


def suggest(signatures: DataFrame, templates: DataFrame, above: float = 0.6, top: int = 5) -> DataFrame:
    """Templates whose signature shares more than ``above`` of its parts with the page, best ``top`` per page.

    Pages with equal signatures are compared once. Parts are numbered, so equal ones stand at equal places. Signatures of n
    parts that differ in d of them are equal with those d left out: equal ones meet first, then those that differ in one
    part, and so on, each time for the signatures that have not found ``top`` templates yet.
    """
    def numbered(df: DataFrame, name: str) -> DataFrame:
        parts = F.split("signature", "[|]")
        return cut(df.withColumn(name, F.monotonically_increasing_id()).withColumn("_all", parts).withColumn("_n", F.size(parts)))

    mine, known = numbered(signatures.select("signature").distinct(), "_m"), numbered(templates, "_t")
    lengths = [r[0] for r in mine.select("_n").distinct().collect()]
    least = {n: next((k for k in range(n + 1) if k / n > above), None) for n in lengths}
    differ = {n: n - k for n, k in least.items() if k is not None}
    short = {n: d for n, d in differ.items() if sum(math.comb(n, k) for k in range(d + 1)) <= VARIANTS}
    long = F.col("_n").isin([n for n in differ if n not in short])
    close = _alike(mine, known, short, top)
    if len(short) < len(differ):
        close = close.unionByName(_alike_by_rare_parts(mine.filter(long), known.filter(long), above))
    close = close.join(known.drop("_all", "_n").withColumnRenamed("signature", "template"), "_t").drop("_t")
    best = topk(close, ["_m"], [F.col("similarity").desc(), "template"], top).join(mine.select("_m", "signature"), "_m").drop("_m")
    found = [c for c in best.columns if c != "signature"]
    lists = best.groupBy("signature").agg(F.collect_list(F.struct(*found)).alias("_best"))
    return signatures.select(*PAGE, "signature").join(lists, "signature").select(*PAGE, F.inline("_best"))


def _alike(mine: DataFrame, known: DataFrame, differ: Mapping[int, int], top: int) -> DataFrame:
    """``_m, _t, similarity``, the best ``top`` of each ``_m`` at least; ``differ``: by length, in how many parts they may differ.

    Of the templates that are equal with the same parts left out only the first ``top`` by name can be among the best: all
    of them are as near as the others, or nearer.
    """
    found = mine.select("_m", F.lit(0).cast("long").alias("_t"), F.lit(0.0).alias("similarity"), F.lit("").alias("_name")).limit(0)
    for d in range(max(differ.values(), default=-1) + 1):
        forms = [(n, i, list(gone)) for n, most in differ.items() if d <= most for i, gone in enumerate(itertools.combinations(range(n), d))]
        forms = rule_table(mine.sparkSession, forms, "_n int, _form int, _out array<int>")

        def variants(df: DataFrame, *cols: str) -> DataFrame:
            left = F.filter("_all", lambda p, i: ~F.array_contains("_out", i))
            gone = F.transform("_out", lambda i: F.get("_all", i))
            return df.join(forms, "_n").select(*cols, "_n", "_form", F.unhex(F.md5(F.concat_ws("|", left))).alias("_left"), gone.alias("_gone"))

        full = found.groupBy("_m").count().filter(F.col("count") >= top).select("_m")
        here = topk(variants(known, "_t", "signature"), ["_n", "_form", "_left"], ["signature"], top).withColumnRenamed("_gone", "_other").drop("rank")
        met = variants(mine.join(full, "_m", "left_anti"), "_m").join(here, ["_n", "_form", "_left"])
        # A pair that differs in fewer parts was met before.
        new = met.filter(~F.arrays_overlap("_gone", "_other")).select("_m", "_t", ((F.col("_n") - d) / F.col("_n")).alias("similarity"), F.col("signature").alias("_name"))
        found = cut(found.unionByName(topk(new, ["_m"], ["_name"], top).drop("rank")))
    return found.drop("_name")


def _alike_by_rare_parts(mine: DataFrame, known: DataFrame, above: float) -> DataFrame:
    """``_m, _t, similarity`` of all pairs over ``above``.

    Signatures of n parts must agree in more than above x n of them, so with the parts of both in one order they agree in one
    of the first n - need + 1. The order is by rarity: those parts are the join key, the rest is checked on the pairs found.
    """
    parts = mine.select("_all").unionByName(known.select("_all")).select(F.explode("_all").alias("_part"))
    often = cut(parts.groupBy("_part").agg(F.count("*").alias("_often")).withColumn("_word", F.monotonically_increasing_id()))

    def words(df: DataFrame, name: str) -> DataFrame:
        """Parts as numbers, the rarest first."""
        listed = df.select(name, F.explode("_all").alias("_part")).join(often, "_part").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_often", "_word"))).alias("_l"))
        return cut(listed.select(name, F.transform("_l", lambda s: s["_word"]).alias(f"{name}_words")))

    def rare(df: DataFrame, name: str) -> DataFrame:
        n = F.size(f"{name}_words")
        first = F.slice(f"{name}_words", F.lit(1), F.greatest(n - F.floor(n * above), F.lit(0)).cast("int"))
        return df.select(name, n.alias("_n"), F.explode(first).alias("_word"))

    own, other = words(mine, "_m"), words(known, "_t")
    met = rare(own, "_m").join(rare(other, "_t"), ["_n", "_word"]).select("_m", "_t").distinct()
    # The parts of a signature are numbered, so they are all different: shared ones can be counted as a set.
    both = met.join(own, "_m").join(other, "_t").select("_m", "_t", (F.size(F.array_intersect("_m_words", "_t_words")) / F.size("_m_words")).alias("similarity"))
    return both.filter(F.col("similarity") > above)


def presence(known: Templates, labels: Sequence[str]) -> DataFrame:
    """Field presence of each template as numbers."""
    return known.fields.groupBy("template_id").agg(*[F.max(F.when(F.col("label") == name, 1.0).otherwise(0.0)).alias(f"f{i}") for i, name in enumerate(labels)])
