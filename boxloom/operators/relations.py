"""Relations between boxes of one page.

Distance-limited relations use grid cells, so far boxes never meet and a crowded page is spread over its cells. Counts
over a whole row or page come from the distinct positions of the page or from arrays of its boxes, without pair rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..functions import bbox as B
from ..functions.bbox import Box
from ..pages import over_pages
from ..scale import PAGE, SPOTS, block_join, crowded, near_pairs, ranked, usual_pages
from ..schema import PAGE_WIDTH
from .grouping import band_groups

SIDE = ["entity_seq", "label", "text", "x", "y", "width", "height"]


def _sides(boxes: DataFrame) -> DataFrame:
    b = Box.of()
    return boxes.select(*PAGE, *SIDE, b.cx2.cast("long").alias("cx2"), b.cy2.cast("long").alias("cy2"))


def _within(reach: float, strict: bool = False) -> Column:
    dx, dy = F.col("a_cx2") - F.col("b_cx2"), F.col("a_cy2") - F.col("b_cy2")
    limit = (2 * reach) ** 2
    return dx * dx + dy * dy < limit if strict else dx * dx + dy * dy <= limit


def close_pairs(boxes: DataFrame, reach: float, ordered: bool = False, strict: bool = False) -> DataFrame:
    """Pairs of boxes whose centers are within ``reach`` px: each pair once, or both ways with ``ordered``."""
    s = _sides(boxes)
    once = F.col("a_entity_seq") != F.col("b_entity_seq") if ordered else F.col("a_entity_seq") < F.col("b_entity_seq")
    return near_pairs(s, s, PAGE, {"cx2": 2 * reach, "cy2": 2 * reach}, once & _within(reach, strict))


def spatial_relations(boxes: DataFrame, reach: float = 200) -> DataFrame:
    """Distance, angle, relation type, overlap and alignment of each pair within ``reach``."""
    a, b = Box.of("a_"), Box.of("b_")
    return close_pairs(boxes, reach).select(
        *PAGE, F.col("a_entity_seq").alias("source"), F.col("b_entity_seq").alias("target"), B.distance(a, b).alias("distance"),
        F.atan2(b.cy - a.cy, b.cx - a.cx).alias("angle"), B.relation(a, b).alias("relation"), B.iou(a, b).alias("iou"),
        B.alignment(a, b).alias("alignment"))


def directed_relations(boxes: DataFrame, row: float = 30, col: float = 50) -> DataFrame:
    """left_of / right_of for boxes of one height, above / below for boxes of one column; both directions."""
    s = _sides(boxes).select(*PAGE, "entity_seq", "cx2", "cy2")
    other = F.col("a_entity_seq") != F.col("b_entity_seq")
    dy, dx = F.abs(F.col("a_cy2") - F.col("b_cy2")), F.abs(F.col("a_cx2") - F.col("b_cx2"))
    side = near_pairs(s, s, PAGE, {"cy2": 2 * row}, other & (dy < 2 * row)).withColumn(
        "relation", F.when(F.col("a_cx2") < F.col("b_cx2"), "left_of").otherwise("right_of"))
    stack = near_pairs(s, s, PAGE, {"cx2": 2 * col}, other & (dx < 2 * col) & (dy >= 2 * row)).withColumn(
        "relation", F.when(F.col("a_cy2") < F.col("b_cy2"), "above").otherwise("below"))
    return side.unionByName(stack).select(
        *PAGE, F.col("a_entity_seq").alias("source"), F.col("b_entity_seq").alias("target"), "relation", F.lit(0.9).alias("confidence"))


def spatial_context(boxes: DataFrame, reach: float = 200) -> DataFrame:
    """Distance, direction, alignment and overlaps from each box to each box within ``reach``."""
    a, b = Box.of("a_"), Box.of("b_")
    level = (F.abs(a.y - b.y) < 10) | (F.abs(a.x - b.x) < 10)
    return close_pairs(boxes, reach, ordered=True).select(
        *PAGE, F.col("a_entity_seq").alias("source"), F.col("b_entity_seq").alias("target"), B.distance(a, b).alias("distance"),
        B.direction(b.cy - a.cy, b.cx - a.cx).alias("direction"), F.when(level, "aligned").otherwise("offset").alias("alignment"),
        B.overlap_x(a, b).alias("overlap_x"), B.overlap_y(a, b).alias("overlap_y"))


# Endings of labels that name a key.
KEY_ENDINGS = ["number", "date", "name", "address", "code", "id", "total", "amount"]


def key_value_pairs(boxes: DataFrame, row: float = 20, reach: float = 200) -> DataFrame:
    """A key box and the nearest box that starts right of it in its row, less than ``reach`` px away."""
    s = _sides(boxes)
    keys = s.filter(F.lower("label").rlike("(" + "|".join(KEY_ENDINGS) + ")$")).select(
        *PAGE, "entity_seq", "label", "cy2", (F.col("x") + F.col("width")).alias("edge"))
    values = s.select(*PAGE, "entity_seq", "cy2", F.col("x").alias("edge"))
    gap = F.col("b_edge") - F.col("a_edge")
    hit = (gap > 0) & (gap < reach) & (F.abs(F.col("a_cy2") - F.col("b_cy2")) < 2 * row) & (F.col("a_entity_seq") != F.col("b_entity_seq"))
    pairs = near_pairs(keys, values, PAGE, {"cy2": 2 * row, "edge": reach}, hit)
    return pairs.groupBy(*PAGE, "a_entity_seq", "a_label").agg(F.min(F.struct(gap.alias("gap"), F.col("b_entity_seq").alias("seq"))).alias("v")).select(
        *PAGE, F.col("a_entity_seq").alias("source"), F.col("v.seq").alias("target"), F.col("a_label").alias("label"),
        F.col("v.gap").alias("gap"), F.lit("key_value").alias("relation"), F.lit(0.8).alias("confidence"))


def label_value(boxes: DataFrame, row: float = 30) -> DataFrame:
    """A text with a colon and the boxes right of it at its height."""
    s = _sides(boxes).select(*PAGE, "entity_seq", "text", "cx2", "cy2")
    hit = (F.col("a_entity_seq") != F.col("b_entity_seq")) & (F.abs(F.col("a_cy2") - F.col("b_cy2")) < 2 * row) & (F.col("a_cx2") < F.col("b_cx2"))
    return near_pairs(s.filter(F.col("text").contains(":")), s.drop("text"), PAGE, {"cy2": 2 * row}, hit).select(
        *PAGE, F.col("a_entity_seq").alias("source"), F.col("b_entity_seq").alias("target"), F.lit("label_value").alias("relation"),
        F.lit(0.8).alias("confidence"))


# Labels that detail an item.
DETAIL_LABELS = ["Part number", "Quantity", "Unit price"]


def item_detail(boxes: DataFrame, row: float = 50) -> DataFrame:
    """An item number and its part number, quantity and price less than ``row`` px away in height."""
    s = _sides(boxes).select(*PAGE, "entity_seq", "label", "cy2")
    hit = F.abs(F.col("a_cy2") - F.col("b_cy2")) < 2 * row
    return near_pairs(s.filter("label = 'Item number'"), s.filter(F.col("label").isin(DETAIL_LABELS)), PAGE, {"cy2": 2 * row}, hit).select(
        *PAGE, F.col("a_entity_seq").alias("source"), F.col("b_entity_seq").alias("target"), F.lit("item_detail").alias("relation"),
        F.lit(0.8).alias("confidence"))


def header_item(boxes: DataFrame, threshold: float = 50) -> DataFrame:
    """The top box of a column and the other boxes of the column."""
    cols = band_groups(boxes, axis="x", threshold=threshold, name="col_no").select(*PAGE, "col_no", "entity_seq", "x", "y")
    head = cols.groupBy(*PAGE, "col_no").agg(F.min(F.struct("y", "x", "entity_seq")).alias("h"))
    return cols.join(head, [*PAGE, "col_no"]).filter(F.col("h.entity_seq") != F.col("entity_seq")).select(
        *PAGE, F.col("h.entity_seq").alias("source"), F.col("entity_seq").alias("target"), F.lit("header_item").alias("relation"),
        F.lit(0.7).alias("confidence"))


def group_member(boxes: DataFrame, threshold: float = 20) -> DataFrame:
    """The item number of a row and the other boxes of the row."""
    rows = band_groups(boxes, threshold=threshold).select(*PAGE, "row_no", "entity_seq", "label", "x", "y")
    leads = rows.filter(F.lower("label").contains("item") & F.lower("label").contains("number"))
    lead = leads.groupBy(*PAGE, "row_no").agg(F.min(F.struct("x", "y", "entity_seq")).alias("h"))
    return rows.join(lead, [*PAGE, "row_no"]).filter(F.col("h.entity_seq") != F.col("entity_seq")).select(
        *PAGE, F.col("h.entity_seq").alias("source"), F.col("entity_seq").alias("target"), F.lit("group_member").alias("relation"),
        F.lit(0.75).alias("confidence"))


def covering_pairs(left: DataFrame, right: DataFrame, inclusive: bool = False, keys: Sequence[str] = PAGE, cell: int = 256) -> DataFrame:
    """Overlapping pairs of ``left`` (``a_*``) and ``right`` (``b_*``): both register in the cells they cover and meet in
    the cell of the top left corner of their overlap only."""
    def spread(df: DataFrame, p: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(c if c in keys else p + c) for c in df.columns])
        b = Box.of(p)
        return out.withColumn("_gx", F.explode(F.sequence(F.floor(b.x / cell), F.floor(b.right / cell)))).withColumn(
            "_gy", F.explode(F.sequence(F.floor(b.y / cell), F.floor(b.bottom / cell))))

    a, b = Box.of("a_"), Box.of("b_")
    meet = (F.floor(F.greatest(a.x, b.x) / cell) == F.col("_gx")) & (F.floor(F.greatest(a.y, b.y) / cell) == F.col("_gy"))
    test = B.touches(a, b) if inclusive else B.overlaps(a, b)
    return spread(left, "a_").join(spread(right, "b_"), [*keys, "_gx", "_gy"]).filter(meet & test).drop("_gx", "_gy")


def overlap_pairs(boxes: DataFrame, inclusive: bool = False) -> DataFrame:
    s = boxes.select(*PAGE, "entity_seq", "x", "y", "width", "height")
    got = covering_pairs(s, s, inclusive).filter("a_entity_seq < b_entity_seq")
    return got.select(*PAGE, F.col("a_entity_seq").alias("source"), F.col("b_entity_seq").alias("target"), B.intersection(Box.of("a_"), Box.of("b_")).alias("area"))


def overlap_penalty(boxes: DataFrame) -> DataFrame:
    """Overlapping (or touching) pairs over all pairs of a page."""
    hits = overlap_pairs(boxes, inclusive=True).groupBy(*PAGE).agg(F.count("*").alias("hits"))
    n = F.col("n")
    return boxes.groupBy(*PAGE).agg(F.count("*").alias("n")).join(hits, PAGE, "left").select(
        *PAGE, F.when(n < 2, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / (n * (n - 1) / 2)).alias("penalty"))


def band_counts(boxes: DataFrame, pos: Column, reach: int, name: str) -> DataFrame:
    """Boxes of the page whose whole-number position differs by less than ``reach`` (the box itself counts).

    The distinct positions of a page are counted first (at most two per pixel), the frame runs over those.
    """
    placed = boxes.withColumn("_p", pos.cast("long"))
    w = W.partitionBy(*PAGE).orderBy("_p").rangeBetween(-(reach - 1), reach - 1)
    total = placed.groupBy(*PAGE, "_p").agg(F.count("*").alias("_n")).select(*PAGE, "_p", F.sum("_n").over(w).alias(name))
    return placed.join(total, [*PAGE, "_p"]).drop("_p")


def near_entities(boxes: DataFrame, reach: float = 100, row: int = 30) -> DataFrame:
    """Neighbours closer than ``reach`` and boxes of the same height (the box itself counts for the height)."""
    near = close_pairs(boxes, reach, ordered=True, strict=True).groupBy(*PAGE, F.col("a_entity_seq").alias("entity_seq")).agg(F.count("*").alias("near_count"))
    return band_counts(boxes, Box.of().cy2, 2 * row, "same_row_count").join(near, [*PAGE, "entity_seq"], "left").withColumn(
        "near_count", F.coalesce("near_count", F.lit(0)))


RELATED = ["same_row_count", "same_col_count", "is_leftmost", "is_rightmost", "is_topmost", "is_bottommost", "min_distance", "avg_distance", "within_100", "within_200",
           "left_distance", "has_left", "right_distance", "has_right"]


def relational_features(boxes: DataFrame, row: float = 20, col: float = 50, width: int = PAGE_WIDTH, most: int = SPOTS) -> DataFrame:
    """Position of each box among the others of its page: counts, edges of row and column, distances, side gaps."""
    return with_relations(boxes.select(*PAGE, "entity_seq", "x", "y", "width", "height"), row, col, width, most).select(*PAGE, "entity_seq", *RELATED)


def with_relations(boxes: DataFrame, row: float = 20, col: float = 50, width: int = PAGE_WIDTH, most: int = SPOTS) -> DataFrame:
    """Boxes beside their relational features. A page of at most ``most`` boxes is one matrix, a crowded one is met in blocks."""
    large = crowded(boxes.select(*PAGE, F.lit(1).alias("_n")), PAGE, "_n", most)
    if large is None:
        return _related_in_place(boxes, row, col, width)
    crowd = boxes.join(large, PAGE, "left_semi")
    far = crowd.join(_related_in_blocks(crowd, row, col, width), [*PAGE, "entity_seq"]).select(*boxes.columns, *RELATED)
    return _related_in_place(boxes.join(large, PAGE, "left_anti"), row, col, width).unionByName(far)


def _related_in_place(boxes: DataFrame, row: float, col: float, width: int) -> DataFrame:
    def figures(pages):
        import numpy as np
        import pyarrow as pa

        plain = lambda name: pages.field(name).to_numpy(zero_copy_only=False)
        x, cx, cy = plain("x"), plain("cx").astype(float), plain("cy").astype(float)
        right = x + plain("width")
        n = len(x)
        out = {name: np.zeros(n, dtype=np.int64) for name in ("same_row_count", "same_col_count", "within_100", "within_200")}
        out |= {name: np.zeros(n, dtype=bool) for name in ("is_leftmost", "is_rightmost", "is_topmost", "is_bottommost", "has_left", "has_right")}
        out |= {name: np.full(n, np.nan) for name in ("min_distance", "avg_distance")}
        unknown = {name: np.zeros(n, dtype=bool) for name in ("is_leftmost", "is_rightmost", "is_topmost", "is_bottommost")}
        lacking = bool(np.isnan(cx).any() or np.isnan(cy).any())
        gaps = {name: np.zeros(n, dtype=x.dtype) for name in ("left_gap", "right_gap")}
        for at, step, column, size in pages.together():
            shape = (size[0], len(size))

            def matrix(values, none):
                got = np.full(shape, none, dtype=values.dtype)
                got[step, column] = values[at]
                return got

            # A place without a box has no position: it is near nothing, and nothing is near it.
            mx, my, left_edge, right_edge = matrix(cx, np.nan), matrix(cy, np.nan), matrix(x, 0), matrix(right, 0)
            count = lambda: np.zeros(shape, dtype=np.int64)
            yes = lambda: np.ones(shape, dtype=bool)
            rows, cols, n1, n2, lm, rm, tm, bm = count(), count(), count(), count(), yes(), yes(), yes(), yes()
            least, total, lg, rg = np.full(shape, np.inf), np.zeros(shape), np.full(shape, np.inf), np.full(shape, np.inf)
            row_open, col_open = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)  # others that lack a position
            ld, rd = np.zeros(shape, dtype=x.dtype), np.zeros(shape, dtype=x.dtype)
            for i in range(size[0]):  # the i-th box of each page as the other one, in order, so sums do not depend on how rows arrive
                m = int(np.searchsorted(-size, -i, side="left"))  # pages that have it
                dx, dy = mx[i, :m] - mx[:, :m], my[i, :m] - my[:, :m]
                dx[i] = np.nan  # a box is none of its others
                dist = np.sqrt(dx * dx + dy * dy)
                dist[i] = np.nan
                in_row, in_col = np.abs(dy) < row, np.abs(dx) < col
                in_row[i] = False
                rows[:, :m] += in_row
                cols[:, :m] += in_col
                n1[:, :m] += dist < 100
                n2[:, :m] += dist < 200
                lm[:, :m] &= ~(in_row & (dx <= 0))
                rm[:, :m] &= ~(in_row & (dx >= 0))
                tm[:, :m] &= ~(in_col & (dy <= 0))
                bm[:, :m] &= ~(in_col & (dy >= 0))
                if lacking:
                    row_open[:, :m] |= in_row & np.isnan(dx)
                    col_open[:, :m] |= in_col & np.isnan(dy)
                least[:, :m] = np.fmin(least[:, :m], dist)
                dist[i] = 0.0
                total[:, :m] += dist
                nearer = in_row & (dx < 0) & (-dx < lg[:, :m])
                lg[:, :m] = np.where(nearer, -dx, lg[:, :m])
                ld[:, :m] = np.where(nearer, left_edge[:, :m] - right_edge[i, :m], ld[:, :m])
                nearer = in_row & (dx > 0) & (dx < rg[:, :m])
                rg[:, :m] = np.where(nearer, dx, rg[:, :m])
                rd[:, :m] = np.where(nearer, left_edge[i, :m] - right_edge[:, :m], rd[:, :m])
            for name, values in (("same_row_count", rows), ("same_col_count", cols), ("within_100", n1), ("within_200", n2), ("is_leftmost", lm), ("is_rightmost", rm),
                                 ("is_topmost", tm), ("is_bottommost", bm), ("has_left", lg < np.inf), ("has_right", rg < np.inf)):
                out[name][at] = values[step, column]
            for names, values in ((("is_leftmost", "is_rightmost"), row_open), (("is_topmost", "is_bottommost"), col_open)):
                for name in names:
                    unknown[name][at] = values[step, column] & out[name][at]
            out["min_distance"][at] = np.where(np.isinf(least), np.nan, least)[step, column]
            out["avg_distance"][at] = np.divide(total, size - 1, out=np.full(shape, np.nan), where=np.broadcast_to(size > 1, shape))[step, column]
            gaps["left_gap"][at], gaps["right_gap"][at] = ld[step, column], rd[step, column]
        cols = [pa.array(v, mask=np.isnan(v)) if v.dtype == float else pa.array(v, mask=unknown.get(name)) for name, v in out.items()]
        cols += [pa.array(v.astype(whole)) for v in gaps.values()]
        return pa.StructArray.from_arrays(cols, names=[*out, *gaps])

    b = Box.of()
    gap = boxes.select((F.col("x") - F.col("x") - F.col("width")).alias("g")).schema["g"].dataType.simpleString()
    plain = "bigint" if gap in ("tinyint", "smallint", "int", "bigint") else "double"
    whole = "int64" if plain == "bigint" else "float64"
    sent = ["entity_seq", F.coalesce(F.col("x").cast(plain), F.lit(0).cast(plain)).alias("x"), F.coalesce(F.col("width").cast(plain), F.lit(0).cast(plain)).alias("width"),
            b.cx.cast("double").alias("cx"), b.cy.cast("double").alias("cy")]
    kind = "struct<same_row_count:bigint,same_col_count:bigint,within_100:bigint,within_200:bigint,is_leftmost:boolean,is_rightmost:boolean,is_topmost:boolean,is_bottommost:boolean,has_left:boolean,"
    kind += f"has_right:boolean,min_distance:double,avg_distance:double,left_gap:{plain},right_gap:{plain}>"
    met = over_pages(boxes, sent, figures, kind, "_f")
    side = {"left_distance": F.when(F.col("_f.has_left"), F.col("_f.left_gap").cast(gap)).otherwise(F.col("x")),
            "right_distance": F.when(F.col("_f.has_right"), F.col("_f.right_gap").cast(gap)).otherwise(width - F.col("x") - F.col("width"))}
    return met.select(*boxes.columns, *[side.get(name, F.col(f"_f.{name}")).alias(name) for name in RELATED])


def _related_in_blocks(boxes: DataFrame, row: float, col: float, width: int) -> DataFrame:
    b = Box.of()
    s = boxes.select(*PAGE, "entity_seq", "x", "width", b.cx.alias("cx"), b.cy.alias("cy"))
    met = block_join(s, ["entity_seq", "x", "width", "cx", "cy"])
    cx, cy = F.col("cx"), F.col("cy")
    # Blocks are sorted by entity_seq, so float sums do not depend on the order rows arrive in.
    met = met.withColumn("others", F.filter("others", lambda o: o["entity_seq"] != F.col("entity_seq")))
    met = met.withColumn("dist", F.transform("others", lambda o: F.sqrt(F.pow(o["cx"] - cx, F.lit(2)) + F.pow(o["cy"] - cy, F.lit(2)))))
    met = met.withColumn("in_row", F.filter("others", lambda o: F.abs(o["cy"] - cy) < row))
    met = met.withColumn("in_col", F.filter("others", lambda o: F.abs(o["cx"] - cx) < col))
    left = F.array_min(F.transform(F.filter("in_row", lambda o: o["cx"] < cx), lambda o: F.struct((cx - o["cx"]).alias("g"), o["entity_seq"].alias("s"), (F.col("x") - o["x"] - o["width"]).alias("d"))))
    right = F.array_min(F.transform(F.filter("in_row", lambda o: o["cx"] > cx), lambda o: F.struct((o["cx"] - cx).alias("g"), o["entity_seq"].alias("s"), (o["x"] - F.col("x") - F.col("width")).alias("d"))))
    part = met.select(
        *PAGE, "entity_seq", "x", "width", F.size("in_row").alias("rc"), F.size("in_col").alias("cc"),
        F.forall("in_row", lambda o: cx < o["cx"]).alias("lm"), F.forall("in_row", lambda o: cx > o["cx"]).alias("rm"),
        F.forall("in_col", lambda o: cy < o["cy"]).alias("tm"), F.forall("in_col", lambda o: cy > o["cy"]).alias("bm"),
        F.array_min("dist").alias("md"), F.aggregate("dist", F.lit(0.0), lambda a, v: a + v).alias("sd"), F.size("dist").alias("nd"),
        F.size(F.filter("dist", lambda v: v < 100)).alias("n1"), F.size(F.filter("dist", lambda v: v < 200)).alias("n2"), left.alias("lf"), right.alias("rt"))
    return part.groupBy(*PAGE, "entity_seq", "x", "width").agg(
        F.sum("rc").alias("same_row_count"), F.sum("cc").alias("same_col_count"), F.bool_and("lm").alias("is_leftmost"),
        F.bool_and("rm").alias("is_rightmost"), F.bool_and("tm").alias("is_topmost"), F.bool_and("bm").alias("is_bottommost"),
        F.min("md").alias("min_distance"), (F.sum("sd") / F.nullif(F.sum("nd"), F.lit(0))).alias("avg_distance"),
        F.sum("n1").alias("within_100"), F.sum("n2").alias("within_200"), F.min("lf").alias("lf"), F.min("rt").alias("rt"),
    ).select(
        *PAGE, "entity_seq", "same_row_count", "same_col_count", "is_leftmost", "is_rightmost", "is_topmost", "is_bottommost",
        "min_distance", "avg_distance", "within_100", "within_200",
        F.coalesce("lf.d", "x").alias("left_distance"), F.col("lf").isNotNull().alias("has_left"),
        F.coalesce("rt.d", width - F.col("x") - F.col("width")).alias("right_distance"), F.col("rt").isNotNull().alias("has_right"))


def entity_relation_features(boxes: DataFrame, reach: float = 200) -> DataFrame:
    """Relations of each box by type, as source or target: count, nearest, best alignment; centrality is the share of the
    other boxes of the page it is related to."""
    rel = spatial_relations(boxes, reach)
    ends = rel.select(*PAGE, F.explode(F.array("source", "target")).alias("entity_seq"), "relation", "distance", "alignment")
    per = ends.groupBy(*PAGE, "entity_seq").agg(
        F.count("*").alias("relations"), F.min("distance").alias("nearest"), F.max("alignment").alias("best_alignment"),
        F.count_if(F.col("relation").startswith("same_row")).alias("row_relations"),
        F.count_if(F.col("relation").startswith("same_column")).alias("column_relations"))
    sizes = boxes.groupBy(*PAGE).agg(F.count("*").alias("n"))
    n = F.coalesce("relations", F.lit(0))
    return boxes.select(*PAGE, "entity_seq").join(per, [*PAGE, "entity_seq"], "left").join(sizes, PAGE).select(
        *PAGE, "entity_seq", n.alias("relations"), F.coalesce("row_relations", F.lit(0)).alias("row_relations"),
        F.coalesce("column_relations", F.lit(0)).alias("column_relations"), "nearest", "best_alignment",
        F.when(F.col("n") > 1, n / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def row_neighbours(boxes: DataFrame, threshold: float = 20) -> DataFrame:
    """Left and right neighbour of each box in its anchor row, by x."""
    rows = band_groups(boxes, threshold=threshold).select(*PAGE, "row_no", "entity_seq", "x")
    key = [*PAGE, "row_no"]
    if usual_pages(boxes):
        w = W.partitionBy(*key).orderBy("x", "entity_seq")
        return rows.select(*key, "entity_seq", F.lag("entity_seq").over(w).alias("left_seq"), F.lead("entity_seq").over(w).alias("right_seq"))
    # Rank inside the row (split by x), then meet the boxes one rank away.
    placed = ranked(rows, key, ["x", "entity_seq"], [F.col("x")])
    left = placed.select(*key, (F.col("rn") + 1).alias("rn"), F.col("entity_seq").alias("left_seq"))
    right = placed.select(*key, (F.col("rn") - 1).alias("rn"), F.col("entity_seq").alias("right_seq"))
    return placed.join(left, [*key, "rn"], "left").join(right, [*key, "rn"], "left").select(*key, "entity_seq", "left_seq", "right_seq")
