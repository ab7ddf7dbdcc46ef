"""Augmentation of training items: variants with their parameters, box geometry under page transforms, made-up labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import beside

from ..functions.bbox import Box
from ..schema import PAGE_HEIGHT, PAGE_WIDTH

# Techniques and their parameters (15 variants).
VARIANTS = [("rotation", v) for v in (-5.0, -2.0, 2.0, 5.0)] + [("scaling", v) for v in (0.9, 1.0, 1.1)] + [("brightness", v) for v in (0.8, 1.0, 1.2)] + [
    ("contrast", v) for v in (0.8, 1.0, 1.2)] + [("noise", v) for v in (0.01, 0.02)]


def expand(items: DataFrame) -> DataFrame:
    """Each item with each variant (a fixed list, exploded in place)."""
    rows = F.array(*[F.struct(F.lit(t).alias("technique"), F.lit(v).alias("value")) for t, v in VARIANTS])
    return items.select("*", F.posexplode(rows).alias("variant", "p")).select(*items.columns, "variant", "p.*")


def copies(items: DataFrame, factor: int = 3) -> DataFrame:
    """Each item ``factor`` times with its index."""
    return items.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))


def _bounds(xs: list[Column], ys: list[Column]) -> Column:
    x0, y0 = F.least(*xs), F.least(*ys)
    return F.struct(F.round(x0, 4).alias("x"), F.round(y0, 4).alias("y"), F.round(F.greatest(*xs) - x0, 4).alias("width"), F.round(F.greatest(*ys) - y0, 4).alias("height"))


def affine(b: Box, m: tuple[float, float, float, float], dx: float = 0.0, dy: float = 0.0, cx: float = 0.0, cy: float = 0.0) -> Column:
    """Bounds of the box after x' = m0 x + m1 y, y' = m2 x + m3 y about (cx, cy), moved by (dx, dy)."""
    points = [(b.x, b.y), (b.right, b.y), (b.right, b.bottom), (b.x, b.bottom)]
    xs = [(px - cx) * m[0] + (py - cy) * m[1] + (cx + dx) for px, py in points]
    ys = [(px - cx) * m[2] + (py - cy) * m[3] + (cy + dy) for px, py in points]
    return _bounds(xs, ys)


def rotated(b: Box, degrees: float) -> Column:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return affine(b, (c, -s, s, c), cx=PAGE_WIDTH / 2, cy=PAGE_HEIGHT / 2)


def scaled(b: Box, factor: float) -> Column:
    return affine(b, (factor, 0.0, 0.0, factor))


def moved(b: Box, dx: float, dy: float) -> Column:
    return affine(b, (1.0, 0.0, 0.0, 1.0), dx, dy)


def sheared(b: Box, kx: float) -> Column:
    return affine(b, (1.0, kx, 0.0, 1.0))


def statistics(base: DataFrame, made: DataFrame, failed: str = "failed") -> DataFrame:
    """Originals, variants, errors and the ratio, per technique and in total."""
    n = base.agg(F.count("*").alias("originals"))
    per = made.groupingSets([["technique"], []], "technique").agg(F.count("*").alias("made"), F.count_if(failed).alias("errors"))
    return per.transform(beside, n).select(F.coalesce("technique", F.lit("all")).alias("technique"), "originals", "made", "errors", (F.col("made") / F.col("originals")).alias("ratio"))


# Sample values of made-up labels.
SAMPLES = {
    "order_number": ["4512221369", "4512221370", "4512221371"], "shipping_line": ["C5800002", "B7000123", "A1000456"], "case_mark": ["YMG KOFU P/C", "K5-1 EXT: 22", "LOC: 731-48"],
    "part_number": ["A1511JD-09", "B2044KC-01", "C9102AA-07", "A1612JD-09"], "date": ["10-22-2024", "11-05-2024", "12-31-2024"], "quantity": ["8.000 ST", "12.000 ST", "100.000 ST"], "price": ["1.7300", "20.5000", "3.9900"],
}


def made_up(keys: DataFrame, key: str) -> DataFrame:
    """Labels from a key alone: value (seed + i) modulo the list per field, total = quantity x price."""
    cols = []
    for i, (name, values) in enumerate(SAMPLES.items()):
        cols.append(F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key) + i, F.lit(len(values))) + 1).cast("int")).alias(name))
    out = keys.select(key, *cols)
    total = F.regexp_extract("quantity", r"^([0-9]+)", 1).cast("decimal(10,0)") * F.col("price").cast("decimal(10,4)")
    return out.withColumn("total", F.round(total, 2).cast("decimal(18,2)").cast("string"))
