"""Bounding-box columns: geometry, overlap, validity, position classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..schema import PAGE_HEIGHT, PAGE_WIDTH

# Limits of a valid box.
MIN_SIDE = 10
MIN_ASPECT = 0.05
MAX_ASPECT = 20.0


@dataclass(frozen=True)
class Box:
    """Four columns of one box."""

    x: Column
    y: Column
    width: Column
    height: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*[F.col(prefix + c) for c in ("x", "y", "width", "height")])

    @property
    def right(self) -> Column:
        return self.x + self.width

    @property
    def bottom(self) -> Column:
        return self.y + self.height

    @property
    def cx(self) -> Column:
        return self.x + self.width / 2

    @property
    def cy(self) -> Column:
        return self.y + self.height / 2

    @property
    def cx2(self) -> Column:
        """Twice the x center: stays an integer."""
        return self.x * 2 + self.width

    @property
    def cy2(self) -> Column:
        return self.y * 2 + self.height

    @property
    def area(self) -> Column:
        return self.width * self.height


def int_center(b: Box) -> tuple[Column, Column]:
    return b.x + F.floor(b.width / 2), b.y + F.floor(b.height / 2)


def perimeter(b: Box) -> Column:
    return (b.width + b.height) * 2


def aspect(b: Box) -> Column:
    return b.width / F.greatest(b.height, F.lit(1))


def corners(b: Box) -> Column:
    """Four corner points, clockwise from top left."""
    def point(px: Column, py: Column) -> Column:
        return F.struct(px.alias("px"), py.alias("py"))

    return F.array(point(b.x, b.y), point(b.right, b.y), point(b.right, b.bottom), point(b.x, b.bottom))


def contains(b: Box, px: Column, py: Column) -> Column:
    return px.between(b.x, b.right) & py.between(b.y, b.bottom)


def touches(a: Box, b: Box) -> Column:
    """Overlap test with inclusive edges."""
    return (a.right >= b.x) & (b.right >= a.x) & (a.bottom >= b.y) & (b.bottom >= a.y)


def overlaps(a: Box, b: Box) -> Column:
    """Overlap test with strict edges."""
    return (a.x < b.right) & (a.right > b.x) & (a.y < b.bottom) & (a.bottom > b.y)


def overlap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0), F.least(a.right, b.right) - F.greatest(a.x, b.x))


def overlap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def intersection(a: Box, b: Box) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def union(a: Box, b: Box) -> Column:
    return a.area + b.area - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    return intersection(a, b) / F.greatest(union(a, b), F.lit(1))


def scaled(b: Box, sx: float, sy: float) -> Box:
    return Box(*[(c * s).cast("long") for c, s in ((b.x, sx), (b.y, sy), (b.width, sx), (b.height, sy))])


def to_1000(b: Box, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT) -> Box:
    """Integer 0..1000 space; truncates."""
    return Box(*[(c / s * 1000).cast("long") for c, s in ((b.x, width), (b.y, height), (b.width, width), (b.height, height))])


def errors(b: Box) -> Column:
    """Names of the violated box rules."""
    ratio = b.width / F.nullif(b.height, F.lit(0))
    return F.array_compact(F.array(
        F.when(b.width < MIN_SIDE, "width_too_small"),
        F.when(b.height < MIN_SIDE, "height_too_small"),
        F.when((b.x < 0) | (b.y < 0), "negative_position"),
        F.when((ratio > MAX_ASPECT) | (ratio < MIN_ASPECT), "aspect_out_of_range"),
    ))


def distance(a: Box, b: Box) -> Column:
    return F.sqrt(F.pow(b.cx - a.cx, F.lit(2)) + F.pow(b.cy - a.cy, F.lit(2)))


def quadrant(b: Box, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT) -> Column:
    """1 top left, 2 top right, 3 bottom left, 4 bottom right."""
    return F.when(b.cx < width / 2, 1).otherwise(2) + F.when(b.cy < height / 2, 0).otherwise(2)


def region(pos: Column, height: int = PAGE_HEIGHT, top: float = 0.15, bottom: float = 0.85) -> Column:
    return F.when(pos < height * top, "header").when(pos > height * bottom, "footer").otherwise("body")


def vertical_zone(b: Box, height: int = PAGE_HEIGHT) -> Column:
    return F.when(b.y / height < 0.2, "header").when(b.y / height > 0.8, "footer").otherwise("body")


def horizontal_zone(b: Box, width: int = PAGE_WIDTH) -> Column:
    return F.when(b.x / width < 0.33, "left").when(b.x / width > 0.67, "right").otherwise("center")


def relation(a: Box, b: Box, row: float = 20, col: float = 50) -> Column:
    """Relation of ``a`` to ``b`` by their centers."""
    left, above = a.cx2 < b.cx2, a.cy2 < b.cy2
    return (
        F.when(F.abs(a.cy2 - b.cy2) < 2 * row, F.when(left, "same_row_left").otherwise("same_row_right"))
        .when(F.abs(a.cx2 - b.cx2) < 2 * col, F.when(above, "same_column_above").otherwise("same_column_below"))
        .when(left & above, "diagonal_top_left")
        .when((a.cx2 > b.cx2) & above, "diagonal_top_right")
        .when(left & (a.cy2 > b.cy2), "diagonal_bottom_left")
        .otherwise("diagonal_bottom_right")
    )


def alignment(a: Box, b: Box) -> Column:
    """1 for a shared edge, falling to 0 at 100 px: the best of the four edges."""
    gap = F.least(
        F.abs(a.y - b.y), F.abs(a.bottom - b.bottom), F.abs(a.x - b.x), F.abs(a.right - b.right), F.lit(100).cast("long")
    )
    return 1 - gap / 100


# Direction names, clockwise from "right" in 45 degree steps (y grows downwards).
DIRECTIONS = ["right", "bottom-right", "bottom", "bottom-left", "left", "top-left", "top", "top-right"]


def direction(dy: Column, dx: Column) -> Column:
    """Eight directions; the step index is truncated toward zero before the modulo."""
    step = F.pmod(((F.atan2(dy, dx) * 180 / F.lit(3.141592653589793) + 22.5) / 45).cast("int"), F.lit(8))
    return F.element_at(F.array(*[F.lit(d) for d in DIRECTIONS]), step + 1)
