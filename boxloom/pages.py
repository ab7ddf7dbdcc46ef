"""Ordinary pages as arrays: Arrow functions that see the rows of many whole pages at once.

A page travels as one array, so this is for pages of at most ``SPOTS`` boxes (see ``crowded``). Pages of like length lie side
by side in one matrix, a column each, and take their steps together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scale import PAGE

CELLS = 1 << 20  # places of a matrix of pages


def over_pages(boxes: DataFrame, sent: Sequence[str | Column], find: Callable, kind: str, name: str) -> DataFrame:
    """Every row beside what ``find`` gives it, as column ``name`` of type ``kind``.

    ``find`` gets ``Pages`` (the rows as structs of ``sent``, the first one their order) and returns an Arrow array of all
    rows. The rows themselves stay in the JVM.
    """
    view = page_view()
    rest = [c for c in boxes.columns if c not in PAGE]
    pages = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct(*rest)).alias("_rows"), F.collect_list(F.struct(*sent)).alias("_sent"))

    def told(lists):
        seen = view(lists)
        return seen.lists(find(seen))

    found = pages.withColumn("_told", F.arrow_udf(told, f"array<{kind}>")("_sent"))
    row = F.zip_with("_rows", "_told", lambda r, v: F.struct(*[r[c].alias(c) for c in rest], v.alias(name)))
    return found.select(*PAGE, F.inline(row)).select(*boxes.columns, name)


def page_view() -> type:
    """The class is made here, so that it travels to workers that don't have this package."""
    cells = CELLS

    class Pages:
        """The rows of an Arrow list array in the order of their pages and of their first field."""

        def __init__(self, lists):
            import numpy as np

            ends = lists.offsets.to_numpy()
            self.ends, self.start, self.count = ends - ends[0], ends[:-1] - ends[0], np.diff(ends)
            self.rows = lists.flatten()
            self.page = np.repeat(np.arange(len(self.count)), self.count)
            self.order = np.lexsort((self.rows.field(0).to_numpy(zero_copy_only=False), self.page))
            self.place = np.arange(len(self.page)) - self.start[self.page]

        def field(self, name):
            """A field as an Arrow array, in order."""
            import pyarrow as pa

            return self.rows.field(name).take(pa.array(self.order))

        def together(self, width=1):
            """Pages of like length, the longest first: (their boxes, step and column of each box, boxes of each page).

            ``width``: numbers of a place of the matrix.
            """
            import numpy as np

            long = np.argsort(-self.count, kind="stable")
            while len(long) and self.count[long[0]]:
                most = max(cells // (int(self.count[long[0]]) * width), 1)
                some, long = long[:most], long[most:]
                size = self.count[some]
                column = np.repeat(np.arange(len(some)), size)
                step = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size)
                yield np.repeat(self.start[some], size) + step, step, column, size

        def lists(self, values):
            """An Arrow array of all rows as lists, in the order they came in."""
            import numpy as np
            import pyarrow as pa

            back = np.empty(len(self.order), dtype=np.int64)
            back[self.order] = np.arange(len(self.order))
            return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), values.take(pa.array(back)))

    return Pages
