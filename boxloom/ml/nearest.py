"""Exact k nearest neighbours of the same class, as a metric range join.

Equal vectors are one: they are counted and named by their smallest ids, so a vector that fills a third of the table is
compared once. Pivots (the smallest hashes, one for every ``BLOCK`` vectors and at most ``PIVOTS``) cut each class into
cells. A vector first meets its own cell; the k-th distance found there is its radius. It then visits only the cells whose
lower bound is within the radius: by the triangle inequality (distance to the other pivot less that cell's largest member
distance) and by the plane half way between the pivots. Vectors meet in blocks of about ``BLOCK``, keyed by both block
numbers, so a full cell is many tasks. Visitors are sent in pieces of ``PIECE`` at most, and a task holds one Arrow batch and
one matrix of distances, so its memory doesn't grow with the cells or the vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scale import cut, topk

BLOCK = 512
PIECE = 2048  # vectors that visit a block together, at most
PIVOTS = 1024
SLACK = 1e-6  # rounding room of the matrix distances; what is inside it is measured again by differences
MEMBER = "head: bigint, embedding: array<double>, cell: int, far: double"


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """label, embedding, ids (the k + 1 smallest), head (the smallest). Null vectors have no neighbours and are left out."""
    rows = vectors.filter("embedding IS NOT NULL").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    few = topk(rows, ["label", "embedding"], ["vec_id"], k + 1, "_i")
    return few.groupBy("label", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("head", F.col("ids")[0])


def placed(classes: DataFrame, pivots: int) -> tuple[DataFrame, dict]:
    """Each vector with its nearest pivot (``cell``, -1 where the class has none), the distance to it and a block number;
    and per class its pivots with size and radius of their cells (at most ``pivots`` rows)."""
    import numpy as np

    chosen = classes.select("label", "head", "embedding").orderBy(F.xxhash64("label", "head"), "label", "head").limit(pivots).collect()
    by_class: dict = {}
    for r in chosen:
        by_class.setdefault(r.label, []).append(r.embedding)
    points = {label: np.array(rows, dtype=float) for label, rows in by_class.items()}
    schema = f"label {classes.schema['label'].dataType.simpleString()}, ids array<bigint>, " + MEMBER.replace(":", "")

    def nearest_pivot(batches):
        import pandas as pd

        for batch in batches:
            for label, part in batch.groupby("label", dropna=False):
                rows = np.array(part["embedding"].tolist(), dtype=float)
                if label in points:
                    gap = distances(rows, points[label])
                    cell = gap.argmin(1)
                    far = np.sqrt(((rows - points[label][cell]) ** 2).sum(1))
                else:
                    cell, far = np.full(len(rows), -1), np.zeros(len(rows))
                yield pd.DataFrame({"label": part["label"], "ids": part["ids"], "head": part["head"], "embedding": part["embedding"], "cell": cell.astype("int32"), "far": far})

    members = cut(classes.select("label", "ids", "head", "embedding").mapInPandas(nearest_pivot, schema))
    sizes = members.groupBy("label", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells = {label: (p, np.zeros(len(p), dtype=int), np.zeros(len(p))) for label, p in points.items()}
    for r in sizes.filter("cell >= 0").collect():
        cells[r.label][1][r.cell], cells[r.label][2][r.cell] = blocks_of(r.n), r.radius
    numbered = members.join(sizes.select("label", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), ["label", "cell"])
    return numbered.withColumn("blk", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int")), cells


def blocks_of(n: int) -> int:
    return -(-n // BLOCK)


def distances(a, b):
    """Distances of all rows of ``a`` to all of ``b``."""
    import numpy as np

    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def matrix_of(vectors):
    """The vectors of an Arrow list column as one matrix."""
    import numpy as np

    ends = vectors.offsets.to_numpy()
    width = np.diff(ends)
    if len(width) and (width != width[0]).any():
        raise ValueError("vectors of one class differ in length")
    return vectors.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(len(width), -1)


def side_of(column, i: int):
    """Ids and matrix of the ``i``-th list of members."""
    a, b = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    rows = column.values.slice(a, b - a)
    return rows.field("head").to_numpy(), matrix_of(rows.field("embedding"))


def labels_of(column):
    """Row numbers of each label of an Arrow column."""
    import numpy as np

    coded = column.dictionary_encode()
    code = coded.indices.to_numpy()
    for n, label in enumerate(coded.dictionary.to_pylist()):
        yield np.flatnonzero(code == n), label


def blocked(members: DataFrame) -> DataFrame:
    row = F.struct("head", "embedding", "cell", "far")
    return members.groupBy("label", "cell", "blk", "blocks").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def home_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of one cell: label, left, right."""
    left = blocks.select("label", "cell", F.col("rows").alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    return left.join(blocks.select("label", "cell", "blk", F.col("rows").alias("right")), ["label", "cell", "blk"]).select("label", "left", "right")


def far_pairs(members: DataFrame, blocks: DataFrame, cells: dict, near: DataFrame, k: int) -> DataFrame:
    """Vectors beside the blocks of the other cells they may have a neighbour in: label, left, right."""
    radius = near.groupBy("label", "head").agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))
    known = members.filter("cell >= 0").join(radius, ["label", "head"], "left").select("label", "cell", "head", "embedding", "far", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    label_type = members.schema["label"].dataType.simpleString()

    def visits(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names = ["head", "embedding", "cell", "far"]
            member = pa.StructArray.from_arrays([batch.column(c) for c in names], names)
            own_cell, far, reach = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "far", "reach"))
            for index, label in labels_of(batch.column("label")):
                points, counts, radii = cells[label]
                between = distances(points, points)
                for at in range(0, len(index), PIECE):
                    piece = index[at:at + PIECE]
                    rows, own = matrix_of(batch.column("embedding").take(pa.array(piece))), own_cell[piece]
                    gap, apart = distances(rows, points), between[own]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(apart > 0, (gap ** 2 - far[piece][:, None] ** 2) / (2 * apart), 0.0)
                    room = SLACK * (1 + np.abs(gap))
                    meets = np.maximum(gap - radii[None, :], plane) <= reach[piece][:, None] + room
                    meets[np.arange(len(rows)), own] = False
                    meets[:, counts == 0] = False
                    for j in np.flatnonzero(meets.any(0)):
                        left = member.take(pa.array(piece[meets[:, j]]))
                        one = pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), left)
                        for b in range(counts[j]):
                            yield pa.RecordBatch.from_arrays(
                                [batch.column("label").take(pa.array(piece[:1])), pa.array([j], pa.int32()), pa.array([b], pa.int32()), one], ["label", "cell", "blk", "left"])

    sent = known.mapInArrow(visits, f"label {label_type}, cell int, blk int, left array<struct<{MEMBER}>>")
    return sent.join(blocks.select("label", "cell", "blk", F.col("rows").alias("right")), ["label", "cell", "blk"]).select("label", "left", "right")


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of ``right`` for each row of ``left``: label, head, other, distance."""

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            label, left, right = (batch.column(c) for c in ("label", "left", "right"))
            for i in range(batch.num_rows):
                (heads, a), (ids, b) = side_of(left, i), side_of(right, i)
                gap = distances(a, b)
                room = SLACK * (1 + np.sqrt(max((a * a).sum(1).max(), (b * b).sum(1).max())))
                gap[heads[:, None] == ids] = np.inf
                limit = np.partition(gap, k - 1, axis=1)[:, k - 1:k] if len(ids) > k else np.inf
                row, found = np.nonzero((gap <= limit + 2 * room) & np.isfinite(gap))
                exact = np.sqrt(((b[found] - a[row]) ** 2).sum(1))
                order = np.lexsort((ids[found], exact, row))
                row, found, exact = row[order], found[order], exact[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, found, exact = row[keep], found[keep], exact[keep]
                yield pa.RecordBatch.from_arrays(
                    [label.take(pa.array(np.full(len(row), i))), pa.array(heads[row]), pa.array(ids[found]), pa.array(exact)], ["label", "head", "other", "distance"])

    label_type = pairs.schema["label"].dataType.simpleString()
    return pairs.mapInArrow(nearest, f"label {label_type}, head bigint, other bigint, distance double")


def steps(vectors: DataFrame, k: int, pivots: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Distinct vectors in their cells, both tables of block pairs and what the first one gave."""
    if pivots is None:
        pivots = min(max(vectors.count() // BLOCK, 1), PIVOTS)
    members, cells = placed(distinct_vectors(vectors.filter("label IS NOT NULL"), k), pivots)
    blocks = blocked(members)
    home = home_pairs(blocks)
    near = cut(topk(best(home, k), ["label", "head"], ["distance", "other"], k, "nth").drop("nth"))
    return members, home, far_pairs(members, blocks, cells, near, k), near


def neighbour_lists(vectors: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """Exact k nearest of the same class as one list per vector: label, vec_id, near (distance, other); ties go to the smaller id.

    ``vectors``: label, vec_id, embedding. Rows without label or vector have no neighbours and no list; an id that repeats with
    the same vector counts once. A class of fewer than k + 1 vectors gives what it has.
    """
    members, _, far, near = steps(vectors, k, pivots)
    met = topk(near.unionByName(best(far, k)), ["label", "head"], ["distance", "other"], k, "nth").drop("nth")
    # Of a group of equal vectors k ids may be wanted: the nearest groups, each with its smallest ids, are put in order.
    ids = members.select("label", F.col("head").alias("other"), F.slice("ids", 1, k).alias("ids"))
    groups = met.join(ids, ["label", "other"]).select("label", "head", F.explode("ids").alias("other"), "distance")
    lists = topk(groups, ["label", "head"], ["distance", "other"], k, "nth").groupBy("label", "head").agg(F.collect_list(F.struct("distance", "other")).alias("out"))
    offers = members.join(lists, ["label", "head"], "left").select(
        "label", "embedding", F.concat(F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("distance"), i.alias("other"))),
                                       F.coalesce("out", F.array().cast("array<struct<distance:double,other:bigint>>"))).alias("offer"))
    rows = vectors.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    others = F.filter("offer", lambda o: o["other"] != F.col("vec_id"))
    return rows.join(offers, ["label", "embedding"]).select("label", "vec_id", F.slice(F.sort_array(others), 1, k).alias("near"))


def neighbours(vectors: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """``neighbour_lists`` as rows: label, vec_id, other, distance, nth."""
    rows = neighbour_lists(vectors, k, pivots).select("label", "vec_id", F.posexplode("near").alias("nth", "o"))
    return rows.select("label", "vec_id", "o.other", "o.distance", (F.col("nth") + 1).alias("nth"))
