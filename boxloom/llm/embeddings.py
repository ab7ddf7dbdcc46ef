"""Near duplicates of embeddings by an exact metric range join.

On the unit sphere a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Equal vectors are merged first. Every
vector goes to the cell of its nearest pivot, and visits each other cell that may hold a vector within r of it. Let p be
the pivot of its own cell and q another: by the triangle inequality only vectors with d(x, q) <= d(x, p) + 2r have
partners at home with q. In a Euclidean space the distance to the bisecting plane says the same more sharply:
(d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= r. So a vector meets all of its partners in its own cell, and cells join
independently. Crowded cells are dealt out as pairs of blocks of bounded size; blocks report counts and the links that
join their members into the same components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import cut
from .components import components

CELL = 4096  # distinct vectors per pivot, about
PIVOTS = 1024  # pivots over all labels at most: they are broadcast
BLOCK = 2048
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def pivots_of(classes: DataFrame, cell: int, most: int) -> dict[tuple, np.ndarray]:
    """Pivots per (label, dim): the classes with the smallest hashes, one for ``cell`` classes, ``most`` in all."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "dim").limit(most)
    whole = classes.count()
    share = F.ceil(F.least(F.col("n") / cell, F.col("n") * F.lit(most / 2) / max(whole, 1))).cast("int")
    wanted = F.broadcast(sizes.select("label", "dim", F.greatest(share, F.lit(1)).alias("k"), F.col("n").alias("size")))
    # A class is a candidate when its hash is among the lowest 4 k / n of the range, or the group is small.
    part = (F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) / F.lit(float(1 << 30))) <= F.lit(4.0) * (F.col("k") + 4) / F.col("size")
    ranked = classes.join(wanted, ["label", "dim"]).filter(part).withColumn("r", F.row_number().over(W.partitionBy("label", "dim").orderBy(F.xxhash64("cid"), "cid")))
    out: dict[tuple, list] = {}
    for x in ranked.filter("r <= k").select("label", "dim", "cid", "embedding").orderBy("label", "dim", "cid").collect():  # at most 2 * ``most`` rows
        out.setdefault((x.label, x.dim), []).append(x.embedding)
    return {key: unit(np.array(v, np.float64)) for key, v in out.items()}


def place(classes: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """``cell, home, cid, n, embedding`` for the home cell of every class and for the cells it visits."""
    known = classes.sparkSession.sparkContext.broadcast(pivots)
    base, numbers = 0, {}
    for key, rows in pivots.items():
        numbers[key], base = base, base + len(rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = {key: np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) for key, p in known.value.items()}
        for batch in batches:
            labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                take = batch.take(pa.array(at))
                p = known.value.get(key)
                if p is None:  # beyond the number of pivots: one cell for the group, named by it
                    cells, homes, index = [f"{key}"] * len(at), [True] * len(at), np.arange(len(at))
                else:
                    x = unit(rows_of(take.column(4), key[1]))
                    square = np.maximum(0, 2 - 2 * x @ p.T)
                    home = square.argmin(1)
                    own = square[np.arange(len(at)), home]
                    reach = square - own[:, None] <= 2 * (radius + SLACK) * gaps[key][home] + SLACK
                    reach[np.arange(len(at)), home] = True
                    index, cell = np.nonzero(reach)
                    cells, homes = [str(c) for c in (cell + numbers[key]).tolist()], (cell == home[index]).tolist()
                part = take.take(pa.array(index))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(homes), part.column(2), part.column(3), part.column(4)], ["cell", "home", "cid", "n", "embedding"])

    return classes.select("label", "dim", "cid", "n", "embedding").mapInArrow(deal, f"cell string, home boolean, cid long, n long, embedding {dict(classes.dtypes)['embedding']}")


def block_links(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` link; what is within rounding of the limit is summed up exactly."""
    dots = unit(x) @ unit(y).T
    out = dots >= cosine
    for i, j in np.argwhere(np.abs(dots - cosine) < 1e-12):
        a, b = x[i].tolist(), y[j].tolist()
        out[i, j] = fsum(p * q for p, q in zip(a, b, strict=True)) / (sqrt(fsum(p * p for p in a)) * sqrt(fsum(q * q for q in b))) >= cosine
    return out


def forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is joined to) for the members of one block pair."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(link, a[:, None], top).min(0, initial=top))
        new_a = np.minimum(a, np.where(link, new_b[None, :], top).min(1, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    node, root = np.concatenate([left, right]), np.concatenate([a, b])
    moved = node != root
    return node[moved], root[moved]


def embedding_dedup(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cell: int = CELL, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors with equal, not-null labels link when their cosine in double precision is at least ``cosine``. A vector that is
    null, empty, zero or holds null or non-finite parts, and one without an id or label, links with nothing, and so do
    vectors of different lengths. ``n_links`` counts other rows, repeated vectors included. An id that occurs with several
    vectors is several rows. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the join needs a cosine limit above 0 and at most 1")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite, F.lit(False))
    classes = cut(rows.filter(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()))
    placed = cut(place(classes, pivots_of(classes, cell, pivots), float(np.sqrt(2 - 2 * cosine))))

    # Blocks: members of a cell are numbered out by a hash; home blocks meet all blocks of the cell.
    sizes = placed.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("home"), 1)) / block)).cast("int").alias("homes"), F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("all"))
    met = cut(placed.join(cut(sizes), "cell").withColumn("h", F.xxhash64("cid")))
    left = met.filter("home").select("cell", F.pmod("h", "homes").cast("int").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("ob"), "cid", "n", "embedding")
    right = met.select("cell", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("hb"), F.pmod(F.xxhash64("h"), "all").cast("int").alias("ob"), "cid", "n", "embedding")

    def join(key, one: pa.Table, two: pa.Table) -> pa.Table:
        kinds = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        if not len(one) or not len(two):
            return kinds.empty_table()
        column = lambda t, c: t.column(c).combine_chunks()
        ids, others, weight = (column(t, c).to_numpy() for t, c in ((one, "cid"), (two, "cid"), (two, "n")))
        dim = len(column(one, "embedding")[0])
        link = block_links(rows_of(column(one, "embedding"), dim), rows_of(column(two, "embedding"), dim), cosine) & (ids[:, None] != others[None, :])
        count = link @ weight
        some, other = np.flatnonzero(count), np.flatnonzero(link.any(0))
        node, root = forest(link[np.ix_(some, other)], ids[some], others[other])
        return pa.Table.from_arrays([pa.array(np.concatenate([ids[some], node])), pa.array(np.concatenate([count[some], np.zeros(len(node), np.int64)])), pa.array(np.concatenate([ids[some], root]))], schema=kinds)

    found = cut(left.groupBy("cell", "hb", "ob").cogroup(right.groupBy("cell", "hb", "ob")).applyInArrow(join, "cid long, links long, root long"))
    labels = components(found.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    # Classes go by numbers of their own, since an id may occur with two vectors; a component is named by its smallest id.
    parts = cut(classes.select("cid", "least").join(labels.withColumnRenamed("node", "cid"), "cid").select("cid", F.col("component_id").alias("part"), "least"))
    names = parts.select("cid", "part").join(parts.groupBy("part").agg(F.min("least").alias("component_id")), "part").drop("part")
    named = cut(
        classes.select("label", "embedding", "cid", "least", "n").join(counts, "cid", "left").join(names, "cid", "left")
        .select(F.col("label").alias("of_label"), F.col("embedding").alias("of_vector"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component")))
    out = rows.withColumn("good", good).join(named, F.col("good") & (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of_vector")), "left")
    component = F.coalesce("component", F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
