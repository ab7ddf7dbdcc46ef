"""Posterior label probabilities of the sequence model by forward and backward passes.

Every chunk of a page is a matrix: how likely its end label is after each label in front of it. The matrices of a page are
multiplied up from both ends in rounds of doubled reach, so that a long page is many small rows; with what comes from the
left and from the right, each chunk then finishes alone. Chunks and rounds do not change the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..scale import PAGE, cut
from .train import CHUNK, sequence_tables

MATRIX = "doc_id bigint, page_number int, chunk bigint, m array<double>"


def sequence_probabilities(boxes: DataFrame, train: DataFrame, labels: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """``entity_seq, probs`` per box: probabilities of ``labels``, from label transitions and text shapes of ``train``."""
    n = len(labels)
    order, moves, seen = sequence_tables(train)
    ordered = sequence_tables(boxes if "label" in boxes.columns else boxes.withColumn("label", F.lit(None).cast("string")))[0]
    place = {name: i for i, name in enumerate(labels)}
    move = [[1.0] * n for _ in labels]
    for r in moves.filter(F.col("label").isin(*labels) & F.col("following").isin(*labels)).collect():  # vocabulary squared
        move[place[r["label"]]][place[r["following"]]] += r["n"]
    move = [[v / sum(row) for v in row] for row in move]
    total = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    floor = [1 / (total.get(name, 0) + 2) for name in labels]
    count = lambda name: F.coalesce(F.max(F.when(F.col("label") == name, F.col("n"))), F.lit(0))
    emit = seen.groupBy("shape").agg(F.array(*[(count(name) + 1) * floor[i] for i, name in enumerate(labels)]).alias("e"))
    unseen = F.array(*[F.lit(v) for v in floor])
    rows = ordered.select(*PAGE, "place", "entity_seq", "shape").join(emit, "shape", "left").withColumn("e", F.coalesce("e", unseen))
    chunks = cut(rows.groupBy(*PAGE, F.expr(f"(place - 1) div {chunk}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("place", "entity_seq", "e"))).alias("steps")))
    last = chunks.groupBy(*PAGE).agg(F.max("chunk").alias("last"))
    several = last.filter("last > 0")

    def whole(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for doc, page, number, steps in zip(batch["doc_id"], batch["page_number"], batch["chunk"], batch["steps"]):
                m = None
                for s in steps:
                    e = np.array(s["e"], float)
                    m = (np.tile(e, (n, 1)) if number == 0 else np.array(move) * e) if m is None else m @ np.array(move) * e
                    m = m / m.sum()
                out.append((doc, page, number, m.ravel().tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "chunk", "m"])

    def product(batches):
        import numpy as np

        for batch in batches:
            p = [np.array(a, float).reshape(n, n) @ np.array(b, float).reshape(n, n) for a, b in zip(batch["a"], batch["b"])]
            yield batch[["doc_id", "page_number", "chunk"]].assign(m=[(x / x.sum()).ravel().tolist() for x in p])

    far = several.agg(F.max("last")).first()[0] or 0
    given = chunks.select(*PAGE, "chunk", "steps").withColumn("left", F.lit(None).cast("array<double>")).withColumn("right", F.lit(None).cast("array<double>"))
    if far:
        one = cut(chunks.join(several, PAGE).select(*PAGE, "chunk", "steps").mapInPandas(whole, MATRIX))
        up, down, width = one, one, 1  # products of all up to a chunk, and from a chunk on
        while width <= far:
            step = lambda df, by, name: df.select(*PAGE, (F.col("chunk") + by).alias("chunk"), F.col("m").alias(name))
            longer = step(up, width, "a").join(step(up, 0, "b"), [*PAGE, "chunk"]).mapInPandas(product, MATRIX)
            up = cut(up.filter(F.col("chunk") < width).unionByName(longer))
            both = step(down, 0, "a").join(step(down, -width, "b"), [*PAGE, "chunk"]).mapInPandas(product, MATRIX)
            rest = down.join(both.select(*PAGE, "chunk"), [*PAGE, "chunk"], "left_anti")
            down = cut(rest.unionByName(both))
            width *= 2
        before = up.select(*PAGE, (F.col("chunk") + 1).alias("chunk"), F.slice("m", 1, n).alias("left"))
        sums = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.slice("m", i * n + 1, F.lit(n)), F.lit(0.0), lambda x, y: x + y))
        after = down.select(*PAGE, (F.col("chunk") - 1).alias("chunk"), sums.alias("right"))
        given = chunks.join(before, [*PAGE, "chunk"], "left").join(after, [*PAGE, "chunk"], "left").select(*PAGE, "chunk", "steps", "left", "right")

    def finish(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            docs, pages, ids, found = [], [], [], []
            for doc, page, steps, left, right in zip(batch["doc_id"], batch["page_number"], batch["steps"], batch["left"], batch["right"]):
                e = np.array([s["e"] for s in steps], float)
                ahead, back = np.empty_like(e), np.ones_like(e)
                ahead[0] = e[0] if left is None else np.array(left, float) @ np.array(move) * e[0]
                ahead[0] /= ahead[0].sum()
                for t in range(1, len(e)):
                    ahead[t] = ahead[t - 1] @ np.array(move) * e[t]
                    ahead[t] /= ahead[t].sum()
                if right is not None:
                    back[-1] = right
                for t in range(len(e) - 2, -1, -1):
                    back[t] = np.array(move) @ (e[t + 1] * back[t + 1])
                    back[t] /= back[t].sum()
                p = ahead * back
                found += (p / p.sum(1, keepdims=True)).tolist()
                docs += [doc] * len(e)
                pages += [page] * len(e)
                ids += [s["entity_seq"] for s in steps]
            yield pd.DataFrame({"doc_id": docs, "page_number": pages, "entity_seq": ids, "probs": found})

    return given.mapInPandas(finish, "doc_id bigint, page_number int, entity_seq bigint, probs array<double>")
