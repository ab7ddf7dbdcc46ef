"""Hashes and layout signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import PAGE, topk
from ..schema import PAGE_HEIGHT, PAGE_WIDTH


def content_hash(content: Column) -> dict[str, Column]:
    return {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256)}


def label_grid_signature(boxes: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Page signature: first 20 of the sorted ``label:gx,gy`` cells (10 x 10 grid), hashed to eight characters."""
    cell = F.concat_ws(
        "", "label", F.lit(":"), F.floor(F.col("x") * 10 / PAGE_WIDTH), F.lit(","), F.floor(F.col("y") * 10 / PAGE_HEIGHT)
    )
    first = topk(boxes.filter("label <> ''").select(*keys, "entity_seq", cell.alias("cell")), keys, ["cell", "entity_seq"], 20)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "cell"))), lambda s: s["cell"])
    return first.groupBy(*keys).agg(F.substring(F.md5(F.concat_ws("|", parts)), 1, 8).alias("signature"))


def reading_grid_signature(boxes: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Page signature: ``i:x//10:y//10:len//5`` of the first ten boxes in reading order."""
    first = topk(boxes.select(*keys, "entity_seq", "x", "y", F.length("text").alias("n")), keys, ["y", "x", "entity_seq"], 10)
    part = F.concat_ws(":", F.col("rank") - 1, F.floor(F.col("x") / 10), F.floor(F.col("y") / 10), F.floor(F.col("n") / 5))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))), lambda s: s["part"])
    return first.groupBy(*keys).agg(F.concat_ws("|", parts).alias("signature"))


def similarity(a: Column, b: Column) -> Column:
    """Equal parts over parts; 0 for empty signatures or different lengths."""
    left, right = F.split(a, "[|]"), F.split(b, "[|]")
    same = F.aggregate(F.zip_with(left, right, lambda p, q: (p == q).cast("int")), F.lit(0), lambda acc, v: acc + v)
    return F.when((a == "") | (b == "") | (F.size(left) != F.size(right)), 0.0).otherwise(same / F.size(left))
