"""Numeric features of boxes and their vectors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bbox as B, text as T
from ..functions.bbox import Box
from ..operators.relations import RELATED, with_relations
from ..scale import PAGE, beside, cut
from ..schema import PAGE_HEIGHT, PAGE_WIDTH

def numeric_columns(relations: bool = True) -> dict[str, F.Column]:
    """Ten position, twenty-one text and (optionally) fourteen relation figures in fixed order; missing ones are 0."""
    b, text = Box.of(), F.col("text")
    cols = {
        "x_norm": b.x / PAGE_WIDTH, "y_norm": b.y / PAGE_HEIGHT, "cx_norm": b.cx / PAGE_WIDTH, "cy_norm": b.cy / PAGE_HEIGHT, "w_norm": b.width / PAGE_WIDTH,
        "h_norm": b.height / PAGE_HEIGHT, "area_norm": b.area / (PAGE_WIDTH * PAGE_HEIGHT), "aspect": B.aspect(b), "quadrant": B.quadrant(b),
        "region": F.when(B.region(b.cy) == "header", 1).when(B.region(b.cy) == "footer", 3).otherwise(2),
    }
    cols.update(T.features(text))
    cols.update({f"matches_{n}": T.matches(text, n) for n in ("date", "order_number", "currency", "percentage", "email", "phone", "item_number", "part_chars")})
    if relations:
        cols.update({n: F.col(n) for n in RELATED})
    return {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in cols.items()}


def assemble(boxes: DataFrame, relations: bool = True, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """Feature vector per box (45 figures with relations, 31 without)."""
    base = with_relations(boxes) if relations else boxes
    cols = numeric_columns(relations)
    flat = base.select(*PAGE, "entity_seq", *keep, *[c.alias(f"f_{n}") for n, c in cols.items()])
    return VectorAssembler(inputCols=[f"f_{n}" for n in cols], outputCol="features").transform(flat).drop(*[f"f_{n}" for n in cols])


def grams_of(text: Column, chars: bool = True, grams: int = 3) -> Column:
    """All n-grams of a text up to ``grams`` as an array, repeats included; members are joined by a blank."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "" if chars else r"\W+"), lambda t: t != "")
    found = []
    for n in range(1, grams + 1):
        last = F.size(tokens) - (n - 1)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
        found.append(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")))
    return F.concat(*found)


def tfidf_terms(texts: DataFrame, column: str = "text", count: str = "n", chars: bool = True, grams: int = 3, size: int = 100) -> DataFrame:
    """``term, tf, df, idf`` of the ``size`` most frequent n-grams over all orders together; ties go to the smaller term.

    Each text is listed once and stands for ``count`` documents, in the counts as in the number of documents.
    """
    terms = grams_of(F.col(column), chars, grams)
    top = cut(texts.select(count, F.explode(terms).alias("term")).groupBy("term").agg(F.sum(count).alias("tf")).orderBy(F.desc("tf"), "term").limit(size))
    seen = texts.select(count, F.explode(F.array_distinct(terms)).alias("term")).join(F.broadcast(top), "term").groupBy("term", "tf").agg(F.sum(count).alias("df"))
    total = texts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("_total"))
    return cut(seen.transform(beside, total).withColumn("idf", F.log((F.col("_total") + 1) / (F.col("df") + 1))).drop("_total"))


def tfidf(texts: DataFrame, terms: DataFrame, column: str = "text", count: str = "n", chars: bool = True, grams: int = 3) -> DataFrame:
    """Sum of the TF-IDF weights per text; 0 without a term of the vocabulary (``terms``, some hundred rows)."""
    found = texts.select(column, count, F.explode_outer(grams_of(F.col(column), chars, grams)).alias("term")).join(F.broadcast(terms.select("term", "idf")), "term", "left")
    return found.groupBy(column, count).agg(F.sum(F.coalesce("idf", F.lit(0.0))).alias("weight"))


def scaling(values: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation per column: one row."""
    return values.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def scale(values: DataFrame, columns: list[str]) -> DataFrame:
    """Centered columns over their population deviation (a constant column stays 0)."""
    row = scaling(values, columns)
    out = values.transform(beside, row)
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(0.0))
    return out.drop(*row.columns)
