"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree (domain, language, source). At every node it is dealt among the children by weight; a
child takes no more than its subtree holds, and what it leaves goes to its siblings by weight. A parent is never given
more than its children hold together, so a shortage reaches a higher level only when all siblings are full. The leaf then
takes whole seeded epochs and a token prefix of one more. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..scale import checked_broadcast, running
from .common import cut, whole_text

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The tables name no domain: the last digit of the source stands for it."""
    digit = F.regexp_extract(source, "([0-9])$", 1)
    return (F.when(digit.isin("0", "1", "2", "3"), "web").when(digit.isin("4", "5", "6"), "books")
            .when(digit.isin("7", "8"), "news").when(digit == "9", "code").otherwise("other"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("decimal(18,0)")


def deal(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Add ``share``: the parent's ``budget`` dealt by ``weight`` under the limits ``cap`` (all whole numbers).

    Children are filled in order of cap / weight: a child whose fair share of what is left reaches its cap takes the cap.
    The others share the rest by weight, rounded down; left-over single tokens go to them in order of name.
    """
    home = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(1))
    order = home.orderBy(F.col("cap") / F.col("weight"), name)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    out = (
        children.withColumn("_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_behind", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_full", big("cap") * big("_behind") <= (F.col("budget") - F.col("_before")).cast("decimal(19,0)") * big("weight"))
        .withColumn("_left", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(home))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(home))
        .withColumn("_part", F.expr("CASE WHEN _full THEN cap ELSE CAST(_left AS DECIMAL(19,0)) * CAST(weight AS DECIMAL(18,0)) DIV CAST(_open AS DECIMAL(19,0)) END"))
        .withColumn("_rest", F.col("budget") - F.sum("_part").over(home))
        .withColumn("_place", F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(home.orderBy(name).rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("share", (F.col("_part") + F.when(~F.col("_full") & (F.col("_place") <= F.col("_rest")), 1).otherwise(0)).cast("long"))
    )
    return out.drop("_before", "_behind", "_full", "_left", "_open", "_part", "_rest", "_place")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], part: tuple[int, int], max_epochs: int) -> DataFrame:
    """``levels..., tokens, budget`` per leaf for rows ``levels..., tokens``; ``part`` of all tokens is the whole budget."""
    caps = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("long"))
    top = leaves.agg(F.least(F.expr(f"sum(tokens) * {part[0]} DIV {part[1]}"), F.sum("tokens") * max_epochs).alias("budget"))
    upper = None
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[:depth - 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(levels[depth - 1], weights))
        given = nodes.crossJoin(F.broadcast(top.limit(1))) if upper is None else nodes.join(upper, parent)
        upper = deal(given, parent, levels[depth - 1]).select(*path, F.col("share").alias("budget"))
    return caps.join(upper, list(levels)).select(*levels, "tokens", "budget")


def mix(df: DataFrame, levels: Sequence[Column], weights: Mapping[str, Mapping[str, int]], part: tuple[int, int] = (1, 2),
        max_epochs: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
        names: Sequence[str] = LEVELS) -> DataFrame:
    """One row per input row: ``doc_id``, the ``names`` of its leaf, ``n_tokens, epochs, prefix_tokens, taken_tokens``.

    ``levels`` are columns from the root to the leaf, ``weights`` whole numbers per level and value (1 where none is
    given), ``part`` the share of all tokens to choose as a fraction, ``max_epochs`` how often a text may be used at most.
    ``epochs`` are whole passes over the leaf; ``prefix_tokens`` are this document's tokens inside the prefix of the next
    pass, whose order is the md5 of seed, pass and id. Null level values are the value ''. Null and empty texts have no
    tokens and are never chosen. Rows that repeat an id stand side by side in the order. An empty table gives no rows.
    """
    docs = df.select(
        F.col(id_col).alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(levels, names, strict=True)],
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("n_tokens"))
    docs = cut(docs)
    names = list(names)
    leaves = docs.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = checked_broadcast(budgets(cut(leaves), names, weights, part, max_epochs).select(
        *names, F.expr("budget DIV greatest(tokens, 1)").alias("epochs"), F.expr("budget % greatest(tokens, 1)").alias("prefix")))
    placed = docs.join(plan, names).withColumn(
        "place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    order = ["place", "n_tokens"]
    summed = running(placed, names, order, [F.substring("place", 1, 2), F.substring("place", 1, 4)], {"upto": F.col("n_tokens")})
    used = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("prefix") - (F.col("upto") - F.col("n_tokens"))))
    return summed.withColumn("prefix_tokens", used.cast("long")).select(
        "doc_id", *names, "n_tokens", "epochs", "prefix_tokens", (F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("taken_tokens"))
